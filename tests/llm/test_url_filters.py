from colloquy.llm import url_filters as uf

SCHEMA = "page_id long, url string, html string, host string, rule string, node string"


def judged(spark, rows, redirects=None):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    hops = None if redirects is None else spark.createDataFrame(redirects, "source string, target string")
    return {r["page_id"]: r for r in uf.filter_urls(frame, hops).collect()}


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "HTTP://Sub.Example.COM/en/75?q#f", ""), (2, "https://example.com/en/8", ""), (3, "http://x.net/de/9", ""), (4, "http://a.example.net/de/81", ""), (5, "http://y.org/es/", ""),
        (6, "http://com/en/", ""), (7, "http://telecom/en/", ""), (8, None, None), (9, "no scheme", ""), (10, "http://a.org?x=/es/", ""), (11, "a://b://c/en/", ""), (12, "http://y.org/ES/", ""),
    ]
    got = judged(spark, rows)
    told = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert told == {
        1: ("sub.example.com", "/en/75", "example.com/en/7", "allow"), 2: ("example.com", "/en/8", "com/en/", "block"), 3: ("x.net", "/de/9", "net/de/", "allow"), 4: ("a.example.net", "/de/81", "example.net/de/8", "block"),
        5: ("y.org", "/es/", "org/es/", "block"), 6: ("com", "/en/", "com/en/", "block"), 7: ("telecom", "/en/", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("a.org", "", None, "allow"),
        11: ("b:", "//c/en/", None, "allow"), 12: ("y.org", "/ES/", None, "allow"),
    }


def test_aliases_share_decisions(spark):
    link = '<head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (1, "http://a.info/x", link.format("http://b.org/es/1")),  # canonical of a blocked one
        (2, "http://c.info/y#frag", '<meta content="0; url=http://a.info/x" http-equiv="refresh">'),  # two steps away
        (3, "http://d.info/", link.format("http://q.example.com/en/7")),  # of an allowed one
        (4, "http://e.info/", link.format("http://d.info/")),
        (5, "http://e.info/", link.format("http://b.org/es/1")),  # in both groups: allowed wins, and joins them
        (6, "http://f.info/z/", link.format("../rel")),
        (7, "http://g.org/es/5", link.format("http://d.info/")),  # its own rule stays
    ]
    got = judged(spark, rows[:4])
    assert {k: r["verdict"] for k, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert got[1]["component"] == got[2]["component"] != got[3]["component"]
    got = judged(spark, rows)
    assert {k: r["verdict"] for k, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


def test_redirect_table_and_hub(spark):
    rows = [(k, f"http://h{k}.info/", None) for k in range(60)]
    hops = [(f"http://h{k}.info/", "http://hub.org/es/") for k in range(0, 60, 2)] + [(None, "http://x/")]
    got = judged(spark, rows, hops)
    assert all(got[k]["verdict"] == ("block" if k % 2 == 0 else "allow") for k in range(60))


def test_empty(spark):
    assert judged(spark, []) == {}


def test_every_spelling_and_every_tag(spark):
    to = "http://b.org/es/1"
    pages = [f'<link rel="CaNonical" href="{to}">', f'<link href="{to}" rel="alternate canonical">', f"<LINK rel='canonical next' href='{to}'>", f"<link rel=canonical href={to}>",
             f'<link rel="canonical" href="http://other.info/"><link rel="canonical" href="{to}">', f'<META HTTP-EQUIV="Refresh" content="1"><meta http-equiv=refresh content="0; URL={to}">',
             f'<link rel="canonical-not" href="{to}">', f'<link rel="next" href="{to}">']
    got = judged(spark, [(k, f"http://h{k}.info/", html) for k, html in enumerate(pages)])
    assert [got[k]["verdict"] for k in range(8)] == ["block"] * 6 + ["allow"] * 2


def test_agrees_with_sql(spark, tmp_path):
    """The recursive SQL over declared edges of all kinds, repeated rows, very long urls and nulls."""
    import duckdb

    from colloquy.llm.queries import ORACLES

    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://a.info/x/y", link.format("../es")), (1, "http://a.info/x/y", link.format("../es")), (2, "HTTP://A.info/x/../es", link.format("//b.org/es/7#top")), (3, "http://c.info", link.format("es/1")),
            (4, "http://c.info/es/1", link.format("/k?a=1&amp;b=2")), (5, "http://c.info/k?a=1&b=2", '<meta http-equiv="refresh" content="0;url=http://q.example.com/en/7">'), (6, "http://d.info/" + "z" * 30000, link.format("http://b.org/es/7")),
            (7, None, link.format("http://b.org/es/7")), (8, "http://e.info/", None), (9, "no scheme", link.format("x")), (10, "http://b.org/es/7", ""), (11, "http://sub.b.org/es/", link.format("http://d.info/" + "z" * 30000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    db = duckdb.connect()
    db.register("pages", pages.toPandas())
    want = db.sql(ORACLES["op2_url_filters"]).fetchall()
    names = [c[0] for c in db.description] if db.description else ["page_id", "host", "path", "rule", "verdict", "component"]
    got = uf.filter_urls(pages)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want))
    assert {r["page_id"]: r["verdict"] for r in got.collect()}[6] == "block"
