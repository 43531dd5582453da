import random
import re

from colloquy.llm import decontamination as dc

RNG = random.Random(6)
WORDS = [f"w{k}" for k in range(12)]
SCHEMA = "item_id long, text string, spans string, doc_id long"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else []:
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(own), hit, found


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], SCHEMA)


def check(got, rows, items, window):
    assert len(got) == len(rows)
    told = {(r["doc_id"]): r for r in got}
    for d, t in rows:
        n, hit, found = brute(t, items, window)
        r = told[d]
        spans = [(s["a"], s["b"]) for s in r["spans"]]
        assert {k for a, b in spans for k in range(a, b)} == hit, (d, t)
        assert spans == sorted(spans) and r["n_words"] == n and set(r["items"]) == found


def test_agrees_with_all_windows(make, spark):
    items = [(k, " ".join(RNG.choice(WORDS) for _ in range(RNG.choice([1, 2, 3, 5, 9, 14])))) for k in range(6)] + [(6, None), (7, "?!"), (None, "w1 w2 w1 w2 w1"), (3, "w5 w5 w5 w5")]
    rows = [(k, " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(0, 60)))) for k in range(60)] + [(100, None), (101, "Ünï W1-w2,W1 w2 w1!")]
    rows += [(200 + k, f"{text} {items[5][1]} {text}") for k, text in enumerate(["a b", "", "w1"])]
    for window in (3, 4, 10):
        check(dc.find_contamination(make(rows), bench(spark, items), window).collect(), rows, items, window)
    # many shards tell the same as one
    check(dc.find_contamination(make(rows), bench(spark, items), 4, shard_bytes=20).collect(), rows, items, 4)


def test_automaton_tells_longest_matches():
    for _ in range(100):
        items = [[RNG.randrange(3) for _ in range(RNG.randint(1, 12))] for _ in range(3)]
        sam = dc.SuffixAutomaton()
        for x in items:
            sam.add(x)
        text = [RNG.randrange(4) for _ in range(40)]
        subs = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        want = [max((n for n in range(1, k + 2) if tuple(text[k + 1 - n : k + 1]) in subs), default=0) for k in range(len(text))]
        assert list(sam.stream(text)) == want


def test_cleaning(make, spark):
    item = " ".join(f"Item{k}" for k in range(12))
    rows = [(1, f"Before it, {item}; after."), (2, item), (3, "nothing here"), (4, None), (5, ""), (5, ""), (None, f"x {item} y")]
    rows = [(d, t + " filler" * 8 if t and d in (1, None) else t) for d, t in rows]
    sharded = dc.decontaminate(make(rows), bench(spark, [(1, item), (2, "other words"), (3, "and more")]), shard_bytes=10)
    out = dc.decontaminate(make(rows), bench(spark, [(1, item)]))
    assert sorted(map(str, sharded.collect())) == sorted(map(str, out.collect()))
    assert out.columns == make(rows).columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(1, "Before it, ; after." + " filler" * 8), (3, "nothing here"), (4, None), (5, ""), (5, ""), (None, "x  y" + " filler" * 8)]
    assert got == sorted(want, key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_empty(make, spark):
    assert dc.find_contamination(make([]), bench(spark, [(1, "a")])).count() == 0
    got = dc.find_contamination(make([(1, "a b")]), bench(spark, [])).first()
    assert got["n_words"] == 2 and got["spans"] == [] and got["items"] == []


def test_very_long_text(make, spark):
    item = " ".join(f"q{k}" for k in range(10))
    rows = [(1, "w1 w2 " * 100000 + item + " w3" * 1000)]
    r = dc.find_contamination(make(rows), bench(spark, [(1, item)])).first()
    assert [(s["a"], s["b"]) for s in r["spans"]] == [(200000, 200010)]
