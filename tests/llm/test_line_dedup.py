import random

from colloquy.llm import line_dedup as ld

RNG = random.Random(7)


def sentence(rng=RNG):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(6, 10))) + "."


def passage(n=8, joint=" "):
    return joint.join(sentence() for _ in range(n))


def cleaned(make, rows):
    return {r["doc_id"]: r for r in ld.clean_lines(make(rows)).collect()}


def test_lines_join_to_the_text(spark):
    texts = ["a. b\nc. \n\n d.e. ", "", "\n", "x", "a\x00. b", "... . \n. "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    got = frame.select("t", ld.lines(F.col("t")).alias("l")).collect()
    assert all("".join(r["l"]) == r["t"] for r in got)
    assert {r["t"]: r["l"] for r in got}["a. b\nc. \n\n d.e. "] == ["a. ", "b\n", "c. ", "\n", "\n", " d.e. ", ""]


def test_shared_passages_go_from_all_but_the_first(make):
    shared = [passage(9), passage(8, "\n"), passage(12)]
    rows = [(k, f"{passage(3)} {shared[k % 3]} {passage(4)}") for k in range(30)]
    alone = [(100 + k, passage(10, "\n")) for k in range(10)]
    got = cleaned(make, rows + alone)
    for k, text in rows:
        kept = got[k]["text"]
        if k < 3:
            assert kept == text
        else:
            left = [s for s in shared[k % 3].replace("\n", " ").split(". ") if s.rstrip(".") in kept]
            assert len(left) == 0, (k, left)
            before, after = text.split(shared[k % 3])
            # text around a passage stays
            assert kept.split() == (before + after).split()
    assert all(got[k]["text"] == t and got[k]["n_removed"] == 0 for k, t in alone)


def test_every_removed_line_stays_somewhere(make):
    pool = [sentence() for _ in range(40)]
    rows = []
    for k in range(60):
        at = RNG.randrange(30)
        rows.append((k, " ".join(pool[at : at + RNG.randint(2, 10)] + [sentence()] + pool[:3])))
    got = cleaned(make, rows)
    kept = {line for r in got.values() for line in r["text"].split(". ")}
    assert {line for _, t in rows for line in t.split(". ")} - kept <= {""} | {line for line in kept} | {line.rstrip(".") for line in kept} | {line + "." for line in kept}


def test_short_repeats_stay(make):
    rows = [(k, f"{passage(4)}\nAll rights reserved.\nThe end.\n{passage(2)}") for k in range(20)]
    got = cleaned(make, rows)
    assert all(got[k]["text"] == t for k, t in rows)


def test_cases(make, spark):
    long = " ".join(sentence() for _ in range(3000))
    text = passage(10)
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, text), (5, long), (6, long), (7, f"{text}\n{text}")]
    out = ld.clean_lines(make(rows)).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in out), key=str)
    told = {}
    for k, c in got:
        told.setdefault(k, []).append(c)
    assert told[1] == [text, text] and told[2] == [None] and told[3] == [""] and told[None] == [text] and told[5] == [long]
    assert not told[4][0].strip() and not told[6][0].strip() and not told[7][0].strip()
    kept = ld.dedupe_lines(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "3", "5", "None"]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept.collect())
    assert ld.dedupe_lines(make([])).count() == 0


def test_tokens_join_to_the_text_and_hold_the_words(spark):
    from pyspark.sql import functions as F

    texts = ["a. b\nc. \n\n d.e. ", "", "\n", "x", "a\x00. b\tc", "x " + "y" * 40 + "\n\U0001f600z " + "\U0001f600中" * 30, "中" * 33 + "\x00 a"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select("t", ld.tokens(F.col("t")).alias("l"), ld.words(F.col("t")).alias("w")).collect()
    assert all("".join(r["l"]) == r["t"] and [x.strip(" \n\r\t") for x in r["l"]] == r["w"] for r in got)
    assert {r["t"]: len(r["w"]) for r in got}[texts[5]] == 1 + 40 + 1 + 60


def in_words(n, rng, joint=" "):
    return joint.join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_passages_that_begin_and_end_inside_sentences_go(make):
    rng = random.Random(11)
    # without stops; with other ends of sentences; with stops, but cut off in the middle of sentences
    kinds = [lambda: in_words(60, rng), lambda: "! ".join(in_words(9, rng) for _ in range(7)), lambda: "? ".join(in_words(9, rng) for _ in range(7)),
             lambda: ". ".join(in_words(20, rng) for _ in range(3)), lambda: "\n".join(in_words(1, rng) for _ in range(60))]
    shared = [k() for k in kinds for _ in range(8)]
    around = lambda: in_words(rng.randint(3, 30), rng)
    rows = [(k, around() + " ", s, " " + around()) for k, s in enumerate(shared * 2)]
    got = cleaned(make, [(k, a + s + b) for k, a, s, b in rows])
    for k, a, s, b in rows:
        assert got[k]["text"].split() == ((a + s + b) if k < len(shared) else (a + b)).split(), k


def test_scripts_without_spaces(make):
    rng = random.Random(12)
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    shared = [signs(220) for _ in range(10)]
    rows = [(k, signs(rng.randint(40, 90)), s, signs(50)) for k, s in enumerate(shared * 2)]
    got = cleaned(make, [(k, a + s + b) for k, a, s, b in rows])
    assert all(got[k]["text"] == (a + s + b if k < 10 else a + b) for k, a, s, b in rows)


def test_passages_of_one_to_five_lines_go_every_time(make):
    rng = random.Random(13)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 8))) for _ in range(n)) + "."
    shared = [" ".join(line(36 // n + 1) for _ in range(n)) for n in range(1, 6) for _ in range(20)]
    assert all(len(s) >= ld.MIN_RUN for s in shared)
    rows = [(k, line(9) + " ", s, " " + line(7)) for k, s in enumerate(shared * 2)]
    got = cleaned(make, [(k, a + s + b) for k, a, s, b in rows])
    assert all(got[k]["text"].split() == (a + (s if k < len(shared) else "") + b).split() for k, a, s, b in rows)


def test_agrees_with_brute_force(make):
    """Passages of 50 to 90 words anywhere, copies, passages within one document and repeated rows."""
    from tests.llm.brute import left_after_dedup

    rng = random.Random(17)
    shared = [in_words(rng.randint(50, 90), rng) for _ in range(6)]
    rows = []
    for k in range(24):
        parts = [in_words(rng.randint(1, 30), rng) for _ in range(3)]
        rows.append((100 - k, rng.choice([" ", "\n"]).join([parts[0], rng.choice(shared), parts[1], rng.choice(shared), parts[2]])))
    rows += [(200, rows[3][1]), (201, rows[3][1]), rows[5], (202, None), (203, ""), (204, shared[0]), (None, shared[0])]
    got = sorted(((r["doc_id"], r["text"]) for r in ld.dedupe_lines(make(rows)).collect()), key=str)
    assert got == sorted(left_after_dedup(rows, ld.MIN_RUN, ld.MIN_WORDS), key=str)


def test_equal_first_words_split_each_text_once(spark):
    from pyspark.sql import functions as F

    pairs = [("a b c", "a b c"), ("a b c", "a b"), ("a b", "a b c"), ("a x c", "a b c"), ("x", "y"), ("", "a"), ("a", None), (None, None), ("a  b", "a  c"), ("a", "a ")]
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ld._equal_first(F.col("a"), F.col("b")).alias("n"))

    def brute(a, b):
        if not a or not b:
            return 0
        x, y = a.split(" "), b.split(" ")
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    assert [(r["a"], r["b"], r["n"]) for r in frame.collect()] == [(a, b, brute(a, b)) for a, b in pairs]
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2


def test_a_filter_of_keys_tells_exactly_whose_place_is_taken(spark):
    from pyspark.sql import functions as F

    from colloquy.llm import common

    place = F.pmod(F.xxhash64("k"), F.lit(common.FILTER_BITS))
    keys, rows = spark.range(0, 400_000, 2).toDF("k"), spark.range(0, 500_000).toDF("k")
    told = common.may_match(rows, keys, ["k"])
    taken = keys.select(place.alias("p"), F.lit(True).alias("taken")).distinct()
    wrong = told.withColumn("p", place).join(taken, "p", "left").where(F.col("_maybe") != F.coalesce("taken", F.lit(False)))
    assert wrong.count() == 0 and told.where("_maybe").count() >= keys.count()
    assert not common.may_match(rows, keys.limit(0), ["k"]).where("_maybe").count()
    # no row writes a byte as text to read it again
    row_wise = told._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "getbit" in row_wise and "conv(" not in row_wise
