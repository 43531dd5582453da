import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import dates, vectors
from colloquy.functions import text as tx
from colloquy.functions.names import nfkc
from colloquy.functions.porter import stem


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normalise_text_is_python_split(spark):
    rng = random.Random(1)
    odd = "a b\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　 😀é"
    texts = ["".join(rng.choice(odd) for _ in range(30)) for _ in range(200)] + ["", " "]
    got = values(spark, [(t,) for t in texts], "t string", tx.normalise_text(F.col("t")))
    assert got == [" ".join(t.split()) for t in texts]


DATES = [
    ("by Friday", "2024-11-18", "2024-11-22", "relative_resolved"),
    ("by Monday", "2024-11-18", "2024-11-25", "relative_resolved"),
    ("next Friday", "2024-11-18", "2024-11-29", "relative_resolved"),
    ("tomorrow", "2024-11-18", "2024-11-19", "relative_resolved"),
    ("end of the day", "2024-11-18", "2024-11-18", "relative_resolved"),
    ("next week", "2024-11-18", "2024-11-29", "relative_resolved"),
    ("this week", "2024-11-23", "2024-11-22", "relative_resolved"),
    ("end of the month", "2024-02-03", "2024-02-29", "relative_resolved"),
    ("in two weeks", "2024-11-18", "2024-12-02", "relative_resolved"),
    ("in a month", "2024-11-18", "2024-12-18", "relative_resolved"),
    ("in 3 days.", "2024-11-18", "2024-11-21", "relative_resolved"),
    ("October fifteenth", "2024-11-18", "2025-10-15", "absolute"),
    ("November 18", "2024-11-18", "2024-11-18", "absolute"),
    ("the twenty-first of december", "2024-11-18", "2024-12-21", "absolute"),
    ("second week of November", "2024-11-18", "2025-11-02", "absolute"),
    ("March 3rd 2031", "2024-11-18", "2025-03-03", "absolute"),
    ("29 February", "2023-11-18", "UNSPECIFIED", "unspecified"),
    ("2024-13-45", "2024-11-18", "2024-13-45", "absolute"),
    ("soon", "2024-11-18", "UNSPECIFIED", "unspecified"),
    ("before the audit, tomorrow", "2024-11-18", "UNSPECIFIED", "unspecified"),
    ("whenever", "2024-11-18", "UNSPECIFIED", "unspecified"),
    ("", "2024-11-18", "UNSPECIFIED", "unspecified"),
    (None, "2024-11-18", "UNSPECIFIED", "unspecified"),
    ("tomorrow", None, "UNSPECIFIED", "unspecified"),
]


def test_due_dates(spark):
    rows = [(s, None if d is None else dt.date.fromisoformat(d)) for s, d, _, _ in DATES]
    got = spark.createDataFrame(rows, "s string, d date").select(dates.resolve_due_date(F.col("s"), F.col("d")).alias("r")).select("r.*").collect()
    assert [(r["value"], r["date_type"]) for r in got] == [(v, k) for _, _, v, k in DATES]


@pytest.mark.parametrize("said, want", [("1:02:03", 3723.0), ("02:03.5", 123.5), ("00:61", None), ("12.5", 12.5), ("-1", None), ("", None), ("x", None), (" 0:0:1 ", 1.0)])
def test_clock(spark, said, want):
    assert values(spark, [(said,)], "t string", dates.parse_timestamp(F.col("t"))) == [want]


def test_clock_is_written_without_fraction(spark):
    assert values(spark, [(3723.9,), (None,), (-1.0,)], "t double", dates.format_timestamp(F.col("t"))) == ["01:02:03", None, None]


def test_quotes(spark):
    rows = [("b  c", "a b c b c"), ("", "a"), ("z", "a"), ("😀 é", "x😀 é"), (None, "a")]
    frame = spark.createDataFrame(rows, "q string, t string")
    got = frame.select(tx.locate_quote(F.col("q"), F.col("t")).alias("x"), tx.verify_quote(F.col("q"), F.col("t")).alias("v")).collect()
    assert [None if r["x"] is None else tuple(r["x"]) for r in got] == [(2, 5), None, None, (1, 4), None]
    assert [r["v"] for r in got] == [True, False, False, True, False]


def test_speakers(spark):
    lookup = tx.speaker_lookup(F.array(*[F.lit(x) for x in ("Priya Sharma", "Priya Menon", "Bo Li")]))
    rows = [("Bo: hi",), ("Priya: hi",), ("Ann Lee: hi",), ("Action Items: x",), ("note",), ("Bo:",), ("priya menon: yes",), ("a: b: c",)]
    got = spark.createDataFrame(rows, "l string").select(tx.split_speaker(F.col("l"), lookup).alias("s")).collect()
    assert [tuple(r["s"]) for r in got] == [
        ("Bo Li", "hi"), (None, "Priya: hi"), ("Ann Lee", "hi"), (None, "Action Items: x"), (None, "note"), (None, "Bo:"), ("Priya Menon", "yes"), (None, "a: b: c"),
    ]


def test_similarity_and_overlap(spark):
    rows = [("Finish auth refactor with integration tests", "Complete the authentication refactor and its tests"), ("one", "one"), ("", "x")]
    got = values(spark, rows, "a string, b string", tx.task_similarity(F.col("a"), F.col("b")))
    assert got == [0.5, 0.0, 0.0]
    got = values(spark, [(0, 10, 5, 15), (0, 10, 10, 20), (None, 1, 0, 1), (0, 0, 0, 0)], "a int, b int, c int, d int", tx.span_overlap(*[F.col(c) for c in "abcd"]))
    assert got == [0.5, 0.0, 0.0, 0.0]


def test_names(spark):
    rows = [("Dr Priya Sharma",), ("TBD",), (None,), ("priya",), ("Dr",), ("O'Neil-Li, Bo",), ("n a",)]
    assert values(spark, rows, "n string", tx.person_key(F.col("n"))) == ["priya", "unassigned", "unassigned", "priya", "dr", "o'neil-li", "unassigned"]
    assert values(spark, rows[:1], "n string", tx.person_key(F.col("n"), "full_name")) == ["priya_sharma"]
    assert values(spark, [("ﬁ①",), (None,)], "n string", nfkc("n")) == ["fi1", None]


def test_abstentions(spark):
    assert values(spark, [(" N/A. ",), ("Bo",), ("",)], "x string", tx.collapse_abstention(F.col("x"))) == ["UNSPECIFIED", "Bo", "UNSPECIFIED"]


def test_vectors(spark):
    e = vectors.hash_embedding("a b c a")
    assert abs(float((e**2).sum()) - 1) < 1e-5 and not vectors.hash_embedding("").any()
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in frame.select(vectors.l2_normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, [("3/4",), ("1/0",), ("2.5",), ("-",)], "m string", vectors.metric_value(F.col("m"))) == [0.75, None, 2.5, None]


@pytest.mark.parametrize(
    "word, want",
    [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("adoption", "adopt"), ("controll", "control"), ("deferred", "defer"), ("as", "as")],
)
def test_stems(word, want):
    assert stem(word) == want
