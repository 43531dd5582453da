"""Segments: offsets, source texts, quotes, neighbours and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.schemas import BLOCKING_DEFECTS

TERMINAL = (".", "!", "?", '"', "'", ")", "]", "…", "”", "’")
MIN_SEGMENTS = 2


def by_index(source: str = "source_id", index: str = "segment_index"):
    return Window.partitionBy(source).orderBy(index)


def normalise_segments(raw: DataFrame) -> DataFrame:
    """Offset-addressed segments of (source_id, segment_index, text, ...).

    A source's text is its segments' texts, white space normalised, joined by one space.  Blank segments
    go but their index stays used.  Offsets are code points, ends exclusive.
    """
    rows = raw.withColumn("text", tx.normalise_text(F.col("text"))).where("text <> ''")
    before = F.coalesce(F.sum(F.length("text") + 1).over(by_index().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.withColumns({"segment_id": tx.segment_id(F.col("source_id"), F.col("segment_index")), "char_start": before}).withColumn("char_end", F.col("char_start") + F.length("text"))


def source_texts(segments: DataFrame) -> DataFrame:
    """source_id, source_text."""
    ordered = F.array_sort(F.collect_list(F.struct("segment_index", "text")))
    return segments.groupBy("source_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("source_text"))


def ground_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes (source_id, quote, ...) with quote_verified, char_start and char_end; one first occurrence each."""
    at = tx.locate_quote(F.col("quote"), F.col("source_text"))
    return (
        quotes.join(texts, "source_id", "left")
        .withColumn("_at", at)
        .select(*quotes.columns, F.col("_at").isNotNull().alias("quote_verified"), F.col("_at.char_start").alias("char_start"), F.col("_at.char_end").alias("char_end"))
    )


def point_in_segment(points: DataFrame, segments: DataFrame, point: str = "char_start") -> DataFrame:
    """The segment that holds a code point of its source: equality on the source keeps the range test local."""
    s = segments.select("source_id", "segment_id", F.col("char_start").alias("_from"), F.col("char_end").alias("_to"))
    inside = (F.col(point) >= F.col("_from")) & (F.col(point) < F.col("_to"))
    return points.join(s, "source_id").where(inside).drop("_from", "_to")


def neighbours(hits: DataFrame, segments: DataFrame, window: int = 1) -> DataFrame:
    """Segments within ``window`` of a hit (source_id, segment_index, rank) that are no hits, with the rank of
    the first hit that they are next to.  The range is exploded, so that the join is an equality."""
    if window <= 0:
        return segments.limit(0).withColumn("rank", F.lit(None).cast("int"))
    near = hits.select("source_id", "rank", F.explode(F.sequence(F.col("segment_index") - window, F.col("segment_index") + window)).alias("segment_index"))
    near = near.groupBy("source_id", "segment_index").agg(F.min("rank").alias("rank"))
    near = near.join(hits.select("source_id", "segment_index"), ["source_id", "segment_index"], "left_anti")
    return segments.join(near, ["source_id", "segment_index"])


def backward_steps(segments: DataFrame, value: str = "start_seconds") -> DataFrame:
    """Segments whose time is before the last one known, which advances even when it goes back."""
    last = F.last(value, ignorenulls=True).over(by_index().rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("previous", last).where(F.col(value) < F.col("previous"))


def ends_complete(x: Column) -> Column:
    bare = F.rtrim(x)
    complete = bare == ""
    for mark in TERMINAL:
        complete = complete | bare.endswith(mark)
    return complete


def truncated(segments: DataFrame) -> DataFrame:
    """source_id, tail of sources whose last segment ends without terminal punctuation."""
    last = segments.groupBy("source_id").agg(F.max_by("text", "segment_index").alias("last_text"))
    return last.where(~ends_complete(F.col("last_text"))).select("source_id", "last_text", F.regexp_extract("last_text", r"(\S+)\s*$", 1).alias("tail"))


def too_short(segments: DataFrame, least: int = MIN_SEGMENTS) -> DataFrame:
    return segments.groupBy("source_id").agg(F.count("*").alias("n_segments")).where(F.col("n_segments") < least)


def leading_defect(defects: Column) -> Column:
    """The most telling blocking defect of an array; null if none blocks."""
    rank = F.array(*[F.lit(c) for c in BLOCKING_DEFECTS])
    blocking = F.filter(defects, lambda d: d["severity"] == "error")
    keyed = F.transform(blocking, lambda d: F.struct(F.when(F.array_contains(rank, d["code"]), F.array_position(rank, d["code"])).otherwise(len(BLOCKING_DEFECTS) + 1).alias("at"), d.alias("d")))
    return F.array_min(keyed)["d"]


def summarise_defects(defects: Column) -> Column:
    """One line that says why a source was refused; empty if nothing blocks."""
    facts = F.struct(leading_defect(defects).alias("head"), F.size(F.filter(defects, lambda d: d["severity"] == "error")).alias("n"))

    def line(x: Column) -> Column:
        head, n = x["head"], x["n"]
        at = F.when(head["line_number"].isNotNull(), F.concat(F.lit(" at line "), head["line_number"].cast("string"))).otherwise("")
        more = F.when(n > 1, F.concat(F.lit(" (and "), (n - 1).cast("string"), F.lit(" more blocking)"))).otherwise("")
        return F.when(n > 0, F.concat(head["code"], at, F.lit(": "), head["detail"], more)).otherwise("")

    return tx.let(facts, line)


def silent_participants(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """source_id, silent: participants who never speak."""
    spoke = segments.where("speaker is not null").groupBy("source_id").agg(F.collect_set("speaker").alias("spoke"))
    return sources.join(spoke, "source_id", "left").select("source_id", F.array_except("participants", F.coalesce("spoke", F.array().cast("array<string>"))).alias("silent"))


def validate_segments(parsed: DataFrame, check_truncation: bool = True) -> DataFrame:
    """Parsed sources (source_id, segments array, defects array) with the defects that segments show.

    Blocking: no or too few segments, a last segment that is cut off.  Warnings: times that go back.
    """
    make = lambda code, severity, detail, line, excerpt: F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"), line.cast("int").alias("line_number"), excerpt.alias("excerpt")
    )
    none = F.lit(None).cast("string")
    n = F.size("segments")
    blocked = F.exists("defects", lambda d: d["severity"] == "error")
    empty = F.when((n == 0) & ~blocked, F.array(make("no_parseable_segments", "error", F.lit("no segment could be parsed"), none, none)))
    few = F.when((n > 0) & (n < MIN_SEGMENTS), F.array(make("no_parseable_segments", "error", F.format_string("only %d segment parsed", n), none, none)))
    last = F.get("segments", n - 1)
    cut = F.when((n > 0) & ~ends_complete(last["text"]), F.array(make("truncated_mid_sentence", "error", F.concat(F.lit("ends on "), F.regexp_extract(last["text"], r"(\S+)\s*$", 1)), last["line_number"], F.right(F.rtrim(last["text"]), F.lit(120)))))
    timed = F.filter("segments", lambda s: s["start_seconds"].isNotNull())
    pairs = F.zip_with(F.slice(timed, 2, F.greatest(F.size(timed) - 1, F.lit(0))), F.slice(timed, 1, F.greatest(F.size(timed) - 1, F.lit(0))), lambda s, p: F.struct(s.alias("s"), p.alias("p")))
    back = F.transform(F.filter(pairs, lambda x: x["s"]["start_seconds"] < x["p"]["start_seconds"]), lambda x: make("non_monotonic_timestamp", "warning", F.concat(x["s"]["start_ts"], F.lit(" goes back from "), x["p"]["start_ts"]), x["s"]["line_number"], F.substring(x["s"]["text"], 1, 120)))
    nothing = F.array().cast("array<struct<code:string,severity:string,detail:string,line_number:int,excerpt:string>>")
    parts = [F.col("defects"), empty, few, *([cut] if check_truncation else []), back]
    return parsed.withColumn("defects", F.concat(*[F.coalesce(p, nothing) for p in parts]))
