"""Order-dependent operators: chunk windows, greedy dedup, greedy pairing.

Windows are walked along jump tables made of prefix sums.  The two greedy operators fold each group's candidates,
in order, into their result by higher-order functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx

# Budgets in tokens and thresholds of likeness.
CHUNK_BUDGET, CHUNK_OVERLAP = 1200, 200
SPAN_THRESHOLD, TASK_THRESHOLD, ELSEWHERE_THRESHOLD, PAIR_THRESHOLD = 0.5, 0.4, 0.7, 0.5
NO_CONFIDENCE = 0.5


# --- chunk windows -----------------------------------------------------------------------------


def windows(costs: list[int], budget: int = CHUNK_BUDGET, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, carried) of each chunk over segments of these costs, which are positive.

    A chunk is the longest stretch within the budget, or a single segment.  The next one reaches back over
    the longest stretch within the overlap, but always begins later than the one before.
    """
    n = len(costs)
    total = np.concatenate([[0], np.cumsum(costs, dtype=np.int64)])
    reach = np.maximum(np.searchsorted(total, total[:n] + budget, side="right") - 1, np.arange(1, n + 1))
    back = np.searchsorted(total, total - overlap, side="left")
    starts, ends = [0] * bool(n), reach[:1].tolist()
    while ends and ends[-1] < n:
        starts.append(max(starts[-1] + 1, int(back[ends[-1]])))
        ends.append(int(reach[starts[-1]]))
    return [(a, b, before - a) for a, b, before in zip(starts, ends, [0, *ends], strict=False)]


CHUNK = (
    "source_id string, chunk_id string, chunk_index int, total int, first_segment_index int, last_segment_index int, n_segments int, n_overlap int, "
    "start_ts string, end_ts string, char_start int, char_end int, text string, estimated_tokens int"
)


def chunk_segments(segments: DataFrame, budget: int = CHUNK_BUDGET, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping chunks of a source's segments (source_id, segment_index, speaker, start_ts, text, char_start, char_end)."""
    line = tx.render_segment(F.col("start_ts"), F.col("speaker"), F.col("text"))
    rows = segments.select("source_id", "segment_index", "start_ts", "char_start", "char_end", line.alias("line")).withColumn("cost", tx.estimate_tokens(F.col("line")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment_index", ignore_index=True)
        found = np.array(windows(pdf["cost"].tolist(), budget, overlap))
        first, last = pdf.iloc[found[:, 0]].reset_index(drop=True), pdf.iloc[found[:, 1] - 1].reset_index(drop=True)
        lines, k = pdf["line"].tolist(), np.arange(len(found))
        out = pd.DataFrame({"source_id": first["source_id"], "chunk_index": k, "total": len(found), "n_segments": found[:, 1] - found[:, 0], "n_overlap": found[:, 2]})
        out["chunk_id"] = [f"{s}::chunk{i:03d}" for s, i in zip(out["source_id"], k, strict=True)]
        for name, side, column in (("first_segment_index", first, "segment_index"), ("last_segment_index", last, "segment_index"), ("start_ts", first, "start_ts"), ("end_ts", last, "start_ts"), ("char_start", first, "char_start"), ("char_end", last, "char_end")):
            out[name] = side[column]
        out["text"] = ["\n".join(lines[a:b]) for a, b, _ in found]
        out["estimated_tokens"] = (out["text"].str.len() // 4).clip(lower=1)
        return out[[c.split()[0] for c in CHUNK.split(", ")]]

    return rows.groupBy("source_id").applyInPandas(run, CHUNK)


# --- greedy dedup ------------------------------------------------------------------------------


def duplicate_reason(a: Column, b: Column, owner_rule: bool = True) -> Column:
    """Why two candidates (quote, words, owner, start, end) are one, or null.  The relation is not transitive."""

    def judge(similar: Column) -> Column:
        same = a["quote"] == b["quote"]
        near = tx.span_overlap(a["start"], a["end"], b["start"], b["end"]) >= SPAN_THRESHOLD
        reason = F.when((similar >= TASK_THRESHOLD) & same, "identical_quote").when((similar >= TASK_THRESHOLD) & near, "overlapping_span")
        named = (a["owner"] == b["owner"]) & (a["owner"] != tx.UNSPECIFIED) & (tx.normalise_text(a["owner"]) != "")
        return reason.when(named & (similar >= ELSEWHERE_THRESHOLD), "same_owner") if owner_rule else reason

    return tx.let(tx.containment(a["words"], b["words"]), judge)


def greedy_dedup(candidates: DataFrame, owner_rule: bool = True) -> DataFrame:
    """For each candidate (source_id, extraction_type, key, quote, task, owner, confidence, char_start, char_end) the
    survivor that it is, or that absorbs it, as source_id, extraction_type, key, survivor_key, reason.

    Candidates go by confidence (missing or zero: 0.5), place and key.  One that is a duplicate of an earlier
    survivor belongs to the first such; all others survive.  A meeting's candidates of one type are folded in
    one row, so that what they come from is read once.
    """
    group = ["source_id", "extraction_type"]
    placed = F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    certain = F.when(F.isnan("confidence") | (F.col("confidence") == 0), None).otherwise(F.col("confidence"))
    empty, place = F.lit(""), F.when(placed, F.col("char_start"))
    node = F.struct(
        (-F.coalesce(certain, F.lit(NO_CONFIDENCE))).alias("doubt"), place.isNull().alias("nowhere"), place.alias("start"), "key", F.when(placed, F.col("char_end")).alias("end"),
        tx.normalise_text(F.coalesce("quote", empty)).alias("quote"), F.coalesce("owner", empty).alias("owner"), tx.content_words(F.coalesce("task", empty)).alias("words"),
    )
    rows = candidates.select(*group, node.alias("node"))
    kind = rows.schema["node"].dataType.simpleString()
    folded = rows.groupBy(*group).agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("survivors"), F.array().cast("array<struct<key:string,survivor_key:string,reason:string>>").alias("told"))

    def settle(state: Column, node: Column) -> Column:
        first = F.get(F.filter(state["survivors"], lambda s: duplicate_reason(s, node, owner_rule).isNotNull()), F.lit(0))

        def add(s: Column) -> Column:
            told = F.struct(node["key"].alias("key"), F.coalesce(s["key"], node["key"]).alias("survivor_key"), F.when(s.isNotNull(), duplicate_reason(s, node, owner_rule)).alias("reason"))
            survivors = F.when(s.isNull(), F.concat(state["survivors"], F.array(node))).otherwise(state["survivors"])
            return F.struct(survivors.alias("survivors"), F.concat(state["told"], F.array(told)).alias("told"))

        return tx.let(first, add)

    return folded.select(*group, F.explode(F.aggregate("nodes", start, settle)["told"]).alias("t")).select(*group, "t.*")


# --- greedy pairing ----------------------------------------------------------------------------


def quotes_overlap(a: Column, b: Column) -> Column:
    """Whether one of two quotes that are not blank holds the other, in any case of letters."""
    a, b = (F.lower(tx.normalise_text(F.coalesce(x, F.lit("")))) for x in (a, b))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def greedy_pairs(golden: DataFrame, extractions: DataFrame) -> DataFrame:
    """One-to-one pairs of golden items (group_id, golden_id, position, quote, task) and extractions (group_id,
    extraction_id, position, quote, task), as group_id, golden_id, extraction_id, pass_no.

    First all golden items, in order, take the first free extraction with an overlapping quote; then those
    left may also match by task.  Unpaired ones of either side come with a null partner.
    """

    def side(df: DataFrame, key: str, mark: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("group_id").orderBy("position", key))
        return df.select("group_id", F.col(key).alias(f"{mark}_id"), rank.alias(mark), F.col("quote").alias(f"{mark}_quote"), tx.content_words(F.coalesce("task", F.lit(""))).alias(f"{mark}_words"))

    wanted, offered = side(golden, "golden_id", "g"), side(extractions, "extraction_id", "e")
    quoted, likeness = quotes_overlap(F.col("g_quote"), F.col("e_quote")), tx.containment(F.col("g_words"), F.col("e_words"))
    offers = wanted.join(offered, "group_id").select("group_id", "g", "e", quoted.alias("quoted"), (likeness >= PAIR_THRESHOLD).alias("alike")).where("quoted or alike")
    offers = offers.groupBy("group_id", "g").agg(F.array_sort(F.collect_list(F.struct("e", "quoted"))).alias("offers"))
    folded = wanted.select("group_id", "g", "g_id").join(offers, ["group_id", "g"], "left").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("g", "offers"))).alias("items"))
    kind = "array<struct<g:int,e:int,pass_no:int>>"

    def take(pass_no: int):
        def step(taken: Column, item: Column) -> Column:
            free = F.filter(item["offers"], lambda o: (o["quoted"] if pass_no == 1 else F.lit(True)) & ~F.exists(taken, lambda t: (t["e"] == o["e"]) | (t["g"] == item["g"])))
            pair = lambda e: F.struct(item["g"].alias("g"), e.alias("e"), F.lit(pass_no).alias("pass_no"))
            return F.concat(taken, F.coalesce(F.transform(F.slice(free, 1, 1), lambda o: pair(o["e"])), F.array().cast(kind)))

        return step

    taken = folded.withColumn("taken", F.aggregate("items", F.array().cast(kind), take(1)))
    pairs = taken.select("group_id", F.explode(F.aggregate("items", F.col("taken"), take(2))).alias("p")).select("group_id", "p.*")
    left = wanted.select("group_id", "g", "g_id").join(pairs, ["group_id", "g"], "left").join(offered.select("group_id", "e", "e_id"), ["group_id", "e"], "left")
    alone = offered.select("group_id", "e", "e_id").join(pairs, ["group_id", "e"], "left_anti")
    none = F.lit(None)
    return left.select("group_id", F.col("g_id").alias("golden_id"), F.col("e_id").alias("extraction_id"), "pass_no").unionByName(
        alone.select("group_id", none.cast(golden.schema["golden_id"].dataType).alias("golden_id"), F.col("e_id").alias("extraction_id"), none.cast("int").alias("pass_no"))
    )
