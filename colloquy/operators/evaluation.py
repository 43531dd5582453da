"""Metrics against labelled ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import UNSPECIFIED
from colloquy.operators.grouped import quotes_overlap

THRESHOLDS = (0.0, 0.5, 0.7, 0.8, 0.9)
NO_RANK = 99
#: Words that tell of a consequence.
CONSEQUENCES = [
    "miss", "missed", "delay", "postpone", "lose", "lost", "trust", "deadline",
    "blocked", "block", "cannot", "can't", "fail", "risk", "grey", "legal",
]


def recall_precision(pairs: DataFrame, *keys: str) -> DataFrame:
    """matched, missed, false_positives, recall and precision (0 without items) of golden pairs."""
    both = F.col("golden_id").isNotNull() & F.col("extraction_id").isNotNull()
    told = pairs.groupBy(*keys).agg(F.count_if(both).alias("matched"), F.count_if(F.col("extraction_id").isNull()).alias("missed"), F.count_if(F.col("golden_id").isNull()).alias("false_positives"))
    share = lambda other: F.coalesce(F.try_divide(F.col("matched"), F.col("matched") + F.col(other)), F.lit(0.0))
    return told.withColumns({"recall": share("missed"), "precision": share("false_positives")})


def class_scores(judged: DataFrame, truth: str = "truth", predicted: str = "predicted", default: str = "noise") -> DataFrame:
    """label, tp, fp, fn, precision, recall (null without items).  No prediction counts as ``default``."""
    rows = judged.select(F.col(truth).cast("string").alias("t"), F.coalesce(F.col(predicted).cast("string"), F.lit(default)).alias("p"))
    # counts by pair come first: labels are few, rows are not
    counts = rows.groupBy("t", "p").agg(F.count("*").alias("n"))
    each = counts.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("label"), "t", "p", "n")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    label = F.col("label")
    told = each.groupBy("label").agg(
        total((F.col("t") == label) & (F.col("p") == label)).alias("tp"), total((F.col("p") == label) & (F.col("t") != label)).alias("fp"), total((F.col("t") == label) & (F.col("p") != label)).alias("fn")
    )
    return told.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def micro_precision(scores: DataFrame, leave_out: str = "noise") -> DataFrame:
    kept = scores.where(F.col("label") != leave_out)
    return kept.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("correct"), F.coalesce(F.sum(F.col("tp") + F.col("fp")), F.lit(0)).alias("predicted")).withColumn("precision", F.coalesce(F.try_divide("correct", "predicted"), F.lit(0.0)))


def calibration(items: DataFrame, golden_count: Column | None = None, thresholds=THRESHOLDS) -> DataFrame:
    """threshold, kept, correct, precision, recall of items (confidence, correct): one pass over the rows."""
    golden = golden_count if golden_count is not None else F.count_if("correct")
    confident = F.coalesce(F.col("confidence"), F.lit(0.0))
    parts = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(confident >= t).alias("kept"), F.count_if((confident >= t) & F.col("correct")).alias("correct"), golden.alias("golden")) for t in thresholds]
    rows = items.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return rows.select("threshold", "kept", "correct", F.round(F.try_divide("correct", "kept"), 3).alias("precision"), F.round(F.try_divide("correct", "golden"), 3).alias("recall"))


def hit_at_k(ranks: DataFrame, k: int = 3) -> DataFrame:
    """mode, questions, hits, mean_rank of rows (mode, question_id, rank); a missing rank counts as 99."""
    best = ranks.groupBy("mode", "question_id").agg(F.min("rank").alias("rank"))
    return best.groupBy("mode").agg(F.count("*").alias("questions"), F.count_if(F.col("rank") <= k).alias("hits"), F.avg(F.coalesce("rank", F.lit(NO_RANK))).alias("mean_rank"))


def expected_ranks(questions: DataFrame, segments: DataFrame, hits: DataFrame) -> DataFrame:
    """mode, question_id, source_rank, rank: where the expected source, and the expected segment, come among a question's hits.

    ``questions``: question_id, source_id, start_ts of the expected segment; ``hits``: mode, question_id, source_id, ref_id, rank.
    """
    expected = questions.join(segments.select("source_id", "start_ts", F.col("segment_id").alias("_wanted")), ["source_id", "start_ts"], "left")
    rows = expected.select("question_id", F.col("source_id").alias("_source"), "_wanted").join(hits, "question_id")
    at = lambda c: F.min(F.when(c, F.col("rank")))
    return rows.groupBy("mode", "question_id").agg(at(F.col("source_id") == F.col("_source")).alias("source_rank"), at(F.col("ref_id") == F.col("_wanted")).alias("rank"))


def decision_scores(golden: DataFrame, decisions: DataFrame) -> DataFrame:
    """Of golden items (golden_id, quote, deferred): decided ones, those found by an overlapping quote, and deferred ones that were recorded."""
    # both sides are hand-labelled sets of one run
    met = golden.join(decisions.select(F.col("quote").alias("_quote"), "source_id"), "source_id").where(quotes_overlap(F.col("quote"), F.col("_quote"))).select("golden_id").distinct()
    rows = golden.join(met.withColumn("_found", F.lit(True)), "golden_id", "left")
    found, deferred = F.coalesce("_found", F.lit(False)), F.col("deferred")
    told = rows.agg(F.count_if(~deferred).alias("decided"), F.count_if(~deferred & found).alias("found"), F.count_if(deferred).alias("deferred"), F.count_if(deferred & found).alias("deferred_recorded"))
    return told.withColumn("recall", F.coalesce(F.try_divide("found", "decided"), F.lit(0.0)))


def owner_scores(matched: DataFrame) -> DataFrame:
    """Owners of matched pairs (golden_owner, owner): accuracy for named ones, abstentions kept."""
    named = F.col("golden_owner") != UNSPECIFIED
    same = F.lower(F.trim("golden_owner")) == F.lower(F.trim("owner"))
    return matched.agg(F.count_if(named).alias("named"), F.count_if(named & same).alias("named_right"), F.count_if(~named).alias("unspecified"), F.count_if(~named & (F.col("owner") == UNSPECIFIED)).alias("unspecified_kept"))


def date_scores(matched: DataFrame) -> DataFrame:
    """Invented dates of (golden_due, due_date, date_type, stated): one where truth has none, or without stated words."""
    has = F.col("due_date") != UNSPECIFIED
    invented = has & ((F.col("golden_due") == UNSPECIFIED) | (F.coalesce(F.trim("stated"), F.lit("")) == ""))
    return matched.agg(F.count_if(invented).alias("invented"), F.count_if(F.col("date_type") == "relative_resolved").alias("resolved"))


def severity_defensible(risks: DataFrame) -> DataFrame:
    """High risks, and those whose quote names a consequence."""
    words = F.array(*[F.lit(w) for w in CONSEQUENCES])
    high = F.col("severity") == "high"
    return risks.agg(F.count_if(high).alias("high"), F.count_if(high & F.exists(words, lambda w: F.contains(F.lower("quote"), w))).alias("defensible"))


def direct_message_leaks(stored: DataFrame, excluded: DataFrame) -> DataFrame:
    """Stored messages that had to be left out; null if nothing is stored, as that proves nothing."""
    private = excluded.select("id").distinct().withColumn("_private", F.lit(True))
    marked = stored.select("id").join(private, "id", "left")
    return marked.agg(F.count("*").alias("stored"), F.when(F.count("*") > 0, F.count("_private")).alias("leaks"))


def run_spread(runs: DataFrame) -> DataFrame:
    """Spread of metrics (case, run, measured) over runs."""
    return runs.groupBy("case").agg(
        F.count("*").alias("runs"), F.min("measured").alias("lowest"), F.max("measured").alias("highest"), (F.max("measured") - F.min("measured")).alias("spread"), (F.countDistinct("measured") == 1).alias("stable")
    )


def publishable(embedder: str, complete: bool, cases: set[str], stored_cases: set[str], sources: set[str], stored_sources: set[str]) -> str | None:
    """Why results may not replace stored ones, or None."""
    if embedder in ("hashing", "fake"):
        return "a stand-in made these results"
    if not complete:
        return "the run is incomplete"
    if stored_cases - cases:
        return f"cases missing: {sorted(stored_cases - cases)}"
    return "other sources" if stored_sources and sources != stored_sources else None
