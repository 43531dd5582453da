"""The agent's tools as reads over DataFrames, inside a scope that can be narrowed and never widened."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators import relational as rel
from colloquy.operators import review
from colloquy.plans import retrieval
from colloquy.plans.extraction import propose_actions

#: Most characters of an observation.
OBSERVATION = 4000


class OutOfScope(ValueError):
    pass


def trim_observation(text: Column, most: int = OBSERVATION) -> Column:
    """The beginning of a long text, and how much of it is left out."""
    rest = F.length(text) - most
    return F.when(rest > 0, F.concat(F.left(text, F.lit(most)), F.format_string("\n(%d characters more)", rest))).otherwise(text)


def slice_rows(df: DataFrame, position: str, start: int, count: int) -> DataFrame:
    """Rows ``start`` to ``start + count`` by a dense position that counts from 0."""
    return df.where(F.col(position).between(start, start + count - 1))


@dataclass
class Toolbelt:
    """Tables that a run may read, its ceiling (None: every source) and its focus inside it.

    Every tool returns rows with a ``line``; ``observe`` makes the bounded text of them that a model is shown.
    """

    sources: DataFrame
    segments: DataFrame
    extractions: DataFrame
    messages: DataFrame
    tracker: DataFrame
    ceiling: frozenset | None = None
    focus: frozenset | None = field(default=None, init=False)

    @property
    def scope(self) -> frozenset | None:
        return self.focus or self.ceiling

    def _inside(self, df: DataFrame) -> DataFrame:
        return df.where(rel.in_scope("source_id", sorted(self.scope))) if self.scope else df

    def _admit(self, source_id: str) -> None:
        if self.scope is not None and source_id not in self.scope:
            raise OutOfScope(f"{source_id} lies outside {sorted(self.scope)}")

    def focus_on(self, source_id: str) -> None:
        """Narrow later reads to one source; an empty id goes back to the ceiling."""
        if not source_id.strip():
            self.focus = None
            return
        if self.ceiling is not None and source_id not in self.ceiling:
            raise OutOfScope(f"{source_id} lies outside {sorted(self.ceiling)}")
        if self.sources.where(F.col("source_id") == source_id).isEmpty():
            raise OutOfScope(f"there is no source {source_id}")
        self.focus = frozenset({source_id})

    def list_sources(self) -> DataFrame:
        rows = self._inside(self.sources)
        return rows.select("source_id", F.concat_ws(" | ", "source_id", "source_type", "status", "title", F.col("meeting_date").cast("string")).alias("line"))

    def search_transcripts(self, question: str, limit: int = 6) -> DataFrame:
        hits = retrieval.keyword_search(self.segments, self.extractions, question, limit, self.scope, sources=self.sources)
        cited = retrieval.hydrate(hits, self.segments, self.extractions, self.sources)
        return cited.withColumn("line", F.concat(F.lit("["), F.col("keyword_rank").cast("string"), F.lit("] "), F.coalesce("title", "source_id"), F.lit(": "), F.col("text")))

    def read_transcript(self, source_id: str, start: int = 0, count: int = 20) -> DataFrame:
        self._admit(source_id)
        rows = slice_rows(self.segments.where(F.col("source_id") == source_id), "segment_index", start, count)
        return rows.select("source_id", "segment_index", F.concat(F.lit("["), F.col("segment_index").cast("string"), F.lit("] "), F.coalesce("speaker", F.lit("nobody named")), F.lit(": "), F.col("text")).alias("line"))

    def list_extractions(self, source_id: str | None = None, extraction_type: str | None = None, status: str | None = None) -> DataFrame:
        if source_id:
            self._admit(source_id)
        rows = self._inside(self.extractions.where(rel.all_of(source_id=source_id or None, extraction_type=extraction_type or None, status=status or None)))
        return rows.select("id", "source_id", "extraction_type", "status", F.concat_ws(" | ", "id", "extraction_type", "status", F.left("payload", F.lit(180))).alias("line"))

    def review_summary(self) -> DataFrame:
        return review.summary(self.extractions)

    def search_chat(self, query: str, limit: int = 10) -> DataFrame:
        rows = self._inside(self.messages)
        return retrieval.chat_search(rows, query, limit).withColumn("line", F.concat_ws(" | ", "ref_id", F.concat(F.lit("#"), "channel"), "text"))

    def read_chat(self, channel: str | None = None, classification: str | None = None, limit: int = 30) -> DataFrame:
        rows = self._inside(self.messages).where(rel.all_of(channel=channel or None, classification=classification or None))
        kept = rel.top_k(rows, limit, F.col("ts").asc(), F.col("id").asc())
        return kept.select("id", "channel", F.concat_ws(" | ", "id", F.concat(F.lit("#"), "channel"), "author", F.coalesce("classification", F.lit("unclassified")), "text").alias("line"))

    def answer(self, claims: DataFrame, question: str, limit: int = 8) -> DataFrame:
        """Claims of a model (source_number, quote, text) that hold, against the passages found for a question."""
        hits = self.search_transcripts(question, limit).withColumn("position", F.col("keyword_rank"))
        return retrieval.verified_claims(claims, hits)

    def list_tracker(self) -> DataFrame:
        return self.tracker.select("external_ref", F.concat_ws(" | ", "external_ref", F.coalesce("assignee", F.lit("unassigned")), "status", "title").alias("line"))

    def propose(self, proposals: DataFrame, now) -> tuple[DataFrame, DataFrame]:
        """(pending actions, refused proposals); nothing else here writes."""
        return propose_actions(proposals, self.segments, now, self.scope)


def observe(rows: DataFrame, *order: Column, most: int = OBSERVATION) -> str:
    """The lines of a tool's rows, trimmed.  Every line has a character at least, so ``most`` rows are enough."""
    top = rows.orderBy(*order).limit(most).select("line").collect()
    text = "\n".join(r["line"] for r in top)
    return text if len(text) <= most else f"{text[:most]}\n({len(text) - most} characters more)"
