"""Extraction: prompts, a plug-in model with cache and repair, grounding, dedup, pending items."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions.dates import resolve_due_date
from colloquy.operators.grouped import chunk_segments, greedy_dedup
from colloquy.operators.review import TTL_HOURS, with_expiry
from colloquy.operators.segments import point_in_segment, source_texts

# --- prompts -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Prompt:
    name: str
    version: str
    body: str

    @property
    def version_tag(self) -> str:
        """Version and beginning of the body's hash: an edit without a new version shows."""
        return f"{self.version}+{hashlib.sha256(self.body.encode()).hexdigest()[:6]}"

    def render(self, **values) -> str:
        return self.body.format(**values)


def parse_prompt(name: str, raw: str) -> Prompt:
    """A prompt file: "key: value" lines, a line of dashes, the body; without header, all is body."""
    head, found, body = raw.partition("\n---\n")
    header = dict(re.findall(r"(?m)^#?\s*(\w+)\s*:\s*(.+?)\s*$", head)) if found else {}
    body = (body if found else raw).strip()
    if not body:
        raise ValueError(f"prompt {name} has no body")
    return Prompt(name, header.get("version", "0"), body)


def chunk_context(title: Column, meeting_date: Column, participants: Column) -> Column:
    """What a chunk's prompt says of its meeting; not to be quoted."""
    return F.concat_ws(
        "\n", F.lit("CONTEXT (background, not to be quoted)"), F.concat(F.lit("  Meeting: "), title), F.concat(F.lit("  Date: "), F.coalesce(meeting_date.cast("string"), F.lit("not stated"))),
        F.concat(F.lit("  Participants: "), F.when(F.size(participants) > 0, F.array_join(participants, ", ")).otherwise("not stated")), F.concat(F.lit("  Chunk: "), (F.col("chunk_index") + 1).cast("string"), F.lit(" of "), F.col("total").cast("string")),
    )


# --- models ------------------------------------------------------------------------------------

Provider = Callable[[str], str]
#: From a parsed answer and the request's source text to what is wrong with it, or None.
Validator = Callable[[object, str], str | None]
CALLS = "key string, response string, cache_hit boolean, attempts array<struct<attempt:int,outcome:string,error:string>>"


def request_key(provider: str, model: str, prompt: Column, version: str) -> Column:
    """Content address of a request."""
    return F.sha2(F.to_json(F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(version).alias("version"))).cast("binary"), 256)


def call_structured(requests: DataFrame, provider: Provider, validate: Validator, cache: DataFrame | None = None, retries: int = 3) -> DataFrame:
    """Answers (key, response, cache_hit, attempts) to requests (key, prompt, source_text).

    Answers in ``cache`` (key, response) are not asked for.  An answer that is no JSON, or that ``validate``
    objects to, is asked for again with the objection; after ``retries`` attempts response is null.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                attempts, answer, prompt = [], None, r.prompt
                for k in range(1, retries + 1):
                    outcome, error = "ok", None
                    try:
                        raw = provider(prompt)
                        fenced = re.fullmatch(r"(?s)\s*```(?:json)?\s*(.*?)\s*```\s*", raw)
                        value = json.loads(fenced[1] if fenced else raw)
                        error = validate(value, r.source_text)
                        outcome = "quote_unverified" if error else "ok"
                    except json.JSONDecodeError as e:
                        outcome, error = "parse_error", f"no valid JSON: {e.msg}"
                    except Exception as e:  # noqa: BLE001 - a provider may fail in any way; the attempt is recorded
                        outcome, error = "error", str(e)
                    attempts.append({"attempt": k, "outcome": outcome, "error": error})
                    if outcome == "ok":
                        answer = json.dumps(value)
                        break
                    prompt = f"{r.prompt}\n\nYour last answer was refused: {error}\nAnswer again."
                rows.append((r.key, answer, False, attempts))
            yield pd.DataFrame(rows, columns=["key", "response", "cache_hit", "attempts"])

    if cache is None:
        return requests.mapInPandas(ask, CALLS)
    known = requests.select("key").join(cache.select("key", "response"), "key")
    hits = known.select("key", "response", F.lit(True).alias("cache_hit"), F.array(F.struct(F.lit(1).alias("attempt"), F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("error"))).alias("attempts"))
    return hits.unionByName(requests.join(cache.select("key"), "key", "left_anti").mapInPandas(ask, CALLS))


def telemetry(calls: DataFrame, purpose: str) -> DataFrame:
    """One row for each attempt."""
    return calls.select(F.col("key").alias("call_id"), F.lit(purpose).alias("purpose"), "cache_hit", F.explode("attempts").alias("a")).select("call_id", "purpose", "cache_hit", "a.*")


def quotes_are_literal(field: str, quote: str = "verbatim_quote") -> Validator:
    """Objects to an answer of which a quote is not in its source text, and tells how far it agrees."""

    def check(value: object, source_text: str) -> str | None:
        for item in value.get(field, []) if isinstance(value, dict) else []:
            q = " ".join(str(item.get(quote, "")).split())
            if not q or q not in source_text:
                n = next((k for k in range(min(len(q), 200), 11, -1) if q[:k] in source_text), 0)
                return f"the quote {q!r} is not in the transcript" + (f"; only {q[:n]!r} agrees" if n else "")
        return None

    return check


# --- specs and the pipeline --------------------------------------------------------------------


@dataclass(frozen=True)
class ExtractionSpec:
    """What one kind of extraction reads from an answer's items."""

    kind: str
    field: str
    task: str
    owner: str | None = None
    #: Whether equal owner and task make duplicates anywhere in the meeting.
    owner_rule: bool = True


ACTIONS = ExtractionSpec("action", "actions", "what", "owner")
DECISIONS = ExtractionSpec("decision", "decisions", "what_was_decided", "who_stated_it")
RISKS = ExtractionSpec("risk", "risks", "description", "owner", owner_rule=False)


def payload_of(spec: ExtractionSpec, meeting_date: Column) -> Column:
    """The stored payload of an item (a map of strings); actions carry their resolved date."""
    item = F.col("item")
    if spec.kind != "action":
        return F.to_json(item)
    due = resolve_due_date(F.try_element_at(item, F.lit("due_date")), meeting_date)
    get = lambda k: tx.collapse_abstention(F.coalesce(F.try_element_at(item, F.lit(k)), F.lit("")))
    return F.to_json(F.struct(F.try_element_at(item, F.lit("what")).alias("what"), get("owner").alias("owner"), due["value"].alias("due_date"), due["date_type"].alias("due_date_type"), due["stated_text"].alias("due_date_stated"), due["rule"].alias("due_date_rule")))


def chunk_requests(segments: DataFrame, sources: DataFrame, prompt: Prompt, provider: str = "plugin", model: str = "model") -> DataFrame:
    """A request for each chunk of consenting sources: source_id, chunk_id, key, prompt, source_text."""
    agreed = sources.where(F.col("consent_flag").eqNullSafe(True) & (F.col("status") == "ingested"))
    chunks = chunk_segments(segments.join(agreed.select("source_id"), "source_id", "left_semi"))
    rows = chunks.join(agreed.select("source_id", "title", "meeting_date", "participants"), "source_id").join(source_texts(segments), "source_id")
    body = F.concat(F.lit(prompt.body + "\n\n"), chunk_context(F.col("title"), F.col("meeting_date"), F.col("participants")), F.lit("\n\nTRANSCRIPT CHUNK\n"), F.col("text"))
    return rows.select("source_id", "chunk_id", request_key(provider, model, body, prompt.version_tag).alias("key"), body.alias("prompt"), "source_text")


def run_extraction(segments: DataFrame, sources: DataFrame, requests: DataFrame, answers: DataFrame, spec: ExtractionSpec, now, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Pending extractions of answered requests: each item grounded by itself, duplicates absorbed."""
    schema = f"struct<{spec.field}:array<map<string,string>>>"
    items = requests.join(answers.where("response is not null").select("key", "response"), "key")
    items = items.select("source_id", "chunk_id", "source_text", F.posexplode(F.from_json("response", schema)[spec.field]).alias("n", "item"))
    get = lambda k: F.try_element_at(F.col("item"), F.lit(k))
    confidence = get("confidence").try_cast("double")
    grounded = items.select(
        "source_id", "item", F.concat_ws("#", "chunk_id", F.format_string("%04d", "n")).alias("key"), get("verbatim_quote").alias("quote"), F.coalesce(get(spec.task), F.lit("")).alias("task"),
        tx.collapse_abstention(F.coalesce(get(spec.owner) if spec.owner else F.lit(""), F.lit(""))).alias("owner"), confidence.alias("confidence"), tx.locate_quote(get("verbatim_quote"), F.col("source_text")).alias("at"),
    ).withColumns({"extraction_type": F.lit(spec.kind), "char_start": F.col("at.char_start"), "char_end": F.col("at.char_end")})
    kept = greedy_dedup(grounded.select("source_id", "extraction_type", "key", "quote", "task", "owner", "confidence", "char_start", "char_end"), spec.owner_rule)
    rows = grounded.join(kept.where("key = survivor_key").select("source_id", "key"), ["source_id", "key"]).join(sources.select("source_id", "meeting_date"), "source_id")
    placed = point_in_segment(rows.where("char_start is not null").select("source_id", "key", "char_start"), segments).select("source_id", "key", "segment_id")
    payload = payload_of(spec, F.col("meeting_date"))
    done = rows.join(placed, ["source_id", "key"], "left").select(
        F.concat_ws("::", "source_id", "extraction_type", F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 8)).alias("id"), "source_id", "extraction_type", payload.alias("payload"), payload.alias("original_payload"),
        F.col("quote").alias("verbatim_quote"), F.col("at").isNotNull().alias("quote_verified"), "char_start", "char_end", "segment_id", "confidence", F.lit("pending").alias("status"), F.lit(now).alias("created_at"),
        tx.dedup_key(F.coalesce("quote", F.lit("")), F.col("task")).alias("dedup_key"),
    )
    return with_expiry(done, ttl_hours)


def replace_pending(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with the pending rows of the sources and kinds in ``new`` replaced; decided ones stay."""
    again = new.select("source_id", "extraction_type").distinct().withColumn("_again", F.lit(True))
    kept = stored.join(again, ["source_id", "extraction_type"], "left").where((F.col("status") != "pending") | F.col("_again").isNull()).drop("_again")
    return kept.unionByName(new, allowMissingColumns=True)


def run_counts(extractions: DataFrame) -> DataFrame:
    owner, due, kind = (F.get_json_object("payload", f"$.{k}") for k in ("owner", "due_date", "due_date_type"))
    return extractions.agg(
        F.count_if("quote_verified").alias("verified"), F.count_if(~F.col("quote_verified")).alias("unverified"), F.count_if(owner == tx.UNSPECIFIED).alias("unspecified_owner"),
        F.count_if(due == tx.UNSPECIFIED).alias("unspecified_date"), F.count_if(kind == "relative_resolved").alias("dates_resolved"),
    )


def propose_actions(proposals: DataFrame, segments: DataFrame, now, scope=None) -> tuple[DataFrame, DataFrame]:
    """(pending actions, refused proposals): proposals (source_id, what, quote, owner) need a quote of their source."""
    rows = proposals.join(source_texts(segments), "source_id", "left").withColumn("at", tx.locate_quote(F.col("quote"), F.col("source_text")))
    inside = F.col("source_id").isin(list(scope)) if scope else F.lit(True)
    reason = F.when(~inside, "outside the scope").when(F.col("source_text").isNull(), "no such source").when(F.col("at").isNull(), "the quote is not in the source")
    judged = rows.withColumn("reason", reason)
    owner = F.coalesce(F.nullif(F.trim("owner"), F.lit("")), F.lit(tx.UNSPECIFIED))
    payload = F.to_json(F.struct("what", owner.alias("owner"), F.lit(tx.UNSPECIFIED).alias("due_date"), F.lit("agent").alias("proposed_by")))
    good = judged.where("reason is null").select(
        F.concat_ws("::", "source_id", F.lit("action"), F.substring(tx.dedup_key(F.col("quote"), F.col("what")), 1, 8)).alias("id"), "source_id", F.lit("action").alias("extraction_type"), payload.alias("payload"),
        F.col("quote").alias("verbatim_quote"), F.lit(True).alias("quote_verified"), F.col("at.char_start").alias("char_start"), F.col("at.char_end").alias("char_end"), F.lit(0.5).alias("confidence"), F.lit("pending").alias("status"), F.lit(now).alias("created_at"),
    )
    return with_expiry(good), judged.where("reason is not null").select("source_id", "what", "quote", "reason")
