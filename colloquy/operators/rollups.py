"""Roll-ups of approved items: channel digests, people, outcome records, follow-ups, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions.names import nfkc
from colloquy.functions.text import UNSPECIFIED
from colloquy.operators.relational import ranked_in_buckets

SECTIONS = (("attention", 2), ("to_decide", 1), ("moved", 3))
FOLLOWUP_SECTIONS = (("action", "commitments", "What people committed to"), ("decision", "decisions", "What was decided"), ("risk", "risks", "Risks and blockers raised"))


def _field(key: str) -> Column:
    return F.get_json_object("payload", f"$.{key}")


def digest_sections(items: DataFrame, day) -> DataFrame:
    """Digest lines (scope_key, id, section, position, because) of approved items of a day.

    ``items``: scope_key, id, extraction_type, payload, quote_verified, confidence, char_start,
    approved_on.  Attention takes two: high risks and blockers, medium risks, actions without owner.  Of
    the rest, one to decide: an action without owner and date, else a request.  Of the rest, three that
    moved: approved on the day or, only if there are none, the last approved.  Ties go by queue order.
    """
    order = [F.col("quote_verified").asc(), F.col("confidence").desc(), F.col("char_start").asc(), F.col("id").asc()]
    severity, owner, due, kind = _field("severity"), _field("owner"), _field("due_date"), _field("classification")
    is_risk, is_action = F.col("extraction_type") == "risk", F.col("extraction_type") == "action"
    urgency = (
        F.when(is_risk & (severity == "high"), 0).when(is_risk & (severity == "medium"), 1).when(is_risk, None)
        .when(kind == "blocker", 0).when(is_action & (owner == UNSPECIFIED), 2)
    )
    why = F.when(is_risk, F.concat(severity, F.lit(" severity risk"))).when(kind == "blocker", F.lit("blocker")).otherwise(F.lit("action without owner"))
    rows = items.withColumns({"urgency": urgency, "why": why, "choice": F.when(is_action & (owner == UNSPECIFIED) & (due == UNSPECIFIED), 0).when(kind == "request", 1)})

    # the filter on a row number lets every task keep n rows of a scope before they meet
    def pick(df: DataFrame, condition: Column, n: int, *first: Column) -> DataFrame:
        w = Window.partitionBy("scope_key").orderBy(*first, *order)
        return df.where(condition).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)

    one = pick(rows, F.col("urgency").isNotNull(), 2, F.col("urgency")).select("scope_key", "id", F.lit("attention").alias("section"), "position", F.col("why").alias("because"))
    rest = rows.join(one.select("scope_key", "id"), ["scope_key", "id"], "left_anti")
    two = pick(rest, F.col("choice").isNotNull(), 1, F.col("choice")).select(
        "scope_key", "id", F.lit("to_decide").alias("section"), "position", F.when(F.col("choice") == 0, "no owner and no date").otherwise("open request").alias("because")
    )
    rest = rest.join(two.select("scope_key", "id"), ["scope_key", "id"], "left_anti")
    today = F.coalesce(F.col("approved_on") == F.lit(day).cast("date"), F.lit(False))
    marked = rest.withColumn("today", today)
    three = marked.join(marked.groupBy("scope_key").agg(F.max("today").alias("any_today")), "scope_key")
    three = pick(three, F.col("today") | ~F.col("any_today"), 3, F.when(F.col("today"), None).otherwise(F.col("approved_on")).desc_nulls_last()).select(
        "scope_key", "id", F.lit("moved").alias("section"), "position", F.when(F.col("today"), "approved today").otherwise("last approved").alias("because")
    )
    return one.unionByName(two).unionByName(three)


def digest_scopes(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """scope_key, scope_title: channels, and ingested transcripts as channels of their own."""
    channels = messages.select(F.col("channel").alias("scope_key"), F.concat(F.lit("#"), F.col("channel")).alias("scope_title")).distinct()
    meetings = sources.where("source_type = 'transcript' and status = 'ingested'").select(F.col("source_id").alias("scope_key"), F.col("title").alias("scope_title"))
    return channels.unionByName(meetings)


def in_channel(extractions: DataFrame, messages: DataFrame) -> DataFrame:
    """Approved signals with the channel of their message."""
    own = messages.select(F.col("id").alias("message_id"), F.col("channel").alias("scope_key")).distinct()
    return extractions.where("extraction_type = 'signal' and status = 'approved'").join(own, "message_id")


def person_groups(owners: DataFrame, participants: DataFrame | None = None, identity: str = "first_name") -> DataFrame:
    """People of owner strings (owner, seq): person_key, display_name, aliases in order, ambiguous, n_items.

    A common first name of many owners may be in a third of the rows: rows are first counted by owner.
    """
    counted = owners.groupBy("owner").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    counted = counted.withColumn("owner", nfkc("owner"))
    name = F.col("owner")
    keyed = counted.withColumns({"person_key": tx.person_key(name, identity), "alias": F.when(tx.is_unassigned(name), F.lit(UNSPECIFIED)).otherwise(tx.normalise_name(name))})
    aliases = keyed.groupBy("person_key", "alias").agg(F.min("seq").alias("seq"), F.sum("n").alias("n"))
    grouped = aliases.groupBy("person_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "alias"))), lambda x: x["alias"]).alias("aliases"), F.sum("n").alias("n_items"))
    if participants is None:
        known = grouped.withColumn("_names", F.array().cast("array<string>"))
    else:
        matching = participants.select(tx.person_key(F.col("participant"), identity).alias("person_key"), "participant").groupBy("person_key").agg(F.array_sort(F.collect_list("participant")).alias("_names"))
        known = grouped.join(matching, "person_key", "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))
    return known.select("person_key", tx.display_name(F.col("aliases"), F.col("_names"), F.col("person_key")).alias("display_name"), "aliases", tx.is_ambiguous(F.col("aliases")).alias("ambiguous"), "n_items")


def people_order() -> list[Column]:
    """By key, unassigned last."""
    return [(F.col("person_key") == "unassigned").asc(), F.col("person_key").asc()]


def person_digests(actions: DataFrame, titles: DataFrame, approvals: DataFrame, identity: str = "first_name") -> DataFrame:
    """Approved actions as lines of their people's digests: dated before undated, then by approval and id."""
    owner = F.coalesce(F.nullif(_field("owner"), F.lit("")), F.lit(UNSPECIFIED))
    due = F.coalesce(F.nullif(_field("due_date"), F.lit("")), F.lit(UNSPECIFIED))
    rows = actions.where("status = 'approved' and extraction_type = 'action'").join(titles.select("source_id", "title"), "source_id", "left")
    rows = rows.join(approvals.select(F.col("extraction_id").alias("id"), F.to_date("approved_at").alias("approved_on")), "id", "left")
    # names are put in their compatibility form once for each owner, not for each row
    keys = rows.select(owner.alias("owner_as_stated")).distinct().withColumn("person_key", tx.person_key(nfkc("owner_as_stated"), identity))
    rows = rows.select("id", tx.headline(F.col("payload"), F.col("verbatim_quote")).alias("text"), owner.alias("owner_as_stated"), due.alias("due_date"), "approved_on", "title").join(keys, "owner_as_stated")
    # undated lines, and later days, come behind: a person with very many lines is ranked day by day
    undated = F.col("due_date") == UNSPECIFIED
    day = F.concat(F.when(undated, "1").otherwise("0"), F.coalesce(F.col("approved_on").cast("string"), F.lit("")))
    return ranked_in_buckets(rows, ["person_key"], day, F.col("id"), name="position")


def citation(title: Column) -> Column:
    return F.struct("source_id", title.alias("source_title"), "segment_id", "message_id", "speaker", "timestamp", F.col("verbatim_quote").alias("quote"), "char_start", "char_end")


def outcome_records(extractions: DataFrame, sources: DataFrame, approvals: DataFrame) -> DataFrame:
    """One record for each consenting source: arrays of approved items by type, counts of what is left out."""
    kept = sources.where(F.col("consent_flag").eqNullSafe(True))
    rows = extractions.join(approvals, F.col("id") == F.col("extraction_id"), "left")
    item = F.struct(
        F.col("char_start").alias("at"), F.col("id"), F.col("payload"), F.col("verbatim_quote").alias("quote"), "speaker", "timestamp", "confidence", "approved_by", "approved_at",
        (~F.col("payload").eqNullSafe(F.col("original_payload"))).alias("edited_by_reviewer"),
    )
    of = lambda kind: F.array_sort(F.collect_list(F.when((F.col("status") == "approved") & (F.col("extraction_type") == kind), item))).alias(f"{kind}s")
    left_out = [F.count_if(F.col("status") == s).alias(f"{s}_not_included") for s in ("pending", "rejected", "expired")]
    told = rows.groupBy("source_id").agg(*[of(k) for k in ("action", "decision", "risk", "signal")], *left_out)
    return kept.select("source_id", "title", "meeting_date", "participants").join(told, "source_id", "left")


def followup_drafts(extractions: DataFrame, sources: DataFrame) -> DataFrame:
    """Recap of each source with approved actions, decisions or risks: subject, body, item_count."""
    rows = extractions.where("status = 'approved' and extraction_type in ('action', 'decision', 'risk')")
    owner = F.coalesce(F.nullif(_field("owner"), F.lit(UNSPECIFIED)), F.lit("assignee UNSPECIFIED, nobody was named"))
    due = F.coalesce(F.concat(F.lit("due "), F.nullif(F.nullif(_field("due_date"), F.lit(UNSPECIFIED)), F.lit(""))), F.lit("no date stated"))
    who = F.concat(F.coalesce("speaker", F.lit("unattributed")), F.coalesce(F.concat(F.lit(" at "), F.col("timestamp")), F.lit("")))
    line = F.concat_ws(
        "\n", F.concat(F.lit("- "), tx.headline(F.col("payload"), F.col("verbatim_quote"))), F.when(F.col("extraction_type") == "action", F.concat(F.lit("  "), owner, F.lit(" · "), due)),
        F.concat(F.lit('  > "'), F.col("verbatim_quote"), F.lit('"')), F.concat(F.lit("  — "), who),
    )
    rows = rows.withColumn("line", F.struct("char_start", "id", line.alias("text")))
    parts = rows.groupBy("source_id").agg(F.count("*").alias("item_count"), *[F.array_sort(F.collect_list(F.when(F.col("extraction_type") == kind, F.col("line")))).alias(section) for kind, section, _ in FOLLOWUP_SECTIONS])
    bodies = [F.when(F.size(section) > 0, F.concat(F.lit(f"## {heading}\n\n"), F.array_join(F.transform(section, lambda x: x["text"]), "\n"), F.lit("\n"))) for _, section, heading in FOLLOWUP_SECTIONS]
    held = F.coalesce(F.concat(F.lit("_Meeting held "), F.col("meeting_date").cast("string"), F.lit(". Drafted from approved items only._")), F.lit("_Drafted from approved items only._"))
    foot = F.concat(F.lit("---\n\n_Built from "), F.col("item_count").cast("string"), F.lit(" approved items. A person edits and sends this draft._"))
    body = F.concat_ws("\n", F.concat(F.lit("# Recap: "), F.col("title"), F.lit("\n")), F.concat(held, F.lit("\n")), *bodies, foot)
    return sources.join(parts, "source_id").select("source_id", F.concat(F.lit("Recap: "), F.col("title")).alias("subject"), body.alias("body"), "item_count", F.lit("draft").alias("status"))


def record_order() -> list[Column]:
    """Records by source, the newest version first."""
    return [F.col("source_id").asc(), F.col("record_version").desc()]


def digest_order() -> list[Column]:
    return [F.col("digest_date").desc(), F.col("scope_key").asc()]


def load_record(records: DataFrame, source_id: str, version: int | None = None) -> DataFrame:
    """One record of a source: a version of it, or the newest."""
    own = records.where(F.col("source_id") == source_id)
    own = own.where(F.col("record_version") == version) if version is not None else own
    return own.orderBy(*record_order()).limit(1)


def usage_summary(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Attempts, calls, cache hits, tokens, rates of model calls (call_id, outcome, cache_hit, input_tokens, output_tokens, latency_ms)."""
    grouped = calls.groupBy(*(keys or []))
    told = grouped.agg(
        F.count("*").alias("attempts"), F.countDistinct("call_id").alias("calls"), F.count_if("cache_hit").alias("cache_hits"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_ms"),
    )
    rate = lambda a: F.coalesce(F.try_divide(a, F.col("attempts")), F.lit(0.0))
    return told.withColumns({"cache_hit_rate": rate(F.col("cache_hits")), "retry_rate": rate(F.col("attempts") - F.col("calls"))})


def _cited(x: Column, note: Column) -> Column:
    """A line with its citation: text, quote, who and when."""
    who = F.coalesce(x["speaker"], F.lit("unattributed"))
    when = F.coalesce(F.concat(F.lit(" at "), x["timestamp"]), F.lit(""))
    return F.concat(F.lit("- "), x["text"], F.lit('\n  > "'), x["quote"], F.lit('"\n  — '), who, when, F.lit(" · "), note)


def render_digests(lines: DataFrame, scopes: DataFrame, day) -> DataFrame:
    """scope_key, markdown of each scope.  ``lines``: digest_sections() with text, quote, speaker, timestamp;
    a scope without lines says so."""
    line = F.struct("position", "text", "quote", "speaker", "timestamp", "because")
    parts = lines.groupBy("scope_key").agg(*[F.array_sort(F.collect_list(F.when(F.col("section") == name, line))).alias(name) for name, _ in SECTIONS])
    rows = scopes.join(parts, "scope_key", "left")
    titles = (("moved", "Moved", "Nothing moved."), ("attention", "Needs attention", "Nothing outstanding."), ("to_decide", "To decide", "Nothing waiting on a decision."))

    def section(name: str, title: str, blank: str) -> Column:
        body = F.array_join(F.transform(name, lambda x: _cited(x, x["because"])), "\n")
        return F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(name) > 0, body).otherwise(f"_{blank}_"), F.lit("\n"))

    body = F.when(F.col("moved").isNull(), F.lit("Nothing approved in scope for this day.")).otherwise(F.concat_ws("\n", *[section(*t) for t in titles]))
    return rows.select("scope_key", F.concat(F.lit("# "), F.col("scope_title"), F.lit(f" — {day}\n\n"), body).alias("markdown"))


def render_person_digests(lines: DataFrame, people: DataFrame, day) -> DataFrame:
    """person_key, markdown of each person with commitments.  ``lines``: person_digests() with quote, speaker, timestamp."""
    dated = F.col("due_date") != UNSPECIFIED
    line = F.struct("position", "text", "quote", "speaker", "timestamp", "owner_as_stated", "due_date")
    parts = lines.groupBy("person_key").agg(F.count("*").alias("n"), *[F.array_sort(F.collect_list(F.when(c, line))).alias(name) for name, c in (("dated", dated), ("undated", ~dated))])
    rows = people.join(parts, "person_key")
    owner = lambda x: F.when(F.col("person_key") == "unassigned", F.lit("assignee UNSPECIFIED")).otherwise(F.concat(F.lit("owner as stated: "), x["owner_as_stated"]))

    def section(name: str, title: str) -> Column:
        body = F.array_join(F.transform(name, lambda x: _cited(x, F.concat(F.lit("due "), x["due_date"], F.lit(", "), owner(x)))), "\n")
        return F.when(F.size(name) > 0, F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n")))

    grouped = F.when(F.col("ambiguous"), F.concat(F.lit("_Grouped by first name: "), F.array_join("aliases", ", "), F.lit("._\n")))
    head = F.concat(F.lit("# "), F.col("display_name"), F.lit(f" — {day}\n\n"), F.col("n").cast("string"), F.lit(" approved commitments.\n"))
    return rows.select("person_key", F.concat_ws("\n", head, grouped, section("dated", "With a date"), section("undated", "No date stated")).alias("markdown"))
