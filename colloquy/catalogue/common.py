"""Tables that stand for the data model's, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.sources.tables import json_text, table

#: Segments as SQL.
SEG = r"""
raw as (select conv_id, turn, role, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) as text from conversations),
seg as (select conv_id as source_id, turn as segment_index, role as speaker, text,
  cast(coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as char_start
  from raw where text <> ''),
texts as (select source_id, string_agg(text, ' ' order by segment_index) as source_text from seg group by source_id)
"""

#: Reviewable items made of documents, as SQL.
ITEMS = """
items as (select doc_id as id, source as scope_key, text, n_chars as char_start,
  case doc_id % 4 when 0 then 'action' when 1 then 'decision' when 2 then 'risk' else 'signal' end as kind,
  case doc_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as severity,
  case when doc_id % 5 = 0 then 'UNSPECIFIED' else 'Person' || cast(doc_id % 7 as varchar) || ' ' || lang end as owner,
  case when doc_id % 10 = 0 then 'UNSPECIFIED' else '2024-02-01' end as due_date,
  case doc_id % 3 when 0 then 'blocker' when 1 then 'request' else 'question' end as classification,
  doc_id % 6 <> 0 as quote_verified, (doc_id % 11) / 10.0 as confidence,
  case when doc_id % 7 < 4 then 'approved' when doc_id % 7 = 4 then 'pending' when doc_id % 7 = 5 then 'rejected' else 'expired' end as status,
  date '2024-01-01' + cast(doc_id % 30 as integer) as approved_on from documents)
"""


def items(spark, sf_dir):
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.when(n % 4 == 0, "action").when(n % 4 == 1, "decision").when(n % 4 == 2, "risk").otherwise("signal")
    owner = F.when(n % 5 == 0, "UNSPECIFIED").otherwise(F.concat(F.lit("Person"), (n % 7).cast("string"), F.lit(" "), F.col("lang")))
    due = F.when(n % 10 == 0, "UNSPECIFIED").otherwise("2024-02-01")
    severity = F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low")
    label = F.when(n % 3 == 0, "blocker").when(n % 3 == 1, "request").otherwise("question")
    payload = F.when(kind == "risk", json_text(severity=severity)).when(kind == "signal", json_text(classification=label)).otherwise(json_text(owner=owner, due_date=due))
    status = F.when(n % 7 < 4, "approved").when(n % 7 == 4, "pending").when(n % 7 == 5, "rejected").otherwise("expired")
    return d.select(
        n.alias("id"), F.col("source").alias("scope_key"), "text", F.col("n_chars").alias("char_start"), kind.alias("extraction_type"), payload.alias("payload"), owner.alias("owner"),
        (n % 6 != 0).alias("quote_verified"), ((n % 11) / 10.0).alias("confidence"), status.alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 30).cast("int")).alias("approved_on"),
    )


#: Review events made of events, as SQL: an item a user and hour, events in order.
REVIEWS = """
ev as (select user_id as extraction_id, event_id as seq, ts as created_at,
  case event_id % 5 when 0 then 'created' when 1 then 'edited' when 2 then 'approved' when 3 then 'rejected' else 'expired' end as event_type,
  case when event_id % 13 = 0 then '' else event_type end as actor, event_id % 3 = 0 as override, case when event_id % 4 = 0 then null else 'note' end as note,
  user_id % 4 <> 0 as quote_verified from events)
"""


def reviews(spark, sf_dir):
    n = F.col("event_id")
    kind = F.when(n % 5 == 0, "created").when(n % 5 == 1, "edited").when(n % 5 == 2, "approved").when(n % 5 == 3, "rejected").otherwise("expired")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("extraction_id"), n.alias("seq"), F.col("ts").alias("created_at"), kind.alias("event_type"),
        F.when(n % 13 == 0, "").otherwise(F.col("event_type")).alias("actor"), (n % 3 == 0).alias("override"), F.when(n % 4 != 0, "note").alias("note"),
    )


def reviewed(spark, sf_dir):
    """The extractions that the events are about."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return users.select("id", F.lit("pending").alias("status"), (F.col("id") % 4 != 0).alias("quote_verified"))


class Register:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
