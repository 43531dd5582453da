"""Clock strings and due dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import UNSPECIFIED, let

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
UNITS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth"]
TEENS = ["tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth"]
WORD_NUMBERS = {"a": 1, "one": 1, "two": 2, "three": 3, "four": 4}

# Phrases that sound like a date and are none.
UNRESOLVABLE = [
    "soon", "shortly", "asap", "as soon as possible", "later", "eventually",
    "early", "mid", "late", "next sprint", "this sprint", "next quarter",
    "end of quarter", "before the audit", "after the audit", "next release",
]


def ordinal_words() -> list[tuple[str, int]]:
    """Spoken days of the month, longest first, so that "twenty-first" is 21 and not 1."""
    words = [(w, k + 1) for k, w in enumerate(UNITS)] + [(w, k + 10) for k, w in enumerate(TEENS)] + [("twentieth", 20), ("thirtieth", 30)]
    for tens, base, last in (("twenty", 20, 9), ("thirty", 30, 1)):
        words += [(f"{tens}{sep}{w}", base + k + 1) for k, w in enumerate(UNITS[:last]) for sep in ("-", " ")]
    return sorted(words, key=lambda x: -len(x[0]))


def parse_timestamp(x: Column) -> Column:
    """Seconds of [H:]MM:SS[.mmm] or of a bare number; null if unreadable, negative or out of range."""
    t = F.trim(x)
    clock = r"^(?:(\d{1,2}):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, clock, k), F.lit("")), F.lit("0"))
    h, m, s = (part(k).try_cast("int") for k in (1, 2, 3))
    ms = F.rpad(part(4), 3, "0").try_cast("int")
    number = t.try_cast("double")
    return F.when(t.rlike(clock), F.when((m <= 59) & (s <= 59), h * 3600 + m * 60 + s + ms / 1000.0)).otherwise(F.when(number >= 0, number))


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS, fractions cut off."""
    n = F.floor(seconds).cast("long")
    return F.when(seconds >= 0, F.format_string("%02d:%02d:%02d", F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60))


def normalise_timestamp(x: Column) -> Column:
    return let(parse_timestamp(x), lambda s: F.struct(format_timestamp(s).alias("ts"), s.alias("seconds")))


def friday_of_week(d: Column, weeks: int = 0) -> Column:
    return F.date_add(F.trunc(d, "week").cast("date"), 4 + 7 * weeks)


def next_weekday(d: Column, weekday: str) -> Column:
    """The first such weekday after ``d``."""
    return F.next_day(d, weekday[:3])


def _has(x: Column, phrase: str) -> Column:
    return x.rlike(rf"\b{phrase}\b")


def _chain(cases: list[tuple[Column, Column]], other: Column) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(other)


def resolve_due_date(stated: Column, meeting_date: Column) -> Column:
    """(value, date_type, stated_text, rule) of what a source said about a date.

    Rules in order, the first that fits: nothing stated; no date to anchor on; an ISO date, as it is
    written; a month with a day, in the first year where it is not past; phrases that are no date;
    tomorrow; today; next week; this week; end of the month; in N days, weeks or months of 30 days; a
    weekday.  A stated year next to a month is ignored, and a day that the month lacks in the meeting's
    year is not looked for in the next.
    """
    raw = F.trim(stated)
    low = F.regexp_replace(F.lower(raw), r"^[ .,]+|[ .,]+$", "")
    inputs = F.struct(raw.alias("raw"), low.alias("low"), meeting_date.cast("date").alias("d"))
    return let(inputs, lambda x: let(_named_parts(x), lambda p: _due_date(x["raw"], x["low"], x["d"], p)))


def _named_parts(x: Column) -> Column:
    """Month, day of the month, and a span's number and unit, as far as the words name them."""
    low = x["low"]
    # full names before short ones; "may" is both
    month = F.coalesce(*[F.when(_has(low, name), F.lit(k + 1)) for k, name in enumerate(MONTHS)], *[F.when(_has(low, name[:3]), F.lit(k + 1)) for k, name in enumerate(MONTHS)])
    numeric = F.regexp_extract(F.regexp_replace(low, r"\b(19|20)\d{2}\b", ""), r"\b(\d{1,2})(?:st|nd|rd|th)?\b", 1).try_cast("int")
    day = F.coalesce(*[F.when(_has(low, w), F.lit(k)) for w, k in ordinal_words()], numeric)
    span = r"\bin\s+(\d+|a|one|two|three|four)\s+(day|week|month)s?\b"
    return F.struct(month.alias("month"), day.alias("day"), F.regexp_extract(low, span, 1).alias("token"), F.regexp_extract(low, span, 2).alias("unit"))


def _due_date(raw: Column, low: Column, d: Column, parts: Column) -> Column:
    none = F.lit(None).cast("string")

    def told(value: Column, kind: str, rule: str) -> Column:
        return F.struct(value.cast("string").alias("value"), F.lit(kind).alias("date_type"), raw.alias("stated_text"), F.lit(rule).alias("rule"))

    def unresolved(rule: str) -> Column:
        return told(F.lit(UNSPECIFIED), "unspecified", rule)

    def resolved(value: Column, rule: str) -> Column:
        return told(value, "relative_resolved", rule)

    iso = F.regexp_extract(low, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    month, day, token, unit = (parts[c] for c in ("month", "day", "token", "unit"))
    named = lambda shift: F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(d) + shift, month, day), "yyyy-MM-dd")
    this_year = named(0)
    calendar = F.when(month.isNotNull() & day.between(1, 31) & this_year.isNotNull(), F.when(this_year >= d, this_year).otherwise(named(1)))
    count = F.coalesce(*[F.when(token == w, F.lit(n)) for w, n in WORD_NUMBERS.items()], token.try_cast("int"))
    days = count * F.when(unit == "day", 1).when(unit == "week", 7).otherwise(30)
    nothing = F.struct(F.lit(UNSPECIFIED).alias("value"), F.lit("unspecified").alias("date_type"), none.alias("stated_text"), none.alias("rule"))
    cases = [
        (raw.isNull() | (raw == "") | (raw == UNSPECIFIED), nothing),
        (d.isNull(), unresolved("no meeting date")),
        (iso != "", told(iso, "absolute", "ISO date")),
        (calendar.isNotNull(), told(calendar, "absolute", "calendar date")),
        (low.rlike(r"\b(?:" + "|".join(UNRESOLVABLE) + r")\b"), unresolved("approximate phrase")),
        (low.contains("tomorrow"), resolved(F.date_add(d, 1), "tomorrow")),
        (low.rlike(r"\btoday\b|\bend of (the )?day\b|\beod\b"), resolved(d, "today")),
        (_has(low, "next week"), resolved(friday_of_week(d, 1), "next week")),
        (low.rlike(r"\b(this|the) week\b|\bend of week\b"), resolved(friday_of_week(d), "this week")),
        (low.rlike(r"\bend of (the )?month\b"), resolved(F.last_day(d), "end of month")),
        (token != "", resolved(F.date_add(d, days), "in N units")),
        *[(_has(low, w), resolved(F.date_add(next_weekday(d, w), F.when(low.contains("next"), 7).otherwise(0)), "weekday")) for w in WEEKDAYS],
    ]
    return _chain(cases, unresolved("no rule"))
