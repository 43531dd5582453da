"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A value, not a null: the source does not state this.
UNSPECIFIED = "UNSPECIFIED"

#: White space as str.split() has it; Java's \s alone misses some of it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

# Words that say nothing about which task is meant.
TASK_STOPWORDS = (
    "a an and are as at be by for from has have in into is it its of on or that the "
    "to with will shall should would need needs needed do does done make makes making "
    "get gets getting go goes going this these those their our his her they we you"
).split()

# Spellings of "not stated".
ABSTENTIONS = [
    "", "unspecified", "not specified", "none", "n/a", "na", "null",
    "unknown", "not stated", "not given", "none given", "none stated",
    "not applicable", "no reason given", "no rationale given", "no owner",
    "not mentioned", "not discussed", "tbd", "unclear",
]

# Headings that look like a speaker's label.
NOT_A_NAME = [
    "action", "actions", "agenda", "answer", "attendees", "background", "blocker",
    "blockers", "conclusion", "context", "decision", "decisions", "example", "follow",
    "issue", "issues", "item", "items", "next", "nb", "note", "notes", "outcome",
    "present", "question", "questions", "recap", "reminder", "risk", "risks",
    "status", "summary", "todo", "topic", "update", "updates", "warning",
]
# The shape of a name in a label, and its greatest length.
NAME_SHAPED = r"^[A-Z][\w.'’-]*(?:\s+[A-Z][\w.'’-]*){1,3}$"
MAX_LABEL = 48

# Titles, placeholders for people, and names that only services have.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam"]
PLACEHOLDERS = ["unspecified", "unassigned", "unknown", "tbd", "n_a", "none"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and that the expression holds once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise_text(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def strip(x: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(x, rf"^{SPACE}|{SPACE}$", "")


def content_words(x: Column) -> Column:
    """Distinct words longer than two letters that are no stopwords."""
    words = F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in TASK_STOPWORDS])
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), stop)


def task_similarity(a: Column, b: Column, least: int = 2) -> Column:
    """Share of the smaller word set that is in the larger; 0 for fewer than ``least`` words."""
    wa, wb = content_words(a), content_words(b)
    return containment(wa, wb, least)


def containment(wa: Column, wb: Column, least: int = 2) -> Column:
    smaller = F.least(F.size(wa), F.size(wb))
    return F.when(smaller < least, F.lit(0.0)).otherwise(F.size(F.array_intersect(wa, wb)) / smaller)


def span_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap as a share of the shorter span; 0 where an end is missing."""
    shared = F.least(e1, e2) - F.greatest(s1, s2)
    shorter = F.least(e1 - s1, e2 - s2)
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known & (shared > 0) & (shorter > 0), shared / shorter).otherwise(F.lit(0.0))


def dedup_key(quote: Column, task: Column) -> Column:
    """Stable identity of an extraction: 32 hex digits over quote and beginning of the task."""
    material = F.concat(F.lower(normalise_text(quote)), F.lit("|"), F.substring(F.lower(normalise_text(task)), 1, 60))
    return F.substring(F.sha2(material.cast("binary"), 256), 1, 32)


def verify_quote(quote: Column, source_text: Column) -> Column:
    """Whether a quote that is not blank is literally in the text."""
    return F.coalesce((normalise_text(quote) != "") & F.contains(source_text, normalise_text(quote)), F.lit(False))


def locate_quote(quote: Column, source_text: Column) -> Column:
    """(char_start, char_end) of the first occurrence; null if there is none."""
    q = normalise_text(quote)
    at = F.instr(source_text, q)
    return F.when((q != "") & (at > 0), F.struct((at - 1).alias("char_start"), (at - 1 + F.length(q)).alias("char_end")))


def longest_prefix(quote: Column, source_text: Column, least: int = 12, most: int = 200) -> Column:
    """The longest beginning of the quote, of ``least`` to ``most`` characters, that is in the text."""
    q = normalise_text(quote)
    n = F.least(F.length(q), F.lit(most))
    sizes = F.when(n >= least, F.sequence(n, F.lit(least), F.lit(-1)))
    return F.get(F.filter(F.transform(sizes, lambda k: F.substring(q, F.lit(1), k)), lambda p: F.contains(source_text, p)), F.lit(0))


def canonical_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z]", "")


def split_speaker(line: Column, lookup: Column | None = None) -> Column:
    """(speaker, text) of "Speaker: text"; no speaker where the label is not convincing.

    ``lookup``: map of canonical names to known participants.
    """
    parts = F.struct(
        strip(line).alias("whole"), strip(F.substring_index(line, ":", 1)).alias("label"), strip(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("rest"), line.contains(":").alias("colon")
    )
    pair = lambda s, t: F.struct(s.alias("speaker"), t.alias("text"))

    def judge(p: Column) -> Column:
        label, rest = p["label"], p["rest"]
        labelled = p["colon"] & (label != "") & (rest != "") & (F.length(label) <= MAX_LABEL)
        first = F.regexp_replace(F.lower(F.regexp_extract(label, r"^(\S+)", 1)), r"^[.,'’\-]+|[.,'’\-]+$", "")
        shaped = label.rlike(NAME_SHAPED) & ~first.isin(NOT_A_NAME) & ~label.rlike(r"[.!?]$")
        known = F.try_element_at(lookup, canonical_name(label)) if lookup is not None else F.lit(None).cast("string")
        speaker = F.when(labelled, F.coalesce(known, F.when(shaped, label)))
        return let(F.struct(speaker.alias("s")), lambda x: pair(x["s"], F.when(x["s"].isNotNull(), rest).otherwise(p["whole"])))

    return let(parts, judge)


def speaker_lookup(participants: Column) -> Column:
    """Map from canonical full names, and from first names that only one participant has, to participants."""
    first = lambda p: canonical_name(F.regexp_extract(F.trim(p), r"^(\S+)", 1))
    full = F.transform(participants, lambda p: F.struct(canonical_name(p).alias("k"), p.alias("v")))
    firsts = F.transform(participants, first)
    lone = F.filter(participants, lambda p: (F.size(F.filter(firsts, lambda f: f == first(p))) == 1) & ~F.array_contains(F.transform(participants, canonical_name), first(p)))
    short = F.transform(lone, lambda p: F.struct(first(p).alias("k"), p.alias("v")))
    entries = F.concat(full, short)
    # a later participant with the same name wins; map_from_entries refuses equal keys
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def collapse_abstention(x: Column) -> Column:
    """Every spelling of "not stated" as UNSPECIFIED; other values trimmed."""
    cleaned = F.trim(x)
    bare = F.regexp_replace(F.lower(cleaned), r"^\.+|\.+$", "")
    return F.when(bare.isin(ABSTENTIONS), F.lit(UNSPECIFIED)).otherwise(cleaned)


def render_segment(ts: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(ts, F.lit("--:--:--")), F.lit("] "), F.coalesce(speaker, F.lit(UNSPECIFIED)), F.lit(": "), text)


def estimate_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))


def segment_id(source_id: Column, index: Column) -> Column:
    return F.format_string("%s::seg%04d", source_id.cast("string"), index.cast("long"))


def strip_fence(x: Column) -> Column:
    """What a code fence holds, or the trimmed text."""
    inner = F.regexp_extract(x, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(x))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def search_text(payload: Column, quote: Column) -> Column:
    """Scalar values of a payload, and the quote; lists and objects are left out."""
    values = F.map_values(F.from_json(payload, "map<string,string>"))
    kept = F.filter(values, lambda v: v.isNotNull() & (v != "") & ~v.startswith("[") & ~v.startswith("{"))
    return F.concat_ws(" ", kept, quote)


def is_direct_message(channel: Column, *flags: Column) -> Column:
    named = F.coalesce(channel.rlike(r"(?i)^(dm|dms|direct|private)[-_]"), F.lit(False))
    for f in flags:
        named = named | F.coalesce(f, F.lit(False))
    return named


def headline(payload: Column, quote: Column) -> Column:
    """The first filled of what, what_was_decided, description and text of a JSON payload, or the quote's beginning."""
    keys = ("what", "what_was_decided", "description", "text")
    return F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit("")) for k in keys], F.substring(quote, 1, 80))


def is_unassigned(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(normalise_name(name)), " ", "_")
    return name.isNull() | (normalise_name(name) == "") | bare.isin(PLACEHOLDERS)


def normalise_name(name: Column) -> Column:
    """Punctuation but for apostrophes and hyphens as space.  Compatibility forms: see functions.names.nfkc."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s'-]", " "), SPACE, " "))


def name_tokens(name: Column) -> Column:
    """Parts of a name without titles; all parts if nothing else is left."""
    parts = F.filter(F.split(normalise_name(name), " "), lambda p: p != "")
    kept = F.filter(parts, lambda p: ~F.lower(p).isin(TITLES))
    return F.when(F.size(kept) > 0, kept).otherwise(parts)


def person_key(name: Column, identity: str = "first_name") -> Column:
    parts = F.transform(name_tokens(name), F.lower)
    key = F.array_join(parts, "_") if identity == "full_name" else F.get(parts, F.lit(0))
    return F.when(is_unassigned(name), F.lit("unassigned")).otherwise(key)


def display_name(aliases: Column, participants: Column, key: Column) -> Column:
    """Heading of a person: the only full name, else the only matching participant, else a first name."""
    full = F.array_distinct(F.filter(aliases, lambda a: F.size(name_tokens(a)) > 1))
    matches = F.filter(participants, lambda p: person_key(p) == key)
    first = F.coalesce(F.get(name_tokens(F.get(aliases, F.lit(0))), F.lit(0)), key)
    return (
        F.when(key == "unassigned", F.lit("Assignee unspecified"))
        .when(F.size(full) == 1, F.get(full, F.lit(0)))
        .when((F.size(full) == 0) & (F.size(matches) == 1), normalise_name(F.get(matches, F.lit(0))))
        .otherwise(first)
    )


def is_ambiguous(aliases: Column) -> Column:
    return F.size(F.array_distinct(F.filter(aliases, lambda a: F.size(name_tokens(a)) > 1))) > 1
