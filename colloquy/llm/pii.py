"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are e-mail addresses, IP addresses, card numbers and telephone numbers found by fixed patterns
(leftmost, non-overlapping for each kind; matches that fail their check are dropped and not tried
again).  Candidates are tokens with a digit or an at sign and, of numbers that blanks divide, every run of
up to PARTS of them.  Lexical patterns of a candidate are the word before it, and the one after it, with its
shape; the two words before it, with its class; and its shape alone.  Patterns and values make a bipartite graph.
A value that is a seed is trusted; rounds score patterns by the share of trusted values among theirs,
and values by the patterns they stand in, until no pattern and no value changes.  Occurrences that overlap
no seed are added if their value is trusted: because patterns vouch for it, or because it is a seed elsewhere.

Offsets are code points, ends exclusive.  Cases: a null text is empty; repeated rows are judged alike; an
empty table gives an empty result; without seeds nothing is added; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, drop

#: Kinds in the order in which they are listed.  A look-behind, or the end of the match before, stands
#: for "leftmost": a run of letters is not tried from each of its letters, so long texts take linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_NUMBER = r"\+?\(?[0-9]++(?:[().-]{1,2}[0-9]++)*+\)?(?![A-Za-z0-9@_%+])"
CANDIDATE = rf"(?<![A-Za-z0-9._%+@-])(?:{_NUMBER}|(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9._%+@-]++)"
#: Characters looked at on each side, most characters of a shape that is kept digit by digit, most parts of a number.
CONTEXT, SHAPE, PARTS = 120, 40, 5

#: A bound on rounds; the graph is stable long before.
ROUNDS = 20
MIN_SUPPORT, MIN_CONFIDENCE, ACCEPT, TRUSTED = 5, 0.8, 0.9, 0.9


BLOCK = 200
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def located(text: Column, pattern: str) -> Column:
    """Matches as an array of (start, end, value, before, after); before and after are what stands around.

    Positions are running sums of the lengths of matches and of what lies between.  Sums are taken over
    blocks of matches first and then inside each block, as arrays grow by copying.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    rows = F.zip_with(rows, F.slice(pieces, 2, F.size(hits)), lambda r, after: F.struct(r["gap"].alias("gap"), r["hit"].alias("hit"), after.alias("after")))
    starts = F.filter(F.sequence(F.lit(1), F.size(hits) + 1, F.lit(BLOCK)), lambda i: i <= F.size(hits))
    width = lambda r: F.length(r["gap"]) + F.length(r["hit"])

    def numbered(state: Column, block: Column) -> Column:
        size = F.aggregate(block, F.lit(0), lambda n, r: n + width(r))
        return F.struct((state["at"] + size).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def step(state: Column, r: Column) -> Column:
        start = state["at"] + F.length(r["gap"])
        end = start + F.length(r["hit"])
        found = F.struct(
            start.alias("start"), end.alias("end"), r["hit"].alias("value"),
            F.right(r["gap"], F.lit(CONTEXT)).alias("before"), F.left(r["after"], F.lit(CONTEXT)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    def inside(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), step)["out"]

    blocks = F.transform(starts, lambda i: F.slice(rows, i, F.lit(BLOCK)))
    offsets = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), numbered)["out"]
    return F.when(F.size(hits) > 0, F.flatten(F.zip_with(blocks, offsets, inside))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    turned = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) < 3) | ((F.length(F.ltrim(part, F.lit("0"))) == 3) & (F.ltrim(part, F.lit("0")) <= "255"))
        return F.forall(F.split(value, r"\."), small)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(value)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Seed entities: array of (start, k, end) in order, k being the kind's place in KINDS."""
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")

    def of_kind(k: int, kind: str) -> Column:
        sound = F.filter(located(text, PATTERNS[kind]), lambda x: _sound(kind, x["value"]))
        spans = F.transform(sound, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))
        return F.when(text.rlike(NEEDS[kind]), spans).otherwise(none)

    return F.array_sort(F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)]))


def _shape(value: Column) -> Column:
    """A token with every digit as 9 and every run of letters as a: 99.9.99.999, a99@a.a; long ones with runs as one."""
    shape = F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Za-z]+", "a")
    return F.when(F.length(shape) <= SHAPE, shape).otherwise(F.left(F.regexp_replace(F.regexp_replace(shape, "9+", "9"), "(a9|9a)+a?", "x"), F.lit(SHAPE)))


def _class(value: Column) -> Column:
    n = F.length(_digits(value))
    return F.when(value.contains("@"), "at").when(value.rlike("[A-Za-z]"), "mixed").when(n >= 14, "14").when(n >= 7, "7").otherwise("0")


def _patterns(x: Column) -> Column:
    word = r"([\p{L}]+)[^\p{L}]*$"
    left = F.lower(F.regexp_extract(x["before"], word, 1))
    two = F.lower(F.regexp_extract(x["before"], r"([\p{L}]+)[^\p{L}]+[\p{L}]+[^\p{L}]*$", 1))
    right = F.lower(F.regexp_extract(x["after"], r"^[^\p{L}]*([\p{L}]+)", 1))
    shape = _shape(x["value"])
    pattern = lambda *parts: F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    lone = lambda p, needed: F.when(needed != "", p)
    return F.array_compact(F.array(
        lone(pattern("<", left, shape), left), lone(pattern(">", right, shape), right), lone(pattern("<<", two, left, _class(x["value"])), two), pattern("=", shape),
    ))


def _with_runs(tokens: Column) -> Column:
    """Tokens and, where single blanks divide numbers, every run of up to PARTS of them."""

    def runs(t: Column) -> Column:
        def each(x: Column, i: Column) -> Column:
            found, value, goes_on = [x], x["value"], ~x["value"].rlike("[A-Za-z@_%]")
            for k in range(1, PARTS):
                last, goes_on = F.get(t, i + k), goes_on & (F.get(t, i + k - 1)["after"] == " ")
                goes_on = goes_on & ~last["value"].rlike("[A-Za-z@_%]")
                value = F.concat_ws(" ", value, last["value"])
                run = F.struct(x["start"].alias("start"), last["end"].alias("end"), value.alias("value"), x["before"].alias("before"), last["after"].alias("after"))
                found.append(F.when(goes_on, run))
            return F.array_compact(F.array(*found))

        return F.flatten(F.transform(t, each))

    return F.element_at(F.transform(F.array(tokens), runs), 1)


def _bootstrap(candidates: DataFrame) -> DataFrame:
    """Trusted values: value, k.  ``candidates``: value, k (null if no seed), patterns."""
    values = cut(candidates.groupBy("value").agg(F.min("k").alias("k")), "pii_values")
    edges = cut(candidates.select(F.explode("patterns").alias("p"), "value").distinct(), "pii_edges")
    scored = cut(values.select("value", "k", F.when(F.col("k").isNotNull(), 1.0).otherwise(0.0).alias("score")), "pii_scores")
    before = None
    for _ in range(ROUNDS):
        kinds = [F.sum(F.when(F.col("k") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}") for k in range(len(KINDS))]
        told = edges.join(scored, "value").groupBy("p").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= TRUSTED).alias("support"), *kinds)
        ranked = F.array_max(F.array(*[F.struct((F.col(f"s{k}") / (F.col("n") + 1)).alias("confidence"), F.lit(-k).alias("turned")) for k in range(len(KINDS))]))
        trusted = told.where(F.col("support") >= MIN_SUPPORT).select("p", ranked.alias("best")).where(F.col("best.confidence") >= MIN_CONFIDENCE)
        trusted = cut(trusted.select("p", F.col("best.confidence").alias("confidence"), (-F.col("best.turned")).alias("pk")), "pii_patterns")
        vouched = edges.join(trusted, "p").groupBy("value").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("vouched"), F.max(F.struct("confidence", (-F.col("pk")).alias("turned"))).alias("by")
        )
        after = values.join(vouched, "value", "left").select(
            "value", F.coalesce("k", -F.col("by.turned")).alias("k"),
            F.when(F.col("k").isNotNull(), 1.0).otherwise(F.coalesce(F.col("vouched"), F.lit(0.0))).alias("score"),
        )
        after = cut(after, "pii_scores")
        drop(scored)
        scored = after
        # a sum of hashes tells whether the trusted patterns and values are those of the round before
        mark = lambda df, *c: df.agg(F.count("*"), F.sum(F.xxhash64(*c).cast("decimal(38,0)"))).first()
        state = mark(trusted, "p", "pk"), mark(scored.where(F.col("score") >= TRUSTED), "value", "k")
        drop(trusted)
        if state == before:
            break
        before = state
    return scored.where(F.col("score") >= ACCEPT).select("value", "k")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of (start, k, end)) for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(text).cast("string")).alias("key"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    meets = lambda b, x: (b["start"] < x["end"]) & (b["end"] > x["start"])
    is_it = lambda b, x: (b["start"] == x["start"]) & (b["end"] == x["end"])
    each = _with_runs(located(F.col("text"), CANDIDATE))
    # seeds themselves, and what overlaps none of them
    whole = F.filter(each, lambda x: F.exists("base", lambda b: is_it(b, x)) | ~F.exists("base", lambda b: meets(b, x)))
    tokens = F.transform(
        whole,
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _patterns(x).alias("patterns"), F.get(F.filter("base", lambda b: is_it(b, x)), F.lit(0))["k"].alias("k")),
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string,patterns:array<string>,k:int>>")
    found = cut(rows.select("doc_id", "key", "base", F.when(F.col("text").rlike("[0-9@]"), tokens).otherwise(empty).alias("tokens")), "pii_found")
    candidates = cut(found.where(F.size("tokens") > 0).select("key", F.explode("tokens").alias("t")).select("key", "t.*").distinct(), "pii_candidates")
    accepted = cut(_bootstrap(candidates), "pii_accepted")
    added = candidates.where("k is null").drop("k").join(accepted, "value").groupBy("key").agg(F.collect_set(F.struct("start", "k", "end")).alias("added"))
    # of runs of one number the longest stay
    inside = lambda x, y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    added = cut(added.select("key", F.filter("added", lambda x: ~F.exists("added", lambda y: inside(x, y))).alias("added")), "pii_added")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,k:int,end:int>>"))))
    return found.join(added, "key", "left").select("doc_id", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == KINDS.index(kind))).cast("long")
