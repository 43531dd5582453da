"""Removal of passages that repeat across documents, with DataFrame functions only.

A text is a list of words; a word ends at a space, a tab or a line break, and one of over LONG_WORD
characters, as in scripts without spaces, is taken character by character.  Boundaries are chosen by
a rolling hash, of the words' hashes, alone: a chunk of CHUNK words begins where the hash of two words says
so, and in every WINDOW successive places without such a one at the smallest hash.  Two equal stretches of
CHUNK + WINDOW - 1 words, wherever they begin and end, therefore have at least one chunk in common.

Documents that are whole copies, by SHA-256, of an earlier one are told first and have no part in what follows.
A chunk that occurs earlier is compared with the words of its first occurrence; where it begins or ends a
stretch of such chunks, the match is extended on that side, by comparing the words, over the WINDOW words
within which the next chunk begins.  Matched words are removed if together, in one run, they have ``min_run``
characters or MIN_WORDS words.  The first occurrence, in order of id and place, stays: every removed word has
an equal one at a smaller place.

Tables that are moved by chunk hash hold numbers only; words are fetched for the chunks that repeat.  A passage in a
third of all documents is one row in the table of first occurrences, and its occurrences are joined to
that row by a join that Spark can split.

Cases: a null text stays null; an empty one stays empty; rows without id stay as they are and count
nowhere; repeated rows (equal id and text) are decided alike and keep what the first keeps; an empty
table gives an empty result; other columns are ignored, or kept as they are by ``dedupe_lines``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, drop, may_match, original, prefixed

#: Splits nothing off: a line keeps its break, and the lines joined are the text.
LINE_END = r"(?<=\n)|(?<=[.] )"
ENDS, MARK = ("\n", ". "), "\x00"
BLANKS, BLANK_END = " \n\r\t", r"(?<=[ \n\r\t])"
#: Words of a chunk, and successive places of which one begins a chunk: 37 equal words have one in common.
CHUNK, WINDOW = 12, 26
#: One of so many chunks (a power of two) is kept by what its first words say.
KEPT_OF = 8
#: Characters of a word, if it is not to be taken character by character.
LONG_WORD = 32
#: Least number of characters, or of words, of a run that goes.
MIN_RUN, MIN_WORDS = 200, 50
#: Words looked at on each side of a stretch when its match is extended; before their end the next chunk begins.
REACH = WINDOW
#: The last word of a run that takes all of a text.
ALL = (1 << 31) - 1
#: Low bits of a chunk's hash that make room for its place.
PLACE_BITS = 24

KEY = ["doc_id", "_th"]


def _split_behind(text: Column, ends: tuple[str, ...], pattern: str) -> Column:
    """Parts with their ends.  A mark is put behind every end, and a plain split at it is much faster than
    looking behind every character; a text that holds the mark is split by the pattern."""
    marked = text
    for end in ends:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    return F.when(text.contains(MARK), F.split(text, pattern, -1)).otherwise(F.split(marked, MARK, -1))


def lines(text: Column) -> Column:
    """Lines with their ends."""
    return _split_behind(text, ENDS, LINE_END)


def _trim(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _long_words_split(parts: Column) -> Column:
    """``parts`` with every character of a long word on its own; what follows the word stays behind its last one."""
    def characters(p: Column) -> Column:
        n = F.length(_trim(p))
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(p, i, F.when(i < n, 1).otherwise(2)))
        return F.when(n > LONG_WORD, each).otherwise(F.array(p))

    # bytes are counted at once; a word of few characters may have more, and stays whole all the same
    return _let(parts, lambda w: F.when(F.exists(w, lambda p: F.octet_length(p) > LONG_WORD), F.flatten(F.transform(w, characters))).otherwise(w))


def tokens(text: Column) -> Column:
    """Words with what ends them; joined they are the text."""
    return _long_words_split(_split_behind(text, tuple(BLANKS), BLANK_END))


def _spaced(text: Column) -> Column:
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """``tokens`` without what ends them."""
    return _long_words_split(F.split(_spaced(text), " ", -1))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("_th"), "text")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _chunk_places(hashes: Column) -> Column:
    """Places of chunks of hashed words, from 1.

    A chunk is kept if its first two words say so and, where WINDOW successive ones are not, if it is the
    smallest of these; the first one of equals.  Both depend on nothing outside the WINDOW.
    """
    starts = F.size(hashes) - CHUNK + 1
    # places count from 0 here
    says_so = lambda h, i: h.bitwiseXOR(F.shiftleft(F.get(hashes, i + 1), 7)).bitwiseAND(F.lit(KEPT_OF - 1)) == 0
    # no two are equal, as the place is in the low bits
    placed = lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))

    def smallest(gap: Column) -> Column:
        values = F.transform(F.slice(hashes, gap["a"], gap["n"]), lambda h, i: placed(h, gap["a"] + i))
        found = _let(values, lambda v: F.array_distinct(F.transform(F.sequence(F.lit(1), gap["n"] - WINDOW + 1), lambda i: F.array_min(F.slice(v, i, F.lit(WINDOW))))))
        return F.transform(found, lambda v: v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))

    def places(said: Column) -> Column:
        # between what stands before the first one and behind the last one
        ends = F.concat(F.array(F.lit(0)), said, F.array(starts + 1))
        wide = lambda e: F.array_compact(
            F.transform(e, lambda x, i: F.when(F.get(e, i + 1) - x > WINDOW, F.struct((x + 1).alias("a"), (F.get(e, i + 1) - x - 1).alias("n"))))
        )
        return F.concat(said, F.flatten(F.transform(_let(ends, wide), smallest)))

    said = F.transform(F.slice(hashes, 1, F.greatest(starts, F.lit(0))), lambda h, i: F.when(says_so(h, i), i + 1))
    return F.when(starts > 0, _let(F.array_compact(said), places))


def _hashes(text: Column) -> Column:
    """Hashes of a text's words; only a text with a long word is split once more."""
    plain = F.split(_spaced(text), " ", -1)
    # bytes are counted at once; they are at least as many as characters
    short = F.transform(plain, lambda w: F.when(F.octet_length(w) <= LONG_WORD, F.xxhash64(w)))
    return _let(short, lambda h: F.when(F.size(F.array_compact(h)) == F.size(h), h).otherwise(F.transform(words(text), lambda w: F.xxhash64(w))))


def _chunks(keyed: DataFrame) -> DataFrame:
    """doc_id, _th, s, h of every chunk."""
    hashed = keyed.select(*KEY, F.explode(F.array(_hashes(F.col("text")))).alias("_hashes"))
    placed = hashed.select(*KEY, "_hashes", F.explode(F.array(_chunk_places(F.col("_hashes")))).alias("_places")).select(*KEY, "_hashes", F.explode("_places").alias("s"))
    # behind the generators chunks are hashed by generated code, and not by functions of arrays
    return placed.select(*KEY, "s", F.xxhash64(F.slice("_hashes", F.col("s"), F.lit(CHUNK))).alias("h"))


def _equal_first(a: Column, b: Column) -> Column:
    """How many first words of two texts are equal; 0 where one is null or empty."""
    # each text is split once; where one is longer, the shorter one's words are null
    same = F.zip_with(F.split(a, " ", -1), F.split(b, " ", -1), lambda p, q: p.eqNullSafe(q))
    return F.when((a != "") & (b != ""), F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).otherwise(0).cast("int")


def _copies(docs: DataFrame) -> DataFrame:
    """KEY of the documents that are whole copies of one with a smaller id."""
    told = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("_th"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    told = cut(told, "lines_told")
    firsts = told.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    copies = cut(may_match(told, cut(firsts, "lines_firsts"), ["sha"]).where("_maybe").drop("_maybe").join(firsts, "sha").where("doc_id > first").select(*KEY).distinct(), "lines_copies")
    drop(told)
    return copies


def _repeats(keyed: DataFrame) -> DataFrame:
    """KEY, s, h of chunks that an earlier place has too, which cover all words of such chunks; the first such place, and
    whether it begins or ends a stretch of chunks that touch."""
    chunks = cut(_chunks(keyed), "lines_chunks")
    # most hashes are met once; of them, nothing but the hash is moved
    often = cut(chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "lines_often")
    again = cut(may_match(chunks, often, ["h"]).where("_maybe").drop("_maybe").join(often, "h"), "lines_again")
    drop(chunks, often)
    place = F.struct(*KEY, "s")
    firsts = cut(again.groupBy("h").agg(F.min(place).alias("first")), "lines_firsts")
    repeats = again.join(firsts, "h").where(place != F.col("first"))
    along = Window.partitionBy(*KEY).orderBy("s")
    before, after = F.lag("s").over(along), F.lead("s").over(along)
    rows = repeats.select(*KEY, "s", "h", "first", before.alias("before"), after.alias("after"), (F.row_number().over(along) % 2 == 0).alias("even"))
    # of two neighbours one may be spared if the chunks beside it have all of its words
    rows = rows.where(~(F.col("even") & F.coalesce(F.col("after") - F.col("before") <= CHUNK, F.lit(False))))
    begins, ends = F.coalesce(F.col("before") < F.col("s") - CHUNK, F.lit(True)), F.coalesce(F.col("after") > F.col("s") + CHUNK, F.lit(True))
    out = cut(rows.select(*KEY, "s", "h", "first", begins.alias("begins"), ends.alias("ends")), "lines_repeats")
    drop(again, firsts)
    return out


def _contexts(keyed: DataFrame, repeats: DataFrame) -> DataFrame:
    """KEY, s, h, own (false at the first place) and the words of each chunk, with the words before or after it, nearest
    first, where it begins or ends a stretch."""
    firsts = repeats.groupBy("first").agg(F.any_value("h").alias("h"), F.max("begins").alias("begins"), F.max("ends").alias("ends"))
    places = repeats.select(*KEY, "s", "h", "begins", "ends", F.lit(True).alias("own")).unionByName(firsts.select("first.*", "h", "begins", "ends", F.lit(False).alias("own")))
    wanted = cut(places.groupBy(*KEY).agg(F.collect_list(F.struct("s", "h", "begins", "ends", "own")).alias("wanted")), "lines_wanted")
    # repeated rows are one here; the join keeps the grouping's partitioning
    texts = may_match(keyed, wanted, KEY).where("_maybe").groupBy(*KEY).agg(F.any_value("text").alias("text"))

    def around(w: Column, x: Column) -> Column:
        s = x["s"]
        start = F.greatest(s - REACH, F.lit(1))
        return F.struct(
            s.alias("s"), x["h"].alias("h"), x["own"].alias("own"), F.array_join(F.slice(w, s, F.lit(CHUNK)), " ").alias("words"),
            F.when(x["begins"], F.array_join(F.reverse(F.slice(w, start, s - start)), " ")).alias("before"),
            F.when(x["ends"], F.array_join(F.slice(w, s + CHUNK, F.lit(REACH)), " ")).alias("after"),
        )

    # the words of a text stay in its row: only the chunks and what stands around are copied
    told = texts.join(wanted.hint("merge"), KEY).select(*KEY, F.explode(_let(words(F.col("text")), lambda w: F.transform("wanted", lambda x: around(w, x)))).alias("x"))
    return told.select(*KEY, "x.*")


def _merged(spans: Column) -> Column:
    """Spans (s, e) in order, those that touch or overlap as one."""

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(x["s"] <= last["e"] + 1, joined).otherwise(F.concat(done, F.array(x)))

    ordered = F.array_sort(spans)
    return F.aggregate(F.slice(ordered, 2, F.size(ordered)), F.slice(ordered, 1, 1), add)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, _th, runs: for each document with repeats, the runs (s, e) of words that an earlier place has too.

    ``e`` is ALL in documents that are copies.
    """
    copies = _copies(docs)
    marked = may_match(_keyed(docs), copies, KEY)
    keyed = marked.where(~F.col("_maybe")).drop("_maybe").unionByName(marked.where("_maybe").drop("_maybe").join(copies, KEY, "left_anti"))
    repeats = _repeats(keyed)
    told = cut(_contexts(keyed, repeats), "lines_told")
    drop(repeats)
    first = told.where(~F.col("own")).select("h", *[F.col(c).alias(f"first_{c}") for c in ("words", "before", "after")])
    same = told.where("own").join(first, "h").where("words = first_words")
    reached = lambda side: _equal_first(F.col(side), F.col(f"first_{side}"))
    found = same.select(*KEY, F.struct((F.col("s") - reached("before")).alias("s"), (F.col("s") + CHUNK - 1 + reached("after")).alias("e")).alias("x"))
    runs = found.groupBy(*KEY).agg(_merged(F.collect_set("x")).alias("runs"))
    whole = copies.withColumn("runs", F.array(F.struct(F.lit(1).alias("s"), F.lit(ALL).alias("e"))))
    out = cut(runs.unionByName(whole), "lines_runs")
    drop(told, copies)
    return out


def _cleaned(docs: DataFrame, min_run: int) -> DataFrame:
    """Prefixed ``docs`` with _clean (the text that is left) and _n_removed (lines, whole or in part)."""
    runs = repeated_runs(docs)
    marked = may_match(prefixed(docs).withColumns({"doc_id": F.col("_doc_doc_id"), "_th": F.xxhash64("_doc_text")}), runs, KEY)
    text = F.col("_doc_text")
    own = [c for c in marked.columns if c.startswith("_doc_")]
    rest = marked.where(~F.col("_maybe") | text.isNull()).select(*own, text.alias("_clean"), F.lit(0).cast("long").alias("_n_removed"))
    rows = marked.where(F.col("_maybe") & text.isNotNull()).join(runs.hint("merge"), KEY, "left")
    # what a generator makes is computed once, and not copied into every expression that reads it
    rows = rows.select(*own, "runs", F.explode(F.array(tokens(text))).alias("_tokens"))
    # a run of ALL words ends where the text does
    ended = F.transform(F.coalesce("runs", F.array().cast("array<struct<s:int,e:int>>")), lambda r: F.struct(r["s"].alias("s"), F.least(r["e"], F.size("_tokens")).alias("e")))
    passage = lambda r: F.array_join(F.slice("_tokens", r["s"], r["e"] - r["s"] + 1), "")
    goes = lambda r: (r["e"] - r["s"] + 1 >= MIN_WORDS) | (F.length(passage(r)) >= min_run)
    rows = rows.select(*own, "_tokens", F.explode(F.array(F.filter(ended, goes))).alias("_runs"))
    starts = F.concat(F.array(F.lit(1)), F.transform("_runs", lambda r: r["e"] + 1))
    ends = F.concat(F.transform("_runs", lambda r: r["s"] - 1), F.array(F.size("_tokens")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("_tokens", a, F.greatest(b - a + 1, F.lit(0)))))
    removed = F.aggregate("_runs", F.lit(0), lambda n, r: n + F.size(F.filter(lines(passage(r)), lambda u: u != "")))
    made = F.struct(F.when(F.size("_runs") > 0, F.array_join(kept, "")).otherwise(text).alias("_clean"), removed.cast("long").alias("_n_removed"))
    rows = rows.select(*own, F.explode(F.array(made)).alias("_made")).select(*own, "_made._clean", "_made._n_removed")
    return rest.unionByName(rows)


def clean_lines(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, n_removed (lines, whole or in part) and the text that is left of every document."""
    return _cleaned(docs, min_run).select(F.col("_doc_doc_id").alias("doc_id"), F.col("_n_removed").alias("n_removed"), F.col("_clean").alias("text"))


def dedupe_lines(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` without repeated passages; documents of which nothing is left are dropped.

    Columns stay as they are; ``n_chars``, where there is one, follows the text.
    """
    rows = _cleaned(docs, min_run)
    changed = F.col("_n_removed") > 0
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc_n_chars"))
    return rows.where(~changed | (_trim(F.col("_clean")) != "")).select(*original(docs, **new))
