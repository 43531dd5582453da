"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items make one automaton.  A training text is streamed through it; at every word
the automaton tells the longest suffix read so far that occurs in an item.  Where that length reaches
``window`` words (or a whole item that is shorter occurs) the words of the match are hit.

The automaton is sent to every task, so it holds items of about SHARD_BYTES of text; a larger benchmark
is dealt into shards by a hash of the item, and each shard is one more pass over the rows, written down
before the next one is read: the driver and the workers never hold more than one shard.

Cases: null texts have no words; an item without words has no window; items that share an id count
once; an item without an id marks words but is not listed; repeated rows are judged alike; empty
tables give empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, drop, kept, map_texts, original, prefixed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WINDOW, SHARD_BYTES = 10, 1 << 20
#: A document is dropped from a cleaned corpus if more than this share of its words is hit.
MAX_COVERAGE = 0.8


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class SuffixAutomaton:
    """Suffix automaton of several sequences of integers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _clone(self, p: int, q: int, symbol: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        there = self.next[last].get(symbol)
        if there is not None:  # an earlier item has this substring
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, there, symbol)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
        return state

    def stream(self, sequence) -> Iterator[int]:
        """The longest matching length after each symbol."""
        state = length = 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            there = self.next[state].get(symbol)
            if there is None:
                length = 0
            else:
                state, length = there, length + 1
            yield length


class Detector:
    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.automaton = SuffixAutomaton()
        self.owners: dict[bytes, set[str | None]] = {}
        self.short: set[int] = set()
        pairs: set[int] = set()
        sequences = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                sequences.append((item_id, np.array(ids, np.int64)))
        self.size = max(1, len(self.vocabulary))
        for item_id, ids in sequences:
            self.automaton.add(ids.tolist())
            pairs.update((ids[:-1] * self.size + ids[1:]).tolist())
            n = min(window, len(ids))
            if len(ids) < window:
                self.short.add(len(ids))
            for i in range(len(ids) - n + 1):
                self.owners.setdefault(ids[i : i + n].tobytes(), set()).add(item_id)
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = min([window, *self.short]) if sequences else 0

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches where every word, and every pair of neighbours, occurs in an item."""
        known = ids >= 0
        joined = np.zeros(len(ids), bool)  # word i follows word i-1 in an item
        if len(self.pairs):
            code = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[1:] = (self.pairs[at] == code) & known[:-1] & known[1:]
        starts = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def find(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Word spans (start, end) that are hit, merged and in order, and the ids of the items found."""
        if not self.least or len(words) < self.least:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set[str | None] = set()
        for start, end in self._runs(ids):
            for i, length in enumerate(self.automaton.stream(ids[start:end].tolist()), start + 1):
                if length >= self.window:
                    spans.append((i - length, i))
                    found |= self.owners[ids[i - self.window : i].tobytes()]
                for n in self.short:
                    if n <= length and (own := self.owners.get(ids[i - n : i].tobytes())):
                        spans.append((i - n, i))
                        found |= own
        return merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def detector(items: list[tuple[str | None, str]], window: int) -> Detector:
    """The detector of these items; a worker that is used again need not build it again."""
    key = hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).hexdigest()
    return kept(f"detector {key}", lambda: Detector(items, window))


def shards(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[list[tuple[str | None, str]], bool]]:
    """The items in lists of bounded size, one at a time, and whether a list is the last."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // shard_bytes))
    if n > 1:
        items = cut(items.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition(n, "_part").sortWithinPartitions("_part"), "bench_parts")
    for k in range(n):
        part = items.where(F.col("_part") == k) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], k == n - 1
    drop(items)


FOUND = "_found struct<n_words: bigint, spans: array<struct<a: int, b: int>>, items: array<string>>"


def _pass(rows: DataFrame, text: str, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    """Add what one shard finds as _found: spans of words and item ids."""

    def make():
        own = detector(items, window)

        def told(texts: list) -> tuple[None, list[list]]:
            out = []
            for t in texts:
                words = words_of(t)
                spans, ids = own.find(words)
                out.append({"n_words": len(words), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(ids - {None})})
            return None, [out]

        return told

    return map_texts(rows, make, FOUND, keep=rows.columns, read=(text,))


def _more(rows: DataFrame, text: str, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    """Rows with _found of earlier shards, and of this one."""
    rows = _pass(rows.withColumnRenamed("_found", "_before"), text, items, window)
    spans = merged_spans(F.concat("_before.spans", "_found.spans"))
    both = F.struct(F.col("_found.n_words").alias("n_words"), spans.alias("spans"), F.array_union("_before.items", "_found.items").alias("items"))
    return rows.withColumn("_found", both).drop("_before")


def _search(docs: DataFrame, text: str, benchmark: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """``docs`` with _found over all shards."""
    rows = None
    for items, last in shards(benchmark, shard_bytes):
        rows = _pass(docs, text, items, window) if rows is None else _more(rows, text, items, window)
        rows = rows if last else _written(rows)
    return rows


def _written(rows: DataFrame) -> DataFrame:
    return cut(rows, "bench_pass")


def merged_spans(spans: Column) -> Column:
    """Spans in order, those that touch or overlap as one."""

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        touches = F.when(F.size(done) > 0, x["a"] <= last["b"]).otherwise(False)
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<a: int, b: int>>"), add)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, spans (of words), items for every document."""
    rows = _search(docs.select("doc_id", "text"), "text", benchmark, window, shard_bytes)
    return rows.select("doc_id", "_found.n_words", "_found.spans", "_found.items")


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without hit spans; documents of which more than ``max_coverage`` is hit are dropped.

    Columns stay as they are; ``n_chars``, where there is one, follows the text.
    """
    rows = prefixed(docs)
    own, earlier, final = rows.columns, None, []
    # all shards but the last are searched first; the last one's pass also cuts, in the same worker
    for items, last in shards(benchmark, shard_bytes):
        if last:
            final = items
        else:
            earlier = _written(_pass(rows, "_doc_text", items, window) if earlier is None else _more(earlier, "_doc_text", items, window))
    if earlier is None:
        earlier = rows.withColumn("_found", F.lit(None).cast(FOUND.removeprefix("_found ")))

    def make():
        found = detector(final, window)

        def cleaned(texts: list, told: list) -> tuple[None, list[list]]:
            out = []
            for t, x in zip(texts, told, strict=True):
                words = words_of(t)
                spans = merge(found.find(words)[0] + [(s["a"], s["b"]) for s in (x["spans"] if x else [])])
                hit = sum(b - a for a, b in spans)
                out.append((remove_words(t, spans) if spans else t, hit, hit > max_coverage * len(words)))
            return None, [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]

        return cleaned

    rows = map_texts(earlier, make, "_clean string, _hit long, _gone boolean", keep=own, read=("_doc_text", "_found")).where(~F.col("_gone"))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_hit") > 0, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc_n_chars"))
    return rows.select(*original(docs, **new))
