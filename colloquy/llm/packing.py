"""Best-fit packing of tokenised documents into sequences.

Documents longer than a sequence are cut; the pieces are packed by a bulk-synchronous best fit.  Pieces
and gaps are sorted by size.  A superstep takes all pieces of one length, longest first; a sweep over
the gaps finds for them the successor of that length, that is the smallest gap they fit in; conflicts
are resolved by rank (the k-th piece of the length takes the k-th place); the gaps are updated; and the
next length follows.  Pieces that no gap takes open new sequences.

Where each step runs: documents are cut into pieces, counted by length, ranked within their length (a two-level
count) and placed by distributed jobs.  The sweep itself, over the sorted gaps, runs on the driver: since
pieces of one length are alike, a superstep needs only how many there are, so that its input is at most
``capacity`` numbers however large the corpus is, and its result is told as intervals of ranks, which every
task applies to its own pieces.  A sweep over single gaps in tasks would give the same places.

Cases: null text is empty, a document of the end token alone; repeated rows are packed as often as they
occur; equal lengths are ranked by document and piece; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, kept, map_texts, partitions

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
MEMO_WORDS = 250_000
#: Texts of these characters are in normal form C and are lower-cased and split alike by the tokenizer and by PIECES.
PLAIN = re.compile("[\t-\r\x20-\x7eÀ-įı-ſ]*")
LETTERS = "a-zß-öø-ſ"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, the end token included.

    Each word is encoded on its own, so the bytes of words met before are kept.  Other texts than PLAIN
    ones, and texts that may hold a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.end = END.to_bytes(4, "little")

    def _bytes(self, encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """All in one call: a space keeps each word, which is one match of PIECES, a word of its own."""
        encoding = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, owner = np.array(encoding.ids, "<u4").tobytes(), np.array(encoding.word_ids, np.int64)
        ends = (4 * (np.flatnonzero(np.diff(owner, append=-1)) + 1)).tolist()
        if len(ends) != len(words):
            raise ValueError("the tokenizer splits words in another way than PIECES")
        return map(lambda a, b: ids[a:b], [0, *ends], ends)

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False)) + self.end
        words = PIECES.findall(text.lower())
        memo = self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = list(dict.fromkeys(words))
            memo.update(zip(new, self._encode_words(new), strict=True))
        return b"".join(map(memo.__getitem__, words)) + self.end


def encoder(path: str) -> Encoder:
    """One for each worker, so that a later task finds the words of earlier ones."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def _tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return path


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""

    def make():
        encode = encoder(_tokenizer_path(tokenizer_path)).encode

        def cut_texts(texts: list) -> tuple[list[int], list[list]]:
            rows = []
            for k, text in enumerate(texts):
                ids = encode(text or "")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            index, *columns = map(list, zip(*rows, strict=True)) if rows else ([],) * 5
            return index, columns

        return cut_texts

    return map_texts(docs, make, "piece int, start long, length long, ids_crc32 long", keep=["doc_id"])


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of every length go: rows (length, first rank, pieces, first sequence, pieces a sequence, offset).

    Within a row, the j-th piece is in sequence ``first + j // each`` at ``offset + j % each * length``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> [(first sequence, how many)]
    plan, opened = [], 0
    for length in sorted((k for k in counts if counts[k]), reverse=True):
        left, rank = counts[length], 0
        moved: list[tuple[int, tuple[int, int]]] = []

        def place(gap: int, first: int, many: int, moved=moved, length=length):
            """Fill sequences with this gap; what is left of the interval comes back."""
            nonlocal left, rank
            each = gap // length
            full = min(many, left // each)
            parts = [(full, each)] if full else []
            if full < many and left - full * each:
                parts.append((1, left - full * each))
            for n, per in parts:
                plan.append((length, rank, n * per, first, per, capacity - gap))
                moved.append((gap - per * length, (first, n)))
                rank, left, first, many = rank + n * per, left - n * per, first + n, many - n
            return first, many

        for gap in sorted(g for g in gaps if g >= length):
            if not left:
                break
            rest = []
            for first, many in gaps.pop(gap):
                first, many = place(gap, first, many) if left else (first, many)
                if many:
                    rest.append((first, many))
            if rest:
                gaps[gap] = rest
        if left:
            new = -(-left // (capacity // length))
            place(capacity, opened, new)
            opened += new
        for gap, interval in moved:
            if gap:
                gaps.setdefault(gap, []).append(interval)
    return plan


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, a table that has been written down."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = np.array(best_fit_plan(counts, capacity), np.int64).reshape(-1, 6)
    # one length may hold a third of all pieces: ranks are counted within buckets and shifted by the buckets before
    n = max(16, partitions(spark))
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = cut(sizes.select("length", "_bucket", before.alias("_before")), "pack_shifts")
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = bucketed.withColumn("_within", within).join(shifts, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_within") - 1).alias("_rank"))
    out = ranked.schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out if f.name != "_rank"] + ["sequence_id long", "offset long"])
    span = np.int64(1 << 40)  # more than there are pieces of one length
    keys = plan[:, 0] * span + plan[:, 1]
    order = np.argsort(keys)
    keys, plan = keys[order], plan[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch.pop("_rank").to_numpy(np.int64)
            row = plan[np.searchsorted(keys, length * span + rank, side="right") - 1]
            j = rank - row[:, 1]
            yield batch.assign(sequence_id=row[:, 3] + j // row[:, 4], offset=row[:, 5] + j % row[:, 4] * length)

    return ranked.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return place_pieces(cut(cut_documents(docs, capacity, tokenizer_path), "pack_pieces"), capacity)
