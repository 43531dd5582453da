"""N-gram Jaccard self-join with a MinHash LSH forest.

A document's shingles are all runs of five words (lower-cased; a shorter text is one shingle).  Its
MinHash values, each hash used once, are dealt to trees; in a tree the values in order are a path.  The
paths of all documents, range-sorted by tree and path, are the forest: a prefix of a path is a node of
the tree's trie, and the entries below it stand next to each other.  One pass over the sorted entries
tells for each how many values it shares with the one before (``lcp``) and which entry begins the run that
shares the first d values, for every depth d; runs that go over a border of partitions are joined by
the two entries at it.

Matching begins at full paths.  The candidates are verified on their whole shingle sets, and the lowest
similarity met tells by how much prefixes have to be shortened for a pair as similar as that to share one
in some tree with probability ``recall`` (``prefix_depth``).  This is repeated, for the families that a
shorter prefix has changed, until no verified pair asks for a shorter one.  Prefixes never get
shorter than what pairs at the threshold need.

No bucket is expanded into pairs.  Documents with equal shingle sets are one node with a count.  A run
links its entries to the first one, and the components of these links are families.  A family is dealt
into blocks of bounded size by size of shingle set, as sets whose sizes differ by more than the threshold
cannot match; a task compares two blocks and tells for each member its number of verified links, one
representative and the lowest similarity.  Components of the verified links are the classes.

Shingles are compared as 64-bit hashes.  The work in a family of m different texts of like size is m*m
comparisons in blocks, which more tasks share; rows stay at m times the number of blocks.

Cases: ids may have any type that can be ordered; a text without words, and a row without id, is alone
(class_id is its own id); texts with equal shingle sets are linked; repeated rows are linked to each other;
two texts under one id are two documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, cut, drop, give_back, kept, map_texts, may_match, original, partitions, prefixed
from colloquy.llm.components import connected_components

WORD = re.compile(r"[^\W_]+")
SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.999
HASHES = TREES * DEPTH
#: Bytes of a value in a path.
WIDTH = 2
BLOCK = 128
MEMO_WORDS = 200_000
_ODD = np.random.default_rng(20).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of similarity ``threshold`` is expected to meet in some tree."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(best, (hashes[at : at + 512, None] * _ODD).min(axis=0), out=best)
    return best


def tree_paths(hashes: np.ndarray) -> list[bytes]:
    """For each tree, its DEPTH values of WIDTH bytes one after the other."""
    # the high bits of a minimum are nearly all zero
    values = ((signature(hashes) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8 * WIDTH)).astype(">u2")
    return [row.tobytes() for row in values.reshape(TREES, DEPTH)]


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, _th (hash of the text), digest of the shingle set, its size, paths; no digest for texts without words."""

    def make():
        def told(texts: list) -> tuple[None, list[list]]:
            out = []
            for text in texts:
                h = shingles(text)
                out.append((_digest(h), len(h), tree_paths(h)) if len(h) else (None, 0, None))
            return None, [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]

        return told

    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), "text")
    rows = map_texts(rows, make, "digest binary, size long, paths array<binary>")
    return rows.withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest")))


def _climb(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Entries sorted by tree and path: for each that shares at least ``least`` values with the one before,
    how many, and the first entries of its runs by depth.  Two more rows tell the ends of the partition."""
    columns = ["node", "lcp", "heads", "part", "tree", "path"]
    part = TaskContext.get().partitionId()
    before, heads, ends = None, [0] * (DEPTH + 1), []
    for batch in batches:
        if not len(batch):
            continue
        trees, nodes = batch["tree"].to_numpy(np.int64), batch["node"].to_numpy(np.int64)
        values = np.frombuffer(b"".join(map(bytes, batch["path"])), ">u2").reshape(-1, DEPTH)
        same = np.zeros((len(batch), DEPTH), bool)
        same[1:] = (values[1:] == values[:-1]) & (trees[1:] == trees[:-1])[:, None]
        if before is None:
            ends.append((int(nodes[0]), -1, None, part, int(trees[0]), values[0].tobytes()))
        else:
            same[0] = (values[0] == before[1]) & (trees[0] == before[0])
        rows, shared = [], np.cumprod(same, axis=1).sum(axis=1).tolist()
        for node, lcp in zip(nodes.tolist(), shared, strict=True):
            heads[lcp + 1 :] = [node] * (DEPTH - lcp)
            if lcp >= least:
                rows.append((node, lcp, heads[1 : lcp + 1], None, None, None))
        before = trees[-1], values[-1], nodes[-1]
        yield pd.DataFrame(rows, columns=columns)
    if before is not None:
        ends.append((int(before[2]), -2, None, part, int(before[0]), before[1].tobytes()))
        yield pd.DataFrame(ends, columns=columns)


def forest_links(sets: DataFrame, least: int) -> DataFrame:
    """node, lcp, heads: an entry of a sorted trie, the values shared with the one before, the first entries of
    its runs by depth.  ``sets`` (node, paths) is a written table."""
    spark = sets.sparkSession
    entries = sets.select("node", F.posexplode("paths").alias("tree", "path"))
    # nodes are part of the order, so that a run of equal paths may go over partitions
    ordered = entries.repartitionByRange(partitions(spark), "tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    schema = "node long, lcp int, heads array<long>, part int, tree int, path binary"
    climbed = cut(ordered.mapInPandas(lambda batches: _climb(batches, least), schema), "lsh_forest")
    # two rows a partition
    ends = sorted(climbed.where("lcp < 0").select("part", "lcp", "node", "tree", "path").collect(), key=lambda r: (r["part"], -r["lcp"]))
    seams = []
    for a, b in zip(ends, ends[1:]):  # noqa: B905
        if a["lcp"] == -2 and a["tree"] == b["tree"]:
            x, y = bytes(a["path"]), bytes(b["path"])
            lcp = next((d for d in range(DEPTH) if x[d * WIDTH : (d + 1) * WIDTH] != y[d * WIDTH : (d + 1) * WIDTH]), DEPTH)
            if lcp >= least:
                seams.append((b["node"], lcp, [a["node"]] * lcp))
    return climbed.where("lcp >= 0").select("node", "lcp", "heads").unionByName(spark.createDataFrame(seams, "node long, lcp int, heads array<long>"))


def _families(forest: DataFrame, depth: int) -> DataFrame:
    """Candidate families at a depth: node, family and the family's number of members."""
    links = forest.where(F.col("lcp") >= depth).select(F.col("node").alias("u"), F.col("heads")[depth - 1].alias("v"))
    families = cut(connected_components(links).select("node", F.col("component").alias("family")), "lsh_families")
    counts = families.groupBy("family").agg(F.count("*").alias("members"))
    return cut(families.join(counts, "family"), "lsh_families")


def _blocks(sets: DataFrame, families: DataFrame, block: int, threshold: float) -> DataFrame:
    """The block pairs that each member of a family takes part in: (node, doc, digest, copies, family, pairs).

    Bands of set sizes are wider than 1 / threshold: a match is in the same band or the next one.
    """
    band = F.floor(F.log("size") / float(np.log(1.01 / threshold))).cast("int")
    members = cut(sets.select("node", "doc", "digest", "copies", band.alias("band")).join(families.select("node", "family"), "node"), "lsh_members")
    cells = members.groupBy("family", "band").agg(F.count("*").alias("n"))
    cells = cut(cells.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("cells")), "lsh_cells")
    rows = members.join(cells, "family")

    def parts(of) -> tuple[Column, Column]:
        n = F.coalesce(F.element_at("cells", of), F.lit(0))
        return n, F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1)

    b = F.col("band")
    n, own_parts = parts(b)
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("node"), F.ceil(n / block)).cast("int"))
    s = F.col("sub")
    pair = lambda b1, s1, b2, s2, side: F.struct(F.format_string("%d.%d.%d.%d", b1, s1, b2, s2).alias("pair"), side.cast("int").alias("side"))
    none = F.array().cast("array<struct<pair:string,side:int>>")
    own = F.when(n > 1, F.transform(own_parts, lambda j: pair(b, F.least(s, j), b, F.greatest(s, j), s > j))).otherwise(none)
    above_n, above_parts = parts(b + 1)
    above = F.when(above_n > 0, F.transform(above_parts, lambda j: pair(b, s, b + 1, j, F.lit(False)))).otherwise(none)
    below_n, below_parts = parts(b - 1)
    below = F.when(below_n > 0, F.transform(below_parts, lambda j: pair(b - 1, j, b, s, F.lit(True)))).otherwise(none)
    return rows.select("node", "doc", "digest", "copies", "family", F.concat(own, above, below).alias("pairs")).where(F.size("pairs") > 0)


def links_of(sets: list[np.ndarray], sides: np.ndarray, within: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency matrix of the verified pairs, across sides or within the only one, and all similarities."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[inverse]
    row = np.repeat(np.arange(m), sizes)
    use = shared[inverse]
    row, column = row[use], column[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((m, m), np.float64)
    width, total = 8192, int(shared.sum())
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, min(width, total - at)), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        common += x @ x.T
    either = sizes[:, None] + sizes[None, :] - common
    near = common >= threshold * either - 1e-9
    np.fill_diagonal(near, False)
    return near if within else near & (sides[:, None] != sides[None, :]), common / either


def _roots(near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node that can be reached from each one."""
    label = nodes.copy()
    high = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(near, label[None, :], high).min(axis=1))
        if (new == label).all():
            return label
        label = new


def _compare(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows come sorted by family and pair; a group may go over batches."""

    def judged(group: pd.DataFrame) -> pd.DataFrame | None:
        group = group.drop_duplicates(["side", "node"])  # a repeated row has been sent as often as it occurs
        sides = group["side"].to_numpy()
        b1, s1, b2, s2 = group["pair"].iloc[0].split(".")
        within = (b1, s1) == (b2, s2)
        if len(group) < 2 or (not within and sides.min() == sides.max()):
            return None
        near, similarity = links_of([np.frombuffer(x, np.uint64) for x in group["hashes"]], sides, within, threshold)
        nodes, copies = group["node"].to_numpy(np.int64), group["copies"].to_numpy(np.int64)
        lowest = np.where(near, similarity, 1.0).min(axis=1)
        out = pd.DataFrame({"node": nodes, "links": near @ copies, "root": _roots(near, nodes), "lowest": lowest})
        return out[near.any(axis=1)]

    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        starts = np.flatnonzero((batch["family"].diff() != 0) | (batch["pair"] != batch["pair"].shift())).tolist()
        found = [judged(batch.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        rest = batch.iloc[starts[-1] :] if starts else None
        if found := [x for x in found if x is not None]:
            yield pd.concat(found)
    if rest is not None and (last := judged(rest)) is not None:
        yield last
    give_back()


def _verified(docs: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """node, links, root, lowest for each block that a node has links in."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = []
                for r in batch.iloc[at : at + 200].itertuples():
                    h = shingles(r.text)
                    if _digest(h) == bytes(r.digest):  # another text may have the same id
                        rows += [(r.family, p["pair"], p["side"], r.node, r.copies, h.tobytes()) for p in r.pairs]
                yield pd.DataFrame(rows, columns=["family", "pair", "side", "node", "copies", "hashes"])
        give_back()

    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    # texts of members only are moved, and always by an exchange: what is written grows with the input
    texts = may_match(texts, blocks, ["doc"]).where("_maybe").select("doc", "text")
    rows = texts.join(blocks.hint("merge"), "doc").mapInPandas(spread, "family long, pair string, side int, node long, copies long, hashes binary")
    dealt = rows.repartition(partitions(docs.sparkSession), "family", "pair").sortWithinPartitions("family", "pair", "node")
    return dealt.mapInPandas(lambda batches: _compare(batches, threshold), "node long, links long, root long, lowest double")


def _matched(docs: DataFrame, sets: DataFrame, threshold: float, recall: float, block: int) -> DataFrame:
    """Verified links (node, links, root) of prefixes as short as the data ask for."""
    least, depth = prefix_depth(threshold, recall=recall), DEPTH
    forest = cut(forest_links(sets.select("node", "paths"), least), "lsh_links")
    verified, before = None, None
    while True:
        families = _families(forest, depth)
        fresh = families
        if before is not None:
            # a family only grows as prefixes get shorter: one of the same root and size is the same
            fresh = cut(families.join(before.select("family", "members").distinct(), ["family", "members"], "left_anti"), "lsh_fresh")
            verified = cut(verified.join(fresh.select("node"), "node", "left_anti"), "lsh_verified")
        found = cut(_verified(docs, _cut_blocks(sets, fresh, block, threshold), threshold), "lsh_found")
        verified = found if verified is None else cut(verified.unionByName(found), "lsh_verified")
        lowest = verified.agg(F.min("lowest")).first()[0]
        needed = depth if lowest is None else max(least, min(depth, prefix_depth(max(lowest, threshold), recall=recall)))
        if needed == depth:
            drop(forest, families)
            return verified
        before, depth = families, needed


def _cut_blocks(sets: DataFrame, families: DataFrame, block: int, threshold: float) -> DataFrame:
    return cut(_blocks(sets, families, block, threshold), "lsh_blocks")


def _classes(docs: DataFrame, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row (doc_id, _th, digest), and of every digest its class (an internal number) and n_links."""
    sketched = cut(sketch(docs), "lsh_sketch")
    sets = sketched.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("paths").alias("paths")
    )
    sets = cut(sets.withColumn("node", F.monotonically_increasing_id()), "lsh_sets")
    verified = _matched(docs, sets, threshold, recall, block)
    classes = cut(connected_components(verified.select(F.col("node").alias("u"), F.col("root").alias("v"))), "lsh_classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    told = cut(
        sets.select("node", "digest", "copies")
        .join(classes, "node", "left")
        .join(links, "node", "left")
        .select("digest", F.coalesce("component", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "lsh_told",
    )
    drop(verified, classes, sets)
    return sketched.select("doc_id", "_th", "digest"), told


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links of every document.

    ``class_id`` is the smallest id among the documents that are joined by links of at least
    ``threshold``; ``n_links`` counts the other documents that a document is linked to itself.
    """
    sketched, told = _classes(docs, threshold, recall, block)
    rows = sketched.select("doc_id", "digest")
    ids = rows.join(told.select("digest", "class"), "digest").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    told = cut(told.join(ids, "class").select("digest", "class_id", "n_links"), "lsh_ids")
    return rows.join(told, "digest", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_representatives(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, and of two texts of that id the one with the
    smaller hash.  Rows without id, or without words, stay."""
    sketched, told = _classes(docs, threshold, recall, BLOCK)
    own = F.struct("doc_id", "_th")
    rows = cut(sketched.where("digest is not null").join(told.select("digest", "class"), "digest").select("class", "doc_id", "_th"), "lsh_rows")
    first = rows.groupBy("class").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first")
    first = cut(first, "lsh_first")
    grouped = rows.join(first, "class")
    gone = cut(grouped.where(own != F.col("first")).select("doc_id", "_th").distinct(), "lsh_gone")
    marked = prefixed(docs).withColumns({"doc_id": F.col("_doc_doc_id"), "_th": F.xxhash64("_doc_text")})
    kept = marked.join(gone, ["doc_id", "_th"], "left_anti")
    # a repeated row of the same id and text is one of the class, too
    twice = cut(grouped.where(own == F.col("first")).groupBy("doc_id", "_th").count().where("count > 1").select("doc_id", "_th"), "lsh_twice")
    if twice.isEmpty():
        return kept.select(*original(docs))
    kept = may_match(kept, twice, ["doc_id", "_th"])
    maybe = F.col("_maybe") & F.col("doc_id").isNotNull()
    some = kept.where(maybe).join(twice.withColumn("_twice", F.lit(True)), ["doc_id", "_th"], "left")
    once = some.where("_twice").dropDuplicates(["doc_id", "_th"]).drop("_twice")
    alone = some.where("_twice is null").drop("_twice")
    return kept.where(~maybe).unionByName(alone).unionByName(once).select(*original(docs))
