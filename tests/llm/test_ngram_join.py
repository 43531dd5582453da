import random
from itertools import combinations

from colloquy.llm import ngram_join as nj

RNG = random.Random(9)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(5)) for _ in range(800)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def changed(t, n):
    words = t.split()
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return " ".join(words)


def brute(rows, threshold=0.8):
    def grams(t):
        w = nj.WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
            continue
        both = len(sets[i] & sets[j])
        if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], min((m for m in members[find(i)] if m is not None), default=None), links[i]) for i in range(len(rows))]


def result(make, rows, **kw):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in nj.similar_documents(make(rows), **kw).collect()), key=str)


def test_agrees_with_all_pairs(make):
    rows, k = [], 0
    for _ in range(12):
        base = text(RNG.choice([6, 30, 120]))
        for edits in RNG.choices([0, 0, 1, 2, 3, 6], k=RNG.randint(1, 8)):
            rows.append((k, changed(base, edits)))
            k += 1
    rows += [(500 + i, text(40)) for i in range(20)]
    rows += [(700, "a b c d e"), (701, "A, b c d e!"), (702, "a b"), (703, "a b"), (704, "")]
    assert result(make, rows) == sorted(brute(rows), key=str)


def test_a_large_group_is_dealt_into_blocks(make):
    base = text(100)
    rows = [(k, changed(base, k % 4)) for k in range(90)] + [(200 + k, base) for k in range(40)] + [(400 + k, base + " " + text(k)) for k in range(1, 40, 3)]
    want = sorted(brute(rows), key=str)
    assert result(make, rows, block=8) == want == result(make, rows)


def test_cases(make):
    long = text(30000)
    rows = [(1, None), (2, ""), (3, "!?"), (4, long), (5, changed(long, 5)), (6, "x y z w v"), (6, "x y z w v"), (7, "x y z w v"), (None, "x y z w v"), (8, text(50)), (8, text(50))]
    rows[-1] = rows[-2]
    assert result(make, rows) == sorted(brute(rows), key=str)
    assert result(make, []) == []
    kept = nj.keep_representatives(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "8", "None"])


def test_prefixes_shorten_until_the_recall():
    depths = [nj.prefix_depth(recall=r) for r in (0.5, 0.9, 0.99, 0.999, 0.99999)]
    assert depths == sorted(depths, reverse=True) and depths[0] == nj.DEPTH and depths[-1] < nj.DEPTH
    d = nj.prefix_depth()
    assert 1 - (1 - nj.THRESHOLD**d) ** nj.TREES >= nj.RECALL


def test_depth_follows_the_similarities_met(make, monkeypatch):
    """Copies with one word changed in many are found by full paths; pairs at the threshold ask for shorter prefixes."""
    seen = []
    families = nj._families
    monkeypatch.setattr(nj, "_families", lambda forest, depth: seen.append(depth) or families(forest, depth))
    near = [(k, changed(base, 1)) for k, base in enumerate([text(400)] * 6)]
    assert result(make, near) == sorted(brute(near), key=str) and seen == [nj.DEPTH]
    seen.clear()
    base = [text(30) for _ in range(20)]
    border = [(k, base[k // 2] if k % 2 else base[k // 2] + " " + text(6)) for k in range(40)]
    assert result(make, border) == sorted(brute(border), key=str)
    assert seen == [nj.DEPTH, nj.prefix_depth()]


def test_recall_at_the_threshold():
    """Pairs just above the threshold share a prefix in some tree."""
    d, met, n = nj.prefix_depth() * nj.WIDTH, 0, 0
    while n < 300:
        base = text(120)
        a, b = nj.shingles(base), nj.shingles(changed(base, 3))
        both = len(set(a.tolist()) & set(b.tolist()))
        if 0.8 <= both / (len(a) + len(b) - both) <= 0.84:
            n += 1
            met += any(x[:d] == y[:d] for x, y in zip(nj.tree_paths(a), nj.tree_paths(b), strict=True))
    assert met / n >= 0.99


def test_other_thresholds(make):
    rows, k = [], 0
    for _ in range(10):
        base = text(60)
        for edits in (0, 1, 2, 4, 5):
            rows.append((k, changed(base, edits)))
            k += 1
    for threshold in (0.5, 0.65, 0.9):
        assert result(make, rows, threshold=threshold) == sorted(brute(rows, threshold), key=str), threshold


def test_repeated_rows_beside_near_copies(make):
    base = text(80)
    near = changed(base, 1)
    rows = [(1, base), (1, base), (2, near), (3, changed(near, 1)), (3, text(80)), (3, near)]
    assert result(make, rows) == sorted(brute(rows), key=str)
    other = text(60)
    rows = [(5, base), (5, other), (7, other), (7, near), (8, near), (8, near), (9, text(30)), (9, text(30))]
    kept = sorted((r["doc_id"], r["text"]) for r in nj.keep_representatives(make(rows)).collect())
    assert kept == sorted([rows[0], rows[1], rows[6], rows[7]])


def test_ids_of_any_type(make, spark):
    base = text(60)
    rows = [("b", base), ("a", changed(base, 1)), ("é", base), (None, base), ("z", text(40))]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in nj.similar_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()), key=str)
    assert got == sorted([("b", "a", 2), ("a", "a", 2), ("é", "a", 2), (None, None, 0), ("z", "z", 0)], key=str)


def test_runs_that_go_over_partitions(spark):
    """The forest's links join each run whatever the partitions are."""
    paths = [bytes([0, 1] * nj.DEPTH)] * 50 + [bytes([0, 1] * 7 + [9, k]) for k in range(50)]
    sets = spark.createDataFrame([(k, [p]) for k, p in enumerate(paths)], "node long, paths array<binary>")
    forest = nj.forest_links(sets, 6)
    for depth, members in ((8, {50}), (7, {100}), (6, {100})):
        families = nj._families(forest, depth)
        assert {r["members"] for r in families.select("members").distinct().collect()} == members
        assert families.select("family").distinct().count() == 1
