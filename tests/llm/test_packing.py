import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from colloquy.llm import packing

P = packing._tokenizer_path(None)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(P)


def reference(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


ODD = [
    "", None, "I'll don't 's're x²y ǆ İI ñÑ ÀÉ ſ ± a\x1cb it''s ...'s 12.5", "ẞ Σας ΑΣ 日本 😀👍🏽", "'LL 'S can't'VE", "a×b÷c _x_ a_b", "<|endoftext|> <|", "é é İ", "\x0b\x0c\x85\xa0x", "ĳ Ŀ ŀ ŉ Ž",
]


def test_ids_are_those_of_the_tokenizer(encoder, sample):
    texts = ODD + [r["text"] for r in sample.select("text").collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice("aZ'9 .,-sl\nßÉ|_~") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t or ""), "<u4").tolist() == reference(encoder, t), t


def best_fit(lengths, capacity):
    """Best fit, longest first, a piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


def test_plan_is_best_fit():
    rng = random.Random(8)
    for trial in range(200):
        capacity = rng.choice([10, 50, 200])
        lengths = [min(capacity, rng.choice([1, 2, 3, rng.randint(1, capacity)])) for _ in range(rng.randint(0, 120))]
        used, ranks = defaultdict(int), defaultdict(set)
        for length, rank, n, first, each, offset in packing.best_fit_plan(dict(Counter(lengths)), capacity):
            for j in range(n):
                assert used[first + j // each] == offset + j % each * length
                used[first + j // each] += length
                ranks[length].add(rank + j)
        assert {k: len(v) for k, v in ranks.items()} == dict(Counter(lengths))
        assert sorted(capacity - u for u in used.values()) == best_fit(lengths, capacity), trial


def check(rows, packed, encoder, capacity):
    by_seq, pieces = defaultdict(list), defaultdict(list)
    for r in packed:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for d, t in rows:
        ids = reference(encoder, t)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[(d, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    return len(by_seq), sum(n for s in by_seq.values() for _, n in s)


def test_all_documents_are_packed(make, encoder):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "g", "delta7"]) for _ in range(rng.choice([3, 3, 3, 20, 90])))) for k in range(300)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(5, "again"), (5, "again"), (None, "no id"), (2000, "long text " * 4000)]
    packed = packing.pack_documents(make(rows), capacity=64).collect()
    n, total = check(rows, packed, encoder, 64)
    assert n <= -(-total // 64) * 1.05 + 1
    assert packing.pack_documents(make([])).count() == 0


def test_one_length_may_be_most_of_all(make, encoder):
    rows = [(k, "same words here") for k in range(500)] + [(900 + k, "x") for k in range(20)]
    n, total = check(rows, packing.pack_documents(make(rows), capacity=32).collect(), encoder, 32)
    assert n <= -(-total // 32) * 1.1 + 1
