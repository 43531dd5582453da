import random

import corpus_pipeline
from colloquy.llm import decontamination, line_dedup, packing, toxicity
from tests.llm.brute import left_after_dedup, spans_hit

RNG = random.Random(31)
WORDS = ["".join(RNG.choice("bcdfghklmn") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 4))) for _ in range(900)]
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, key string, _maybe boolean"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def toxic():
    words = prose(40).split()
    for w in ("zorgil", "zorgan", "zorgut", "smarf", "smarf", "you"):
        words.insert(RNG.randrange(len(words)), w)
    return " ".join(words)


def corpus():
    """(id, text), labels, benchmark items, and the ids of each kind that is planted."""
    items = [(f"b{k}", prose(30)) for k in range(6)]
    shared = [prose(60) for _ in range(4)]
    rows, labels, kinds = [], [], {"toxic": [], "shared": [], "near": [], "leak": []}

    def add(text, kind=None):
        rows.append((len(rows) + 1, text))
        labels.append((len(rows), 1, int(kind == "toxic")))
        kinds.setdefault(kind, []).append(len(rows))

    for k in range(150):
        add(prose(RNG.randint(30, 90)))
        if k % 3 == 0:
            add(toxic(), "toxic")
    for k in range(12):
        add(f"{prose(25)} {shared[k % 4]} {prose(25)}", "shared")
    for k in range(8):
        # too short for line dedup, so that they are there for the join
        text = prose(22).split()
        add(" ".join(text), "near")
        text[0] = "bababa"
        add(" ".join(text), "near")
    for k in range(6):
        add(f"{prose(30)} {items[k][1]} {prose(30)}", "leak")
    rows += [(len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, "!!"), (None, prose(20)), rows[0], rows[0], (len(rows) + 9, prose(9000))]
    return rows, labels, items, kinds


def write(spark, root, rows, labels, items):
    full = [(d, t, "en", "s", None if t is None else len(t), 0.5, 7, "k", True) for d, t in rows]
    spark.createDataFrame(full, DOCUMENT).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")


def told(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)


def test_every_stage_agrees_with_brute_force(spark, tmp_path):
    rows, labels, items, kinds = corpus()
    root = f"file://{tmp_path}/t"
    write(spark, root, rows, labels, items)
    docs, before = spark.read.parquet(f"{root}/documents.parquet"), sorted(rows, key=str)
    for name, stage in corpus_pipeline.STAGES:
        docs_before, out = docs, stage(spark, docs, root)
        if name == "packing":
            break
        assert out.columns == docs.columns
        path = f"{root}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = told(docs)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())
        if name == "toxicity":
            gone = {d for d, _ in before} - {d for d, _ in after}
            scorer = toxicity.Scorer(toxicity.fit(docs_before, spark.read.parquet(f"{root}/labels.parquet")))
            assert gone == {d for d, t in before if scorer.score(t) >= toxicity.THRESHOLD} and [r for r in before if r[0] not in gone] == after
            assert gone <= set(kinds["toxic"]) and len(gone) >= 0.9 * len(kinds["toxic"])
        elif name == "line_dedup":
            assert after == sorted(left_after_dedup(before, line_dedup.MIN_RUN, line_dedup.MIN_WORDS), key=str)
            assert {d for d, _ in after} == {d for d, _ in before}
        elif name == "ngram_join":
            # a repeated row and the second of two near copies go, nothing else
            want = sorted(set(before), key=str)
            assert after == [r for r in want if r[0] not in set(kinds["near"][1::2])]
        else:
            want = []
            for d, t in before:
                words, hit = spans_hit(t, [x for _, x in items], decontamination.WINDOW)
                if sum(b - a for a, b in hit) <= decontamination.MAX_COVERAGE * len(words):
                    want.append((d, decontamination.remove_words(t, hit) if hit else t))
            assert after == sorted(want, key=str) and {d for d, _ in after} == {d for d, _ in before}
            assert sum(a != b for a, b in zip(before, after, strict=True)) == len(items)
        before = after
    pieces = out.collect()
    encode = packing.encoder(packing._tokenizer_path(None)).encode
    lengths = {}
    for d, t in before:
        lengths.setdefault(d, []).append(len(encode(t or "")) // 4)
    assert {d: sum(x) for d, x in lengths.items()} == {d: sum(r["length"] for r in pieces if r["doc_id"] == d) for d in lengths}
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for taken in places.values():
        end = 0
        for offset, length in sorted(taken):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    rows, labels, items, _ = corpus()
    root = f"file://{tmp_path}/t"
    write(spark, root, rows[:40], labels, items)
    got = corpus_pipeline.run(spark, root)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() >= 25
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]


def test_empty_tables(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    write(spark, root, [], [], [])
    assert corpus_pipeline.run(spark, root).count() == 0
