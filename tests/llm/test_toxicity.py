import random
import zlib

from colloquy.llm import toxicity as tox

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("bcdfghklmn") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 3))) for _ in range(300)]


def text(extra=()):
    words = [RNG.choice(WORDS) for _ in range(25)]
    for w in extra:
        words.insert(RNG.randrange(len(words)), w)
    return " ".join(words) + "."


def corpus(n=400):
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        extra = [f"zorg{RNG.choice(['il', 'an', 'ut', 'e', 'o', 'ix'])}", "smarf"] if toxic else []
        rows.append((k, text(extra)))
        labels.append((k, int(toxic)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame([(d, 1, t, "x") for d, t in labels], "doc_id long, quality int, toxic int, text string")


def test_learns_words_and_beginnings(make, spark):
    rows, labels = corpus()
    grammar = tox.fit(make(rows), frame(spark, labels))
    assert "smarf" in grammar.words and any(p.startswith("zorg"[:4]) for p in grammar.prefixes)
    got = {r["doc_id"]: r for r in tox.score(make(rows), grammar).collect()}
    for k, toxic in labels:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert got[k]["predicted"] == toxic == int(got[k]["score"] >= 0.7)
    assert tox.keep_clean(make(rows), frame(spark, labels)).count() == sum(1 for _, t in labels if not t)


def test_copies_and_long_texts_teach_nothing(make, spark):
    rows, labels = corpus()
    copy = text(["uniqueword"])
    rows += [(1000 + k, copy) for k in range(60)] + [(2000, " ".join(f"{w} longword" for w in WORDS))]
    labels += [(1000 + k, 1) for k in range(60)] + [(2000, 1)]
    grammar = tox.fit(make(rows), frame(spark, labels))
    assert "uniqueword" not in grammar.words and "longword" not in grammar.words


def test_patterns_of_clauses():
    find = lambda classes, reported=False: tox.clause_patterns(classes, reported)
    assert find(["", "i"]) == ["insult"]
    assert find(["t", "", "i"]) == ["insult+target"] == find(["i", "", "", "t"])
    assert find(["n", "", "i"]) == ["insult+not"] and find(["n", "", "", "i"]) == ["insult"]
    assert find(["r", "", "t", "n", "h"]) == ["threat+target+not+report"]
    assert find(["i", "r", "i"]) == ["insult", "insult+report"]
    assert find(["i"], True) == ["insult+report"]
    scorer = tox.Scorer(tox.Grammar())
    assert scorer.clauses('He said "you idiot". Not stupid, fine.') == [["insult+target+report"], ["insult+not"]]
    assert scorer.score("you idiot") > scorer.score("not an idiot") > scorer.score("fine")


def test_labels_held_out_are_not_learned(make, spark):
    rows, labels = corpus()
    flipped = [(k, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, t in labels]
    a, b = (tox.fit(make(rows), frame(spark, x)) for x in (labels, flipped))
    assert (a.words, a.prefixes, a.weights, a.bias) == (b.words, b.prefixes, b.weights, b.bias)


def test_cases(make, spark):
    odd = [(1, None), (2, ""), (3, "you idiot " * 30000), (4, "fine."), (4, "fine."), (None, "moron")]
    for labels in ([], [(1, 1)], [(None, 1), (2, None), (3, 1), (3, 0), (4, 0)]):
        got = tox.score_toxicity(make(odd), frame(spark, labels)).collect()
        assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert tox.score_toxicity(make([]), frame(spark, [])).count() == 0


def test_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = tox.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    n, right = got.count(), got.where("predicted = toxic").count()
    assert right / n >= 0.95


def brute_patterns(classes, reported):
    """Scopes looked up for each event by itself."""
    out = []
    for k, c in enumerate(classes):
        if c in ("i", "h"):
            near = any(x == "t" for x in classes[max(0, k - tox.TARGET_REACH) : k + tox.TARGET_REACH + 1])
            negated = "n" in classes[max(0, k - tox.NEGATION_REACH) : k]
            told = reported or "r" in classes[:k]
            out.append({"i": "insult", "h": "threat"}[c] + "+target" * near + "+not" * negated + "+report" * told)
    return out


def test_composed_machines_agree_with_brute_force():
    rng = random.Random(8)
    for _ in range(3000):
        classes = [rng.choice(["", "", "", "i", "h", "t", "n", "r"]) for _ in range(rng.randint(0, 14))]
        reported = rng.random() < 0.3
        assert tox.clause_patterns(classes, reported) == brute_patterns(classes, reported)


def test_weights_are_those_of_the_arcs():
    symbols = ["n", "insult+target"]
    written, weights = tox.MACHINE.run(symbols, 1)
    assert written == ["n", "insult+target+not+report"]
    assert tox.PRIOR["insult"] * tox.FACTORS["target"] * weights[1] == tox.prior_weight(written[1])


def test_scores_agree_with_brute_force(make, spark):
    """Every text is scored again from its grammar, clause by clause."""
    import math
    import re

    rows, labels = corpus(200)
    extra = ['She said "you idiot". Not stupid! You are no moron', "kill " * 40 + ". " + "idiot. " * 30, None, "", "no; never; you", "zorgix\n\"smarf\n you smarf"]
    rows += [(5000 + k, t) for k, t in enumerate(extra)]
    grammar = tox.fit(make(rows), frame(spark, labels))

    def score(text):
        found, quoted = [], False
        for line in re.split("(\n)", (text or "").lower()):
            if line == "\n":
                quoted = False
            for clause in re.split("[.!?;:\n]", line):
                at_start, words = quoted, []
                for token in re.findall(r"[^\W_]+|[\"“”«»]", clause):
                    if token in tox.QUOTES:
                        quoted = not quoted
                    else:
                        words.append(grammar.classify(token))
                found.append(brute_patterns(words, quoted) if words else [])
        worst = sorted((max(map(grammar.weight, p)) for p in found if p), reverse=True)
        z = sum(w / 2**k for k, w in enumerate(worst)) if worst else grammar.without
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z + grammar.bias))))

    got = {r["doc_id"]: r["score"] for r in tox.score(make(rows), grammar).collect()}
    assert all(abs(got[d] - score(t)) < 1e-12 for d, t in rows)
