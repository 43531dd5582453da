import zlib

from colloquy.llm import language_id as lid

TEXTS = {"en": "the house and the garden of the king", "de": "das haus und der garten des königs", "fr": "la maison et le jardin du roi"}


def rows(n=40):
    return [(i, " ".join(TEXTS[k].split()[j % 5 :] + TEXTS[k].split()), k) for j in range(n) for i, k in ((3 * j + t, k) for t, k in enumerate(TEXTS))]


def test_folds_and_cases(make):
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 !", None), (905, "½ ² Ⅷ ①", None), (903, "the house", None), (903, "the house", None), (None, "das haus", "de"), (904, "gartens königin " * 20000, "de")]
    docs = make(rows() + odd)
    got = lid.identify_languages(docs).collect()
    assert len(got) == len(rows()) + len(odd) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    told = {r["doc_id"]: r["lang_pred"] for r in got}
    assert told[900] == told[901] == told[902] == told[905] == "und" and told[903] == "en" and told[904] == "de"


def test_unseen_words_fall_back_to_shorter_grams():
    model = lid.Model(["a", "b"], [("known", [5, 1]), ("other", [1, 5])], [("x", [1, 9]), ("xy", [9, 1]), ("xyzw_", [1, 99]), ("abcde", [99, 1]), ("ab", [1, 9]), ("a", [9, 1])])
    assert model.score_word("known")[0] > model.score_word("known")[1]
    assert model.score_word("xyzw").argmax() == 1  # five letters
    assert model.score_word("xyq").argmax() == 0  # two letters
    assert model.score_word("xq").argmax() == 1  # one letter
    assert not model.score_word("qqq").any()


def test_held_out_labels_are_not_learned(make):
    kept = make(rows())
    flipped = make([(i, t, "fr" if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows()])
    strip = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in lid.identify_languages(df).collect())
    assert strip(kept) == strip(flipped)


def test_nothing_to_learn(make, spark):
    assert {r["lang_pred"] for r in lid.identify_languages(make([(1, "a", None), (2, "b", None)])).collect()} == {"und"}
    assert lid.identify_languages(make([])).count() == 0


def test_accuracy(sample, spark):
    model = lid.fit(sample)
    joined = lid.predict(sample, model).join(sample.select("doc_id", "lang"), "doc_id").where("held_out")
    right = joined.where("lang = lang_pred").count() / joined.count()
    assert right >= 0.9


def brute(rows):
    """Counts, backoff and scores with plain dictionaries over all training rows."""
    import math
    from collections import Counter

    letters = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    words, shorter = {}, {}
    for i, t, k in rows:
        if k is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            words.setdefault(k, Counter()).update(letters(t))
    langs = sorted(words)
    for k in langs:
        shorter[k] = Counter()
        for w, n in words[k].items():
            for g in set(w) | {f"_{w}_"[a : a + size] for size in range(2, 6) for a in range(len(w) + 3 - size)}:
                shorter[k][g] += n
    word_rows = [w for w in set().union(*words.values()) if sum(words[k][w] for k in langs) >= 3]
    gram_rows = [g for g in set().union(*shorter.values()) if sum(shorter[k][g] for k in langs) >= 2]
    total = {k: sum(words[k][w] + 0.5 for w in word_rows) for k in langs}
    sized = {(k, n): sum(shorter[k][g] + 0.5 for g in gram_rows if len(g) == n) for k in langs for n in range(1, 6)}

    def logs(w, k):
        if w in word_rows:
            return math.log((words[k][w] + 0.5) / total[k])
        for n in range(5, 0, -1):
            known = [g for g in (f"_{w}_"[a : a + n] for a in range(len(w) + 3 - n)) if g in gram_rows]
            if known:
                return sum(math.log((shorter[k][g] + 0.5) / sized[k, n]) for g in known) / len(known)
        return 0.0

    out = []
    for i, t, _ in rows:
        scores = {k: sum(logs(w, k) for w in letters(t)) for k in langs}
        best = max(langs, key=lambda k: (scores[k], -langs.index(k)))
        out.append((i, best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())) if letters(t) else (i, "und", 0.0))
    return out


def test_agrees_with_brute_force(make):
    extra = [(900, "the unseen wordlike gardenia of haus", None), (901, "zu", "de"), (902, "zu zu x", "de"), (903, "kö", None), (904, "½", "en"), (905, None, "fr"), (906, "q", None), (907, "im am", None)]
    docs = rows(12) + extra
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lid.identify_languages(make(docs)).collect()}
    for i, lang, score in brute(docs):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, i


def test_words_are_letters_at_any_code_point():
    text = "".join(f"a{chr(c)}b " for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    want = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    assert lid.Predictor(lid.Model(["x"], [], [])).predict("½ ² Ⅷ ①_1") == ("und", 0.0)
    assert lid.found_words(text) == want


def test_prediction_is_not_slowed_by_finding_words():
    """A class of all numerals took twenty times as long as plain words do."""
    import re
    import time

    text, predictor = "The house and the garden of the king, 12 of them. " * 10000, lid.Predictor(lid.Model(["x"], [("the", [1])], []))

    def seconds(f):
        took = []
        for _ in range(3):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert seconds(lambda: predictor.predict(text)) < 5 * seconds(lambda: re.findall(r"\w+", text.lower()))
