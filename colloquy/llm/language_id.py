"""Language identification by word-first backoff.

Known words are scored by their log frequency in each language.  An unseen word falls back to its
character n-grams, five letters first and then progressively shorter ones, down to single letters.

The model is fitted on a bounded sample of labelled rows (``rows_per_lang`` rows, as expected value,
of each language, chosen by a hash of the id); prediction reads texts only.

Cases: a null text, or one without a letter, is ``und`` with score 0; if nothing can be learned every
text is ``und``; ties go to the language first in order; repeated rows are judged alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, drop, id_crc, map_texts

LONGEST = 5
FOLDS, HELD_OUT = 5, 0
ROWS_PER_LANG, MIN_WORD, MIN_GRAM = 3000, 3, 2
MEMO_ROWS = 200_000
SCALE = 1 << 31


class Letters(dict):
    """For str.translate: letters, which Java's \\p{L} counts words by, stay; all else is a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() else 32
        return self[code]


LETTERS = Letters()


def found_words(text: str) -> list[str]:
    return text.lower().translate(LETTERS).split()


def held_out(doc_id) -> Column:
    return F.coalesce(id_crc(doc_id) % FOLDS == HELD_OUT, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, langs: list[str], words: list[tuple[str, list[int]]], ngrams: list[tuple[str, list[int]]]):
        self.langs = langs
        self.words, self.word_logs = self._table(words, len(langs))
        self.grams, self.gram_logs = self._table(ngrams, len(langs), by_length=True)

    @staticmethod
    def _table(rows: list[tuple[str, list[int]]], n: int, by_length: bool = False) -> tuple[dict, np.ndarray]:
        rows = sorted(rows)
        counts = np.array([c for _, c in rows], dtype=np.float64).reshape(len(rows), n) + 0.5
        group = np.array([len(k) if by_length else 0 for k, _ in rows], dtype=np.int64)
        logs = np.zeros_like(counts)
        for g in np.unique(group):
            own = group == g
            logs[own] = np.log(counts[own] / counts[own].sum(axis=0))
        return {k: i for i, (k, _) in enumerate(rows)}, logs

    def score_word(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.word_logs[at]
        for n in range(LONGEST, 0, -1):
            known = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if known:
                return self.gram_logs[known].mean(axis=0)
        return np.zeros(len(self.langs))


class Predictor:
    """Scores texts; rows of words it has met are kept, up to MEMO_ROWS of them."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((MEMO_ROWS, max(1, len(self.model.langs))))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(found_words(text)) if text and self.model.langs else {}
        if not words:
            return "und", 0.0
        total = np.zeros(len(self.model.langs))
        items = list(words.items())
        for lo in range(0, len(items), MEMO_ROWS // 4):
            part = items[lo : lo + MEMO_ROWS // 4]
            if len(self.at) + len(part) > MEMO_ROWS:
                self._clear()
            for w, _ in part:
                if w not in self.at:
                    self.rows[len(self.at)] = self.model.score_word(w)
                    self.at[w] = len(self.at)
            index = np.fromiter((self.at[w] for w, _ in part), np.int64, len(part))
            total += np.fromiter((c for _, c in part), np.float64, len(part)) @ self.rows[index]
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Learn from text and non-null lang of documents that are not held out."""
    train = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], [])
    keep = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, rows_per_lang / sizes[k]) * SCALE))])
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(SCALE)) < keep[F.col("lang")])
    tokens = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    per_lang = [F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, k in enumerate(langs)]
    words = cut(tokens.groupBy("lang", "w").agg(F.count("*").alias("n")), "lang_words")
    padded = F.concat(F.lit("_"), F.col("w"), F.lit("_"))
    long_enough = lambda n: F.when(
        F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    each = F.flatten(F.array(*[long_enough(n) for n in range(2, LONGEST + 1)]))
    gram_rows = words.select("lang", "n", F.explode(F.array_union(each, F.split("w", ""))).alias("w"))

    def collected(rows: DataFrame, least: int) -> list[tuple[str, list[int]]]:
        out = rows.where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"), *per_lang).where(F.col("n") >= least)
        return [(r["w"], [r[f"c{i}"] for i in range(len(langs))]) for r in out.collect()]

    model = Model(langs, collected(words, MIN_WORD), collected(gram_rows, MIN_GRAM))
    drop(words)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""

    def make():
        predictor = Predictor(model)

        def told(texts: list) -> tuple[None, list[list]]:
            found = [predictor.predict(t) for t in texts]
            return None, [[lang for lang, _ in found], [score for _, score in found]]

        return told

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_texts(rows, make, "lang_pred string, score double")


def identify_languages(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    return predict(docs, fit(docs, rows_per_lang))
