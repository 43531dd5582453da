"""Toxicity by a weighted finite-state pattern grammar.

A clause is a string of word classes (insult, threat, target, negation, report).  Three transducers with
weighted arcs rewrite it: the target transducer marks an insult or threat near a target, the negation
transducer one that a negation reaches, the report transducer one inside reported speech; each arc that
marks multiplies the weight.  Targets also count when they follow, which no machine that reads from the
left can tell: the target transducer first reads the clause from its end.  The three are composed to one
machine that reads each clause once more, and what it writes are patterns, such as ``insult``,
``insult+target`` or ``insult+not+report``.  Labelled rows replace the arcs' weights of a pattern by what they
show.  A document's score is a logistic function of the weights of its clauses, the worst first, each
counting half as much as the one before.

Insults are a seed list and what labelled rows teach: words, and beginnings of words for languages
that attach endings, that stand in many different contexts of toxic documents and hardly elsewhere.
Contexts, not occurrences, are counted, so that copies of one document teach nothing new, and then
documents, so that one long text does not either.  Pattern
weights are smoothed log odds.  The fit uses a bounded sample of labelled rows (``rows_per_label`` rows
of each label, as expected value, chosen by a hash of the id); scores use the text only.

Cases: a null or empty text has the score of a text without pattern; rows of ``labels`` without id or
label are ignored, and an id with two labels is toxic; without labels the seeds' own weights hold;
repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, drop, id_crc, map_texts, original, prefixed

TOKEN = re.compile(r"[^\W_]+|[.!?;:\n\"“”«»]")
WORD = re.compile(r"[^\W_]+")
CLAUSE_ENDS, QUOTES = frozenset(".!?;:\n"), frozenset("\"“”«»")
FOLDS, HELD_OUT = 3, 1
ROWS_PER_LABEL = 5000
THRESHOLD = 0.7
SCALE = 1 << 31
PREFIXES = (6, 5, 4)
#: Least log-likelihood ratio, odds and number of contexts of a learned entry, of words that share a
#: beginning, and of documents.
MIN_LLR, MIN_ODDS, MIN_CONTEXTS, MIN_WORDS, MIN_DOCUMENTS = 16.0, 20.0, 8, 3, 5
NEGATION_REACH, TARGET_REACH = 2, 4
PRIOR_ROWS = 5.0
MEMO_WORDS = 200_000

INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers pathetic scum worthless trash clown disgusting dumb imbecile "
    "dummkopf abschaum idiota idiotas estúpido estúpida imbécil imbécile imbéciles crétin abruti basura".split()
)
THREATS = frozenset("kill hurt destroy strangle stab töten umbringen tuer égorger matar apuñalar".split())
TARGETS = frozenset("you your yours u du dich dir ihr euch tu te toi vous tú ti usted ustedes he she him her they them er sie il elle ils él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor nicht kein keine nie niemals pas jamais aucun nunca jamás ni".split())
REPORTS = frozenset("said says say wrote writes called calls quoted reported claims claimed sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split())
PRIOR = {"insult": 4.0, "threat": 3.0}
FACTORS = {"target": 1.25, "not": 0.25, "report": 0.25}


@dataclass
class Grammar:
    """What the transducers need: learned entries, pattern weights and the log odds without pattern."""

    words: frozenset[str] = frozenset()
    prefixes: frozenset[str] = frozenset()
    weights: dict[str, float] = field(default_factory=dict)
    without: float = -0.5
    bias: float = math.log(0.1 / 0.9)

    def classify(self, word: str) -> str:
        if word in INSULTS or word in self.words:
            return "i"
        if word in THREATS:
            return "h"
        if word in TARGETS:
            return "t"
        if word in NEGATIONS:
            return "n"
        if word in REPORTS:
            return "r"
        return "i" if any(word[:n] in self.prefixes for n in PREFIXES if len(word) > n) else ""

    def weight(self, pattern: str) -> float:
        if pattern in self.weights:
            return self.weights[pattern]
        return prior_weight(pattern)


def prior_weight(pattern: str) -> float:
    """The product of the weights on the arcs that write this pattern."""
    kind, *scopes = pattern.split("+")
    return PRIOR[kind] * math.prod(FACTORS[s] for s in scopes)


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: from state and symbol to the next state, the symbol written and a weight."""

    starts: tuple
    arcs: dict[tuple, tuple]

    def run(self, symbols: list[str], start: int = 0) -> tuple[list[str], list[float]]:
        """What is written for ``symbols`` from one of the start states, and the weights of the arcs."""
        state, out, weights = self.starts[start], [], []
        for symbol in symbols:
            state, written, weight = self.arcs[state, symbol]
            out.append(written)
            weights.append(weight)
        return out, weights


def is_event(symbol: str) -> bool:
    return symbol.partition("+")[0] in PRIOR


def scope(trigger: str, mark: str, reach: int | None, symbols: list[str]) -> Transducer:
    """Marks events within ``reach`` words behind a trigger; without reach, all that follow it."""
    arcs = {}
    for left in range((reach or 1) + 1):
        for symbol in symbols:
            marks = left > 0 and is_event(symbol) and mark not in symbol.split("+")
            after = (reach or 1) if symbol == trigger else max(left - 1, 0) if reach else left
            arcs[left, symbol] = after, f"{symbol}+{mark}" if marks else symbol, FACTORS[mark] if marks else 1.0
    return Transducer((0, reach or 1), arcs)


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The machine that writes what ``second`` writes for the output of ``first``; it starts with the second's starts."""
    starts = tuple((first.starts[0], q) for q in second.starts)
    arcs, todo = {}, list(starts)
    while todo:
        p, q = state = todo.pop()
        if (state, symbols[0]) in arcs:
            continue
        for symbol in symbols:
            p2, between, w1 = first.arcs[p, symbol]
            q2, written, w2 = second.arcs[q, between]
            arcs[state, symbol] = (p2, q2), written, w1 * w2
            todo.append((p2, q2))
    return Transducer(starts, arcs)


def _marked(symbols: list[str], *marks: str) -> list[str]:
    for mark in marks:
        symbols = symbols + [f"{s}+{mark}" for s in symbols if is_event(s) and mark not in s.split("+")]
    return symbols


CLASSES = {"": "", "i": "insult", "h": "threat", "t": "t", "n": "n", "r": "r"}
_PLAIN = list(CLASSES.values())
_TARGET_BEHIND = scope("t", "target", TARGET_REACH, _PLAIN)
_TARGETED = _marked(_PLAIN, "target")
#: The target, negation and report transducers as one; its second start is inside a quotation.
MACHINE = compose(
    compose(scope("t", "target", TARGET_REACH, _TARGETED), scope("n", "not", NEGATION_REACH, _TARGETED), _TARGETED),
    scope("r", "report", None, _marked(_TARGETED, "not")), _TARGETED,
)


def clause_patterns(classes: list[str], reported: bool) -> list[str]:
    """The patterns that the machines write for the word classes of one clause."""
    symbols = [CLASSES[c] for c in classes]
    if not ("insult" in symbols or "threat" in symbols):
        return []
    backwards, _ = _TARGET_BEHIND.run(symbols[::-1])
    written, _ = MACHINE.run(backwards[::-1], int(reported))
    return [p for p in written if is_event(p)]


class Scorer:
    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.memo: dict[str, str] = {}

    def _class(self, word: str) -> str:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        return self.memo.setdefault(word, self.grammar.classify(word))

    def clauses(self, text: str | None) -> list[list[str]]:
        """The patterns of every clause that has any."""
        lowered = (text or "").lower()
        memo = self.memo
        kinds = set()
        for w in set(WORD.findall(lowered)):
            kinds.add(memo[w] if w in memo else self._class(w))
        if "i" not in kinds and "h" not in kinds:
            return []
        out, classes, quoted = [], [], False
        for token in [*TOKEN.findall(lowered), "."]:
            if token in QUOTES:
                quoted = not quoted
            elif token in CLAUSE_ENDS:
                if classes and (found := clause_patterns(classes, quoted)):
                    out.append(found)
                classes = []
                quoted = quoted and token != "\n"
            else:
                classes.append(self._class(token))
        return out

    def score(self, text: str | None) -> float:
        found = self.clauses(text)
        if not found:
            z = self.grammar.without
        else:
            scores = sorted((max(map(self.grammar.weight, c)) for c in found), reverse=True)
            z = sum(math.ldexp(s, -k) for k, s in enumerate(scores))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z + self.grammar.bias))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_crc(doc_id) % FOLDS == HELD_OUT, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows_per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """text and toxic of a bounded sample of training rows; how many training rows each label has."""
    train = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    train = train.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, int(min(1.0, rows_per_label / max(1, sizes.get(1, 0))) * SCALE)).otherwise(int(min(1.0, rows_per_label / max(1, sizes.get(0, 0))) * SCALE))
    chosen = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(SCALE)) < share)
    # at most about 2 * rows_per_label ids, whatever the size of the tables
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("doc_id", "text", "toxic"), sizes


def _lexicon(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    placed = sample.select("toxic", F.posexplode(F.zip_with(tokens, F.concat(F.array(F.lit("")), tokens), lambda w, before: F.struct(w.alias("w"), before.alias("before")))).alias("k", "x"))
    contexts = placed.where("x.w is not null").select("toxic", "x.w", "x.before").distinct()
    counted = [F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")]
    words = cut(contexts.groupBy("w").agg(*counted).where(F.length("w") > 2), "tox_words")
    total = words.agg(F.sum("pos"), F.sum("neg")).first()
    if not total[0] or not total[1]:
        drop(words)
        return frozenset(), frozenset()
    p0 = total[0] / (total[0] + total[1])
    n, pos, neg = F.col("pos") + F.col("neg"), F.col("pos"), F.col("neg")
    llr = 2 * (pos * F.log(pos / (n * p0)) + F.when(neg > 0, neg * F.log(neg / (n * (1 - p0)))).otherwise(0.0))
    odds = ((pos + 0.5) / (total[0] + 1)) / ((neg + 0.5) / (total[1] + 1))
    strong = (pos >= MIN_CONTEXTS) & (llr >= MIN_LLR) & (odds >= MIN_ODDS)
    prefixes = words.select("w", "pos", "neg", F.explode(F.array(*[F.lit(k) for k in PREFIXES])).alias("k")).where("length(w) > k")
    prefixes = prefixes.groupBy(F.expr("substring(w, 1, k)").alias("w")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count("*").alias("many"))
    found = Grammar(
        frozenset(r["w"] for r in words.where("pos > 0").where(strong).select("w").collect()),
        frozenset(r["w"] for r in prefixes.where(f"pos > 0 and many >= {MIN_WORDS}").where(strong).select("w").collect()),
    )
    drop(words)
    return _in_many_documents(sample, found)


def _in_many_documents(sample: DataFrame, found: Grammar) -> tuple[frozenset[str], frozenset[str]]:
    """Entries that stand in many toxic documents and few others: a long text alone has many contexts."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for y, t in zip(batch["toxic"], batch["text"], strict=True):
                words = set(WORD.findall(t.lower()))
                own = words & found.words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n and w[:n] in found.prefixes}
                rows += [(y, w) for w in own]
            yield pd.DataFrame(rows, columns=["toxic", "w"])

    told = sample.select("toxic", "text").mapInPandas(entries, "toxic int, w string")
    counts = told.groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")).collect()
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    kept = set()
    for r in counts:
        pos, n = r["pos"], r["pos"] + r["neg"]
        llr = 2 * sum(k * math.log(k / (n * p)) for k, p in ((pos, share), (r["neg"], 1 - share)) if k)
        odds = ((pos + 0.5) / (sizes.get(1, 0) + 1)) / ((r["neg"] + 0.5) / (sizes.get(0, 0) + 1))
        if pos >= MIN_DOCUMENTS and llr >= MIN_LLR and odds >= MIN_ODDS:
            kept.add(r["w"])
    return frozenset(w for w in kept if w[-1] != "*"), frozenset(w[:-1] for w in kept if w[-1] == "*")


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Grammar:
    """Learn from labelled rows that are not held out."""
    sample, sizes = _sample(docs, labels, rows_per_label)
    sample = cut(sample, "tox_sample")
    if not sizes.get(0) or not sizes.get(1):
        return Grammar()
    words, prefixes = _lexicon(sample)
    grammar = Grammar(words, prefixes)

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(grammar)
        for batch in batches:
            rows = [(y, p) for y, t in zip(batch["toxic"], batch["text"], strict=True) for p in ({p for c in scorer.clauses(t) for p in c} or {""})]
            yield pd.DataFrame(rows, columns=["toxic", "pattern"])

    told = sample.select("toxic", "text").mapInPandas(patterns, "toxic int, pattern string")
    rows = told.groupBy("pattern").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")).collect()
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    drop(sample)
    odds = {r["pattern"]: math.log((r["pos"] + 0.5) / (totals.get(1, 0) + 1)) - math.log((r["neg"] + 0.5) / (totals.get(0, 0) + 1)) for r in rows}
    seen = {r["pattern"]: r["pos"] + r["neg"] for r in rows}
    weights = {p: (seen[p] * odds[p] + PRIOR_ROWS * prior_weight(p)) / (seen[p] + PRIOR_ROWS) for p in odds if p}
    return Grammar(words, prefixes, weights, odds.get("", -0.5), math.log(sizes[1] / sizes[0]))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = map_texts(rows, lambda: _scores(grammar), "score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _scores(grammar: Grammar):
    scorer = Scorer(grammar)
    return lambda texts: (None, [[scorer.score(t) for t in texts]])


def score_toxicity(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    return score(docs, fit(docs, labels, rows_per_label))


def keep_clean(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic."""
    grammar = fit(docs, labels, rows_per_label)

    own = prefixed(docs)
    scored = map_texts(own, lambda: _scores(grammar), "_toxicity double", keep=own.columns, read=("_doc_text",))
    return scored.where(F.col("_toxicity") < THRESHOLD).select(*original(docs))
