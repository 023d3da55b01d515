"""Toxicity scores from weak supervision.

Voters.  Words, word beginnings, and beginnings that are frequent within a text
and that mark toxic rows are mined with smoothed log-odds from all labelled rows of
the training folds; they are dealt to lexicon voters by strength, and pattern voters look at how often, how densely and how closely together they
occur.  A small fixed lexicon votes too, so that there is a model without labels.

Label model.  The voters' joint patterns are counted over all documents.  A
generative model with one hidden class explains them: each voter fires with a
probability that depends on the class and on one other voter, chosen by a
maximum spanning tree over the correlations that remain inside the classes.
Expectation maximisation fits these accuracies and correlations; training labels
only start it.

Classifier.  A logistic regression is trained on the posterior labels of a
sample, and gives the score.  The sample holds about ``max_train`` labelled rows
of the training folds, chosen by a hash of the id; terms are counted on all labelled
rows of these folds, patterns on all rows.  Labels, language, source and id are never inputs of a score.

Defined results for odd input: a null or empty text has no marks and gets the
classifier's base score; only labels 0 and 1 count, and several labels of an id
count each; without labels the fixed lexicon alone starts the model; a repeated
row is scored twice; a null id is in no fold, and its labels aren't learned from; an empty table gives an empty table.  Every distinct word
of a text is looked at, however long the text.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.workspace import forget, written

WORD = re.compile(r"[^\W\d_]+")
#: Common insults in four languages, a starting lexicon.
SEED_LEXICON = frozenset(
    "idiot idiots idiotic moron morons moronic stupid scum loser losers pathetic worthless disgusting trash clown dumb imbecile "
    "abschaum arschloch dummkopf idioten trottel vollidiot "
    "abruti connard crétin débile imbécile ordure salaud "
    "basura estúpido gilipollas idiota imbécil inútil asqueroso".split()
)
PREFIXES = (4, 5, 6)
#: Beginnings that count only where they are frequent in a text: in at least
#: DENSE_WORDS of its words, and in one in 100.
DENSE_PREFIXES = (3, 4, 5)
DENSE_WORDS, DENSE_SHARE = 3, 0.01
LEXICONS = 8
#: Pattern voters follow the lexicon voters: any seed word, at least 2 marked
#: words, at least 4, one in 100 words, one in 30 words, two within 8 words.
VOTERS = LEXICONS + 6
#: A term must be this many times likelier in toxic rows, as a logarithm.
MIN_LOG_ODDS = 2.5
MEMO_WORDS = 200_000


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def is_dense(n: int, n_words: int) -> bool:
    return n >= DENSE_WORDS and n >= DENSE_SHARE * n_words


class Features(NamedTuple):
    terms: list[int]
    numbers: list[float]
    pattern: int


class Lexicon:
    """Mined terms, and what a text shows of them.

    A term is a whole word or, with a final ``*``, the beginning of one, or with
    a final ``#`` a beginning that is frequent in the text.
    """

    def __init__(self, terms: list[tuple[str, float]]) -> None:
        self.index = {t: i for i, (t, _) in enumerate(terms)}
        self.size = len(terms)
        self.memo: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def terms_of(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The word's terms, and those that need more such words."""
        found = self.memo.get(word)
        if found is None:
            get = self.index.get
            keys = [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]
            dense = [word[:n] + "#" for n in DENSE_PREFIXES if len(word) >= n]
            found = tuple(i for k in keys if (i := get(k)) is not None), tuple(i for k in dense if (i := get(k)) is not None)
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def voter(self, term: int) -> int:
        return term * LEXICONS // max(1, self.size)

    def features(self, text: str | None) -> Features:
        words = WORD.findall((text or "").lower())
        counts = Counter(words)
        shown = {w: f for w in counts if any(f := self.terms_of(w))}
        often: Counter[int] = Counter()
        for w, (_, dense) in shown.items():
            for d in dense:
                often[d] += counts[w]
        frequent = {d for d, n in often.items() if is_dense(n, len(words))}
        marks = {w: {*single, *frequent.intersection(dense)} for w, (single, dense) in shown.items()}
        marks = {w: found for w, found in marks.items() if found}
        seeds = counts.keys() & SEED_LEXICON
        if not marks and not seeds:
            return Features([], [0.0] * 5, 0)
        marked = marks.keys() | seeds
        at = [i for i, w in enumerate(words) if w in marked]
        close = any(b - a <= 8 for a, b in zip(at, at[1:], strict=False))
        terms = sorted({t for ts in marks.values() for t in ts})
        rate = len(at) / len(words)
        fired = {self.voter(t) for t in terms}
        checks = [bool(seeds), len(at) >= 2, len(at) >= 4, rate >= 0.01, rate >= 1 / 30, close]
        fired |= {LEXICONS + i for i, on in enumerate(checks) if on}
        numbers = [math.log1p(len(at)), math.log1p(len(marked)), min(1.0, 20 * rate), float(bool(seeds)), float(close)]
        return Features(terms, numbers, sum(1 << v for v in fired))


class LabelModel:
    """Hidden-class model of voter patterns with tree-shaped correlations."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 25) -> None:
        """``start``: the first guess at P(toxic) of each pattern."""
        self.votes = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(np.int64)
        self.counts = counts.astype(float)
        self.parent = np.full(VOTERS, -1)
        posterior = self._fit(start, rounds)
        self.parent = self._tree(posterior)
        self.posterior = self._fit(posterior, rounds)
        self.of = dict(zip(patterns.tolist(), self.posterior.tolist(), strict=True))

    def _fit(self, posterior: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            log = np.zeros((len(self.votes), 2))
            for y, weight in enumerate((self.counts * (1 - posterior), self.counts * posterior)):
                total = weight.sum()
                log[:, y] = math.log((total + 1) / (self.counts.sum() + 2))
                for v, p in enumerate(self.parent):
                    on = self.votes[:, v] == 1
                    for case in (0, 1) if p >= 0 else (None,):
                        rows = np.ones(len(on), bool) if case is None else self.votes[:, p] == case
                        fire = (weight[rows & on].sum() + 0.5) / (weight[rows].sum() + 1.0)
                        log[rows, y] += np.where(on[rows], math.log(fire), math.log(1 - fire))
            posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        return posterior

    def _tree(self, posterior: np.ndarray) -> np.ndarray:
        """Parents in a maximum spanning tree of within-class mutual information."""
        gain = np.zeros((VOTERS, VOTERS))
        for weight in (self.counts * (1 - posterior), self.counts * posterior):
            total = weight.sum() + 4
            ones = (weight[:, None] * self.votes).sum(0)
            both = (self.votes * weight[:, None]).T @ self.votes
            for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
                marginal = [ones + 2 if x else total - 2 - ones for x in (a, b)]
                joint = both if (a, b) == (1, 1) else ones[:, None] - both if (a, b) == (1, 0) else ones[None, :] - both if (a, b) == (0, 1) else total - 4 - ones[:, None] - ones[None, :] + both
                joint = np.maximum(joint, 0) + 1
                gain += joint * np.log(joint * total / (marginal[0][:, None] * marginal[1][None, :]))
        parent, inside = np.full(VOTERS, -1), [0]
        best = gain[0].copy()
        source = np.zeros(VOTERS, dtype=int)
        best[0] = -np.inf
        while len(inside) < VOTERS:
            v = int(best.argmax())
            parent[v] = source[v]
            inside.append(v)
            best[v] = -np.inf
            closer = (gain[v] > best) & ~np.isin(np.arange(VOTERS), inside)
            best[closer], source[closer] = gain[v][closer], v
        return parent


class ToxicityModel(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray  # terms, then numbers, then the constant

    def score(self, text: str | None) -> float:
        f = self.lexicon.features(text)
        n = self.lexicon.size
        z = self.weights[f.terms].sum() + self.weights[n : n + len(f.numbers)] @ f.numbers + self.weights[-1]
        return 1 / (1 + math.exp(-min(max(z, -50.0), 50.0)))


def _logistic(rows: list[Features], target: np.ndarray, size: int, rounds: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by gradient descent with momentum."""
    width = size + 6
    row = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
    col = np.array([t for r in rows for t in r.terms], dtype=np.int64)
    dense = np.hstack([np.array([r.numbers for r in rows]).reshape(len(rows), 5), np.ones((len(rows), 1))])
    w = np.zeros(width)
    first, second = np.zeros(width), np.zeros(width)
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + dense @ w[size:]
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        grad = np.concatenate([np.bincount(col, weights=error[row], minlength=size), dense.T @ error]) / len(rows)
        grad[:-1] += l2 * w[:-1] / 10
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def _mine(text: str | None) -> set[str]:
    every = WORD.findall((text or "").lower())
    words = set(every)
    begun = Counter(w[:n] for w in every for n in DENSE_PREFIXES if len(w) >= n)
    dense = {p + "#" for p, n in begun.items() if is_dense(n, len(every))}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n} | dense


def mined_terms(labelled: DataFrame, n_terms: int, min_docs: int) -> list[tuple[str, float]]:
    """The terms whose presence speaks most for a toxic label, strongest first.

    ``labelled`` has ``text, toxic``.  Counts are summed per task before they are shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for t in _mine(text):
                    found.setdefault(t, [0, 0])[int(toxic)] += 1
            yield pd.DataFrame([(t, a, b) for t, (a, b) in found.items()], columns=["term", "clean", "toxic"])

    counted = labelled.mapInPandas(count, "term string, clean long, toxic long")
    counted = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = labelled.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not totals["n"]:
        return []
    clean_all, toxic_all = totals["n"] - totals["t"] + 1.0, totals["t"] + 1.0
    odds = F.ln((F.col("toxic") + 0.5) / F.lit(toxic_all)) - F.ln((F.col("clean") + 0.5) / F.lit(clean_all))
    # The lower end of the log-odds: two standard errors below.
    lower = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = counted.where(F.col("toxic") >= min_docs).withColumn("lower", lower).where(F.col("lower") > MIN_LOG_ODDS)
    return [(r["term"], r["lower"]) for r in strong.orderBy(F.desc("lower"), "term").limit(n_terms).collect()]


def labelled_rows(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``__id, toxic`` of the labels 0 and 1 in the training folds."""
    return labels.where(F.col(label).isin(0, 1) & in_training(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), F.col(label).cast("long").alias("toxic"))


def mined_lexicon(docs: DataFrame, known: DataFrame, id_col: str, text: str, n_terms: int = 1500, min_docs: int = 5) -> Lexicon:
    body = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("text"))
    # Labels grow with the rows, so texts of the training folds are shuffled at every size.
    return Lexicon(mined_terms(body.join(known.hint("merge"), "__id").select("text", "toxic"), n_terms, min_docs))


def marked(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``__marks``: each text's terms, numbers and voter pattern."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("struct<terms:array<int>,numbers:array<double>,pattern:int>")
    def marks(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.features(t) for t in column], columns=Features._fields)

    return docs.withColumn("__marks", marks(F.col(f"`{text}`")))


def learn(table: DataFrame, known: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", max_train: int = 12_000) -> ToxicityModel:
    """Label model and classifier from a written table of ids and ``__marks``."""
    share = F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < max(0, int(1_000_000 * min(1.0, max_train / max(1, known.count()))))
    body = table.select(F.col(f"`{id_col}`").alias("__id"), "__marks.*")
    # At most about max_train rows of two numbers: the sample's bound.
    rows = body.join(F.broadcast(known.where(share)), "__id").drop("__id").collect()
    found = [Features(list(r["terms"]), list(r["numbers"]), r["pattern"]) for r in rows]
    # At most 2 ** VOTERS rows.
    counts = body.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    every = {r["pattern"]: r["n"] for r in counts}
    every.setdefault(0, 1)
    patterns = np.array(sorted(every), dtype=np.int64)
    model = LabelModel(patterns, np.array([every[p] for p in patterns.tolist()]), _start(patterns, found, [r["toxic"] for r in rows]))
    if not found:  # no labels: learn from the patterns themselves
        votes = [[(p >> v) & 1 for v in range(LEXICONS, VOTERS)] for p in patterns.tolist()]
        found = [Features([], [math.log1p(2 * v[1] + 2 * v[2]), math.log1p(v[0] + v[1]), float(v[3]), float(v[0]), float(v[5])], p) for p, v in zip(patterns.tolist(), votes, strict=True)]
    target = np.array([model.of[f.pattern] for f in found])
    return ToxicityModel(lexicon, _logistic(found, target, lexicon.size))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = 12_000) -> ToxicityModel:
    """Voters, label model and classifier; see the module's description."""
    known = labelled_rows(labels, label)
    lexicon = mined_lexicon(docs, known, id_col, text)
    table = written(marked(docs.select(f"`{id_col}`", f"`{text}`"), lexicon, text).select(f"`{id_col}`", "__marks"), "toxic-marks")
    model = learn(table, known, lexicon, id_col, max_train)
    forget(table)
    return model


def fit_and_score(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = 12_000) -> DataFrame:
    """``toxicity`` of the documents a model is fitted on, with their columns ``keep``, the id among them.

    Each text is read for marks once: the kept columns are written with the marks,
    and both the model and the scores come from that table.
    """
    known = labelled_rows(labels, label)
    lexicon = mined_lexicon(docs, known, id_col, text)
    table = written(marked(docs, lexicon, text).select(*[f"`{c}`" for c in keep], "__marks"), "toxic-marks")
    return weighed(table, learn(table, known, lexicon, id_col, max_train))


def _start(patterns: np.ndarray, found: list[Features], toxic: list[int]) -> np.ndarray:
    """First posteriors: the share of toxic labels per pattern, pulled to its number of votes."""
    votes = np.array([bin(p).count("1") for p in patterns.tolist()])
    share = np.where(votes >= 3, 0.8, np.where(votes > 0, 0.3, 0.01))
    place = {p: i for i, p in enumerate(patterns.tolist())}
    seen, ones = np.zeros(len(patterns)), np.zeros(len(patterns))
    for f, y in zip(found, toxic, strict=True):
        seen[place[f.pattern]] += 1
        ones[place[f.pattern]] += y
    return (ones + 4 * share) / (seen + 4)


def weighed(table: DataFrame, model: ToxicityModel) -> DataFrame:
    """``toxicity`` in place of ``__marks``."""
    n = model.lexicon.size
    listed = lambda ws: F.from_json(F.lit(json.dumps(ws.tolist())), "array<double>")
    terms = F.aggregate("__marks.terms", F.lit(0.0), lambda total, t: total + F.get(listed(model.weights[:n]), t))
    numbers = F.zip_with("__marks.numbers", listed(model.weights[n:-1]), lambda x, w: x * w)
    z = terms + F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x) + F.lit(float(model.weights[-1]))
    return table.withColumn("toxicity", 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(z, F.lit(50.0)))))).drop("__marks")


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` from 0 to 1, which replaces a column of that name."""
    return weighed(marked(docs, model.lexicon, text), model)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "toxic")
