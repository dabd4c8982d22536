"""Toxicity scores by weak supervision.

1. Lexicons: words, and beginnings of words, that are much more frequent in documents labelled toxic, found on a bounded
   sample of labelled rows (``MAX_LABELLED``, chosen by a hash of the id).
2. Voters: slices of the lexicons vote 1 if one of their terms occurs, patterns of the text vote 1,
   and the absence of any lexicon term votes against.
3. Label model: a generative model of the votes given the hidden label, fitted by
   expectation-maximisation on the counts of vote patterns over all documents.  Accuracies are the
   conditional vote tables; correlations are the edges of a maximum spanning tree of conditional
   mutual information between voters (a voter depends on the label and on its parent).
4. A logistic regression over lexicon terms and patterns is fitted to the posterior labels of at
   most ``MAX_FITTED`` documents and scores every text.

Labels serve step 1 only, and only those of rows outside the held-out part.  Defined results: a
null text is the empty text and gets the score of a text without any feature; null ids and repeated rows are scored row by
row; several labels of an id count by their mean; without labels there are no terms and all scores are equal;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakfree.llm.common import part_of, sampled, ship, whole, word_array, written

FOLDS, HELD_OUT = 4, 2
MAX_LABELLED = 20_000
MAX_FITTED = 20_000
MAX_TERMS = 512
#: A term needs so many different toxic documents (rarer ones occur by chance), and this share of all with it.
LEAST_TOXIC = 8
PRECISION = 0.95
PREFIXES = (4, 5, 6, 7)
LEXICON_VOTERS = 6
CUT = 0.3
_LETTERS = re.compile(r"[^\W\d_]+")
#: Pattern voters: name and test of a text.
PATTERNS = (
    ("shouting", re.compile(r"!{2,}").search),
    ("capitals", re.compile(r"(?:\b[A-Z]{3,}\b\W+){4}").search),
    ("address", re.compile(r"\b(?:you|ihr|vous|vosotros)\b", re.I).search),
)
VOTERS = LEXICON_VOTERS + len(PATTERNS) + 1


def terms_of(text: str) -> set[str]:
    """Distinct lower-case words, and beginnings of longer words marked by a hyphen."""
    words = set(_LETTERS.findall(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in PREFIXES))


def lexicon(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, top: int = MAX_TERMS) -> list[str]:
    """Terms of documents labelled toxic, best first.  The sampled labels are the broadcast side;
    their number is bounded by ``most``."""
    ship(docs.sparkSession)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(part_of("doc_id", FOLDS) != HELD_OUT)
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    known = sampled(known, most, 1).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    # copies would make all their words look toxic: one document per smallest hash of five words stays
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0)))
    first = F.array_min(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, 5))))
    rows = rows.withColumn("w", word_array(F.col("text"))).withColumn("first", first)
    rows = rows.groupBy("first").agg(F.max(F.struct("y", "text")).alias("r")).select("r.text", "r.y")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts: dict[str, list[int]] = {}
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for t in terms_of(text):
                        c = counts.setdefault(t, [0, 0])
                        c[y] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                     pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "clean", "toxic"])

    counted = rows.select("text", "y").mapInArrow(split, "term string, clean bigint, toxic bigint")
    per = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    good = per.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    return [r["term"] for r in good.orderBy(F.desc("toxic"), "clean", "term").limit(top).collect()]


@dataclass
class Model:
    """Lexicon, label model and linear classifier: all that scoring needs (a few kB)."""

    terms: list[str]
    prior: float = 0.1
    tables: list[np.ndarray] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0

    def __post_init__(self):
        self.index = {t: i for i, t in enumerate(self.terms)}

    def features(self, text: str) -> list[int]:
        """Term numbers, then patterns."""
        found = [self.index[t] for t in terms_of(text) & self.index.keys()] if self.index else []
        return found + [len(self.terms) + i for i, (_, test) in enumerate(PATTERNS) if test(text)]

    def votes(self, features: list[int]) -> int:
        """One bit per voter; the last one is the absence of terms."""
        bits, n = 0, len(self.terms)
        for f in features:
            bits |= 1 << (f % LEXICON_VOTERS if f < n else LEXICON_VOTERS + f - n)
        return bits if any(f < n for f in features) else bits | 1 << VOTERS - 1

    def score(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[features].sum()))))


def _vote_matrix(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(VOTERS)) & 1


def _likelihood(v: np.ndarray, tables: list[np.ndarray], parents: list[int]) -> np.ndarray:
    """log P(votes | label) per row and label; tables[i][label, parent's vote, vote]."""
    out = np.zeros((len(v), 2))
    for i, (t, p) in enumerate(zip(tables, parents)):
        up = v[:, p] if p >= 0 else np.zeros(len(v), dtype=int)
        out += np.log(t[:, up, v[:, i]]).T
    return out


def _tables(v: np.ndarray, r: np.ndarray, parents: list[int]) -> list[np.ndarray]:
    out = []
    for i, p in enumerate(parents):
        t = np.full((2, 2, 2), 0.5)
        for y in (0, 1):
            for up in (0, 1):
                rows = (v[:, p] == up) if p >= 0 else np.full(len(v), True)
                for x in (0, 1):
                    t[y, up, x] += r[rows & (v[:, i] == x), y].sum()
        out.append(t / t.sum(axis=2, keepdims=True))
    return out


def _tree(v: np.ndarray, r: np.ndarray) -> list[int]:
    """Parents in a maximum spanning tree of I(vote i; vote j | label), roots -1."""
    n = v.shape[1]
    info = np.zeros((n, n))
    total = r.sum()
    if total <= 0:  # no rows
        return [-1] * n
    for i in range(n):
        for j in range(i):
            for y in (0, 1):
                joint = np.array([[r[(v[:, i] == a) & (v[:, j] == b), y].sum() for b in (0, 1)] for a in (0, 1)]) + 1e-9
                pj = joint / joint.sum()
                gain = (pj * np.log(pj / (pj.sum(1, keepdims=True) * pj.sum(0, keepdims=True)))).sum()
                info[i, j] += gain * joint.sum() / total
                info[j, i] = info[i, j]
    parents, inside = [-1] * n, [0]
    while len(inside) < n:
        i, j = max(((i, j) for i in inside for j in range(n) if j not in inside), key=lambda x: info[x])
        if info[i, j] > 1e-4:  # weaker ties count as independent
            parents[j] = i
        inside.append(j)
    return parents


def fit_label_model(model: Model, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation; returns the posterior of label 1 per vote pattern."""
    v, c = _vote_matrix(patterns), counts.astype(float)
    lexical = v[:, :LEXICON_VOTERS].sum(axis=1)
    q = np.where(lexical > 0, 0.5 + 0.45 * np.minimum(lexical, 3) / 3, 0.02)  # start: terms speak for toxic
    parents = [-1] * VOTERS
    for stage in range(2):
        for _ in range(rounds):
            r = np.column_stack([c * (1 - q), c * q])
            prior = np.clip(r[:, 1].sum() / max(r.sum(), 1e-9), 1e-4, 0.5)
            tables = _tables(v, r, parents)
            ll = _likelihood(v, tables, parents) + np.log([1 - prior, prior])
            q = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -500, 500)))
        if stage == 0:
            parents = _tree(v, np.column_stack([c * (1 - q), c * q]))
    model.prior, model.tables, model.parents = float(prior), tables, parents
    return q


def fit_linear(model: Model, features: list[list[int]], soft: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> None:
    """Logistic regression on soft labels by gradient steps with momentum."""
    k = len(model.terms) + len(PATTERNS)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features]).astype(int)
    col = np.array([f for x in features for f in x], dtype=int)
    w, b = np.zeros(k), 0.0
    vw, vb = np.zeros(k), 0.0
    n = max(len(features), 1)
    seen = np.maximum(np.bincount(col, minlength=k), 1)
    for _ in range(rounds if len(features) else 0):
        z = b + np.bincount(row, w[col], minlength=len(features))
        g = 1 / (1 + np.exp(-z)) - soft
        gw = np.bincount(col, g[row], minlength=k) / seen + l2 * w
        vw, vb = 0.9 * vw - 0.5 * gw, 0.9 * vb - 0.5 * g.sum() / n * 4
        w, b = w + vw, b + vb
    model.weights, model.bias = w, float(b)


def _observed(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, votes and features per document."""
    ship(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [model.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.votes(x) for x in f], pa.int64()),
                 pa.array(f, pa.list_(pa.int32()))], names=["doc_id", "votes", "features"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text")).mapInArrow(
        look, "doc_id bigint, votes bigint, features array<int>")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the documents' votes and features (written once, read for fit and scores)."""
    model = Model(lexicon(docs, labels))
    seen = written(_observed(docs, model), "votes")
    counts = seen.groupBy("votes").count().collect()  # at most 2 ** VOTERS rows
    patterns = np.array([r["votes"] for r in counts], dtype=np.int64)
    posterior = fit_label_model(model, patterns, np.array([r["count"] for r in counts]))
    by = dict(zip(patterns.tolist(), posterior.tolist()))
    rows = sampled(seen.where(part_of("doc_id", FOLDS) != HELD_OUT), MAX_FITTED, 2).select("votes", "features").collect()
    fit_linear(model, [r["features"] for r in rows], np.array([by[r["votes"]] for r in rows]))
    return model, seen


def scores(seen: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    w = F.lit(np.append(model.weights, 0.0))
    z = F.aggregate("features", F.lit(float(model.bias)), lambda a, f: a + F.get(w, f))
    s = seen.withColumn("score", 1 / (1 + F.exp(-z)))
    return s.select("doc_id", (part_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                    (F.col("score") >= CUT).cast("int").alias("predicted"))
