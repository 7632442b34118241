"""A quality classifier by positive-unlabelled learning.

Only labelled good texts (trusted positives) and unlabelled texts teach it; nobody has to say what bad looks like.
Up to POSITIVES labelled rows that are not held out and up to UNLABELLED rows without a label, both picked by a hash
of the id, are measured on the executors; FEATURES numbers a text come back to be fitted.

Class prior. The share of good texts among the unlabelled is estimated by comparing score distributions of a first
classifier of trusted against unlabelled rows: in the range of scores where only good texts live, the unlabelled share
over the trusted share is the prior, so the prior is the smallest such ratio over upper tails, on rows that the first
classifier was not fitted to. A little is taken off (PRIOR_SLACK), since with too large a prior nothing bad is left.

Risk. With prior p, the risk of a classifier is p R+(trusted) + max(0, R-(unlabelled) - p R-(trusted)): bad texts are
what is left of the unlabelled when p times the good is taken away, and that rest can't have a negative loss. Where a
step makes it negative, the step is taken against it instead (non-negative risk). The classifier is additive: each
feature is cut at quantiles of the unlabelled sample, and each interval has a weight. With the logistic loss the score
is an estimate of the chance that a text is good.

Labels, language, source and id never enter a score. Scoring is one Arrow pass over whole texts; nothing shuffles.
Defined cases. A null text counts as empty. Null labels, and labels other than 1, teach nothing. Without trusted rows or
without unlabelled rows every text scores the prior 0.5. Repeated rows are scored each. Empty tables give empty results. Other columns stay; a
column named like the score is replaced by ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import lowest_hashes, staged, table
from siftline.llm.labelled import fold

POSITIVES, UNLABELLED, THRESHOLD, FOLDS, HELD_OUT = 8_000, 16_000, 0.3, 5, 0
QUANTILES, PRIOR_SLACK = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98), 0.985
FEATURES = ("words", "word_length", "symbols", "bars", "exclamations", "upper", "digits", "punctuation", "other_ascii", "distinct_words", "repeated_next", "lines", "duplicate_lines", "filled_lines", "longest_word", "lone_characters")

_KINDS = {"symbol": b"#*$%&<>", "bar": b"|", "exclamation": b"!", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "stop": b".,;:?", "blank": b" \t\n\r\x0b\x0c", "later": bytes(range(128, 192)), "high": bytes(range(192, 256))}
_KIND = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(_KINDS.values(), 1):
    _KIND[list(_bytes)] = _i
_AT = {k: i for i, k in enumerate(_KINDS, 1)}


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES for one text: shares and ratios, so that length alone does not decide."""
    data = (text or "").encode()
    words = data.split()
    n = max(1, len(words))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=len(_KINDS) + 1)
    of = lambda k: int(kinds[_AT[k]])
    chars = max(1, len(data) - of("later") - of("blank"))
    letters = max(1, of("upper") + of("lower") + of("high"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    known = len(set(words))
    return [
        np.log1p(len(words)), chars / n, of("symbol") / n, of("bar") / n, of("exclamation") / n, of("upper") / letters,
        of("digit") / chars, of("stop") / n, int(kinds[0]) / chars, known / n**0.8, again / n, len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)), len(lines) / max(1, data.count(b"\n") + 1), max(map(len, words), default=0),
        sum(len(w) == 1 for w in words) / n,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every text as an array."""

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return docs.select("doc_id", measure(F.col("text")).alias("x"))


@dataclass(frozen=True)
class Model:
    """Additive in intervals: score = sigmoid(bias + sum of the weight of each feature's interval)."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        at, out = 0, []
        for i, e in enumerate(self.edges):
            out.append(at + np.searchsorted(e, x[:, i], side="left"))
            at += len(e) + 1
        return np.stack(out, 1) if out else np.zeros((len(x), 0), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + (self.weights[self.cells(x)].sum(1) if len(self.edges) else np.zeros(len(x)))
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def intervals(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, i], QUANTILES)) for i in range(x.shape[1])]


def fit_pu(trusted: np.ndarray, unlabelled: np.ndarray, prior: float | None, edges: list[np.ndarray], steps: int = 1_500, l2: float = 1e-5) -> Model:
    """Minimises the non-negative risk; without a prior, the plain risk of trusted against unlabelled rows."""
    model = Model(edges, np.zeros(sum(len(e) + 1 for e in edges)), 0.0)
    cp, cu = model.cells(trusted), model.cells(unlabelled)
    width = len(model.weights)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)

    def pull(cells: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(cells.ravel(), np.repeat(slope, cells.shape[1]), width)
        return np.append(g, slope.sum()) / max(1, len(cells))

    for step in range(1, steps + 1):
        zp, zu = w[cp].sum(1) + w[-1], w[cu].sum(1) + w[-1]
        up = pull(cp, _sigmoid(zp) - 1)  # of the loss of trusted rows as good
        down_p, down_u = pull(cp, _sigmoid(zp)), pull(cu, _sigmoid(zu))  # of the loss as bad
        if prior is None:
            grad = up + down_u
        else:
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            grad = prior * up + down_u - prior * down_p if rest >= 0 else prior * down_p - down_u
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(edges, w[:-1], float(w[-1]))


def class_prior(trusted: np.ndarray, unlabelled: np.ndarray, edges: list[np.ndarray]) -> float:
    """Share of good texts among the unlabelled, by the smallest ratio of upper tails."""
    p, u = [], []
    for half in (0, 1):  # each half is scored by a classifier of the other
        first = fit_pu(trusted[half::2], unlabelled[half::2], None, edges, steps=200, l2=1e-3)
        p.append(first.scores(trusted[1 - half :: 2]))
        u.append(first.scores(unlabelled[1 - half :: 2]))
    p, u = np.sort(np.concatenate(p)), np.sort(np.concatenate(u))
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.8, 41)))
    share_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
    share_u = 1 - np.searchsorted(u, cuts, side="left") / len(u)
    error = 0.5 * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p))) / share_p  # keeps thin tails from winning by chance
    best = int(np.argmin(share_u / share_p + error))
    return float(np.clip(PRIOR_SLACK * share_u[best] / share_p[best], 0.05, 0.98))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on trusted rows that are not held out and on rows without any label."""
    good = labels.where((F.col("quality") == 1) & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id").distinct()
    good = lowest_hashes(good, POSITIVES).withColumn("good", F.lit(1))
    bare = docs.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").where("doc_id IS NOT NULL").distinct()
    bare = lowest_hashes(staged(bare, "unlabelled"), UNLABELLED).withColumn("good", F.lit(0))
    picked = good.unionByName(bare).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # POSITIVES + UNLABELLED ids at most
    x = measured(rows.select(F.struct("doc_id", "good").alias("doc_id"), "text"))
    got = x.select("doc_id.doc_id", "doc_id.good", "x").orderBy("doc_id", "x").toPandas()
    trusted, other = (np.array(got.x[got.good == g].tolist(), np.float64).reshape(-1, len(FEATURES)) for g in (1, 0))
    if len(trusted) < 2 or len(other) < 2:
        return Model([], np.zeros(0), 0.0)
    edges = intervals(other)
    return fit_pu(trusted, other, class_prior(trusted, other, edges), edges)


def scored(docs: DataFrame, model: Model, text_col: str = "text", column: str = "score") -> DataFrame:
    """Adds the score of every whole text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.scores(x), dtype="float64")

    return docs.withColumn(column, score(F.col(text_col)))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = fold("doc_id", FOLDS) == HELD_OUT
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
