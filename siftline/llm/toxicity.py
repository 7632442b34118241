"""Toxicity by weak supervision.

Voters. A sign is a word (a lexicon) or a word beginning of 3 to 7 characters (a pattern) together with a level: it
stands in the text at all, twice, or twice and in a share of the words that LEVELS names. A beginning that ordinary
words have now and then marks a text only where it is dense, which the levels tell apart. Signs are counted on the
executors over a bounded sample of labelled rows, PER_CLASS a class. Each word or beginning whose best sign is
surely more frequent in toxic texts, by the lower confidence bound of its lift, may vote; the best VOTERS vote "toxic" on a
text that shows their sign and abstain on others. One more voter says "clean" where all of them abstain, and the given label is a
voter of each kind that is trusted a lot, though not wholly: some labels mark texts without a sign of toxicity.

Label model. Voters overlap and err: a generative model with a hidden label gives each voter its chance to fire on
toxic and on clean texts, estimated by expectation maximisation from a prior worth ANCHOR texts of each kind. What
voters still have in common once the hidden label is known (a word and its own beginning) is their estimated
correlation; the inverse of that matrix gives each voter's say, so that two that repeat each other count as one. The
posterior of the hidden label is the training label.

Classifier. A logistic regression over up to TERMS signs is fitted to the posteriors. Signs that chance may explain, given how
many were tried, count only together or where they are dense: a stray one by itself does not reach the threshold. Rows weigh as many labelled ids
as they stand for, in the label model and the regression alike, so the share of toxic texts is the true one however many
rows of each label the sample took. Scoring is one Arrow pass over whole texts with the model (TERMS numbers) in the
closure; nothing shuffles.

Labels, language, source and id never enter a score. Defined cases. A null text counts as empty; it gets the score of
a text without any sign. Labels that are null or neither 0 nor 1 are ignored. Without labelled rows of both kinds, or
without a sign, every text gets the smoothed share of toxic labels. Repeated rows are scored each. Empty tables give
empty results. Other columns stay; a column named like the score is replaced by ``scored``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import arrow_batches, packed, staged, table
from siftline.llm.labelled import fold, labelled_sample
from siftline.llm.memory import begin, give_back

PER_CLASS, VOTERS, TERMS, MIN_TEXTS, ANCHOR, THRESHOLD = 8_000, 256, 4_096, 3, 20.0, 0.3
#: A sign's lift is over these bounds with confidence (1.64 standard errors) if it may vote (and over the odds against
#: toxicity), and if it is a feature.
VOTES, COUNTS = 3.0, 1.5
BEGINNINGS = (3, 4, 5, 6, 7)
#: Level 1: once; level 2: twice; above: twice and at least this share of the text's words.
LEVELS = (1 / 250, 1 / 120, 1 / 60)
TOP = 2 + len(LEVELS)
#: Of the signs that are called sure, this share may be chance. Where others are not dense they weigh at most this part of
#: what it takes from the bias to THRESHOLD, so that no single one of them carries a text over it.
FALSE, WEAK = 0.05, 0.9
#: Added to the diagonal of the correlations, which keeps small samples from giving voters a say by chance.
RIDGE = 0.2
#: Chances that the given label says toxic, and says clean, on a clean and on a toxic text.
LABELS = ((0.0003, 0.99), (0.9997, 0.01))
CACHE, PART = 100_000, 512
FOLDS, HELD_OUT = 4, 2


def word_terms(word: bytes) -> tuple[str, ...]:
    """The word and its beginnings: lower case, without punctuation around it."""
    plain = word.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}*#$%&|<>-_")
    if not plain:
        return ()
    return (plain, *(f"{plain[:n]}-" for n in BEGINNINGS if len(plain) > n))


def level(count: int, words: int) -> int:
    """The highest level that ``count`` of a text's ``words`` reach."""
    return 1 if count < 2 else 2 + sum(count >= share * words for share in LEVELS)


class TermReader:
    """Terms of texts with their levels, of all or of those in a vocabulary; remembers the words it met, up to CACHE."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        self.vocabulary, self.known = vocabulary, {}

    def _of(self, word: bytes) -> tuple:
        terms = word_terms(word)
        if self.vocabulary is not None:
            terms = tuple(self.vocabulary[t] for t in terms if t in self.vocabulary)
        if len(self.known) < CACHE and len(word) < 64:
            self.known[word] = terms
        return terms

    def __call__(self, text: str | None) -> dict:
        """The level of each term that the text holds."""
        words = (text or "").encode().split()
        found, known = {}, self.known
        for word, n in Counter(words).items():
            terms = known.get(word)
            if terms is None:
                terms = self._of(word)
            for term in terms:
                found[term] = found.get(term, 0) + n
        return {term: level(n, len(words)) for term, n in found.items()}


@dataclass(frozen=True)
class Model:
    """log-odds = bias + sum of the weights of the signs that a text shows; weights: of each term up to each level."""

    terms: dict[str, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], reader: TermReader) -> np.ndarray:
        z = np.array([self.bias + sum(self.weights[term, at] for term, at in reader(t).items()) for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def sign_counts(rows: DataFrame) -> DataFrame:
    """(term, level, toxic, clean): labelled texts of either kind in which a term reaches a level."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin(__name__)
        read = TermReader()
        for batch in (b[at : at + PART] for b in batches for at in range(0, len(b), PART)):  # counts of few texts at a time
            by = (Counter(), Counter())
            for text, label in zip(batch.text, batch.label):
                by[label].update(read(text).items())
            signs = list(by[0].keys() | by[1].keys())
            yield pd.DataFrame({"term": [s[0] for s in signs], "level": [s[1] for s in signs], "toxic": [by[1][s] for s in signs], "clean": [by[0][s] for s in signs]})
            give_back()

    counts = rows.select("text", "label").mapInPandas(count, "term string, level int, toxic long, clean long")
    reached = [F.struct(F.lit(k).alias("level"), *[F.sum(F.when(F.col("level") >= k, F.col(c)).otherwise(0)).alias(c) for c in ("toxic", "clean")]) for k in range(1, TOP + 1)]
    return counts.groupBy("term").agg(F.array(*reached).alias("sign")).select("term", F.explode("sign").alias("sign")).select("term", "sign.*")


def label_model(votes: np.ndarray, anchors: np.ndarray, share: float, weight: np.ndarray | None = None, rounds: int = 4, steps: int = 40, fixed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the hidden label for each row of 0/1 votes, and each voter's say (1: repeats no other voter).

    anchors: for each voter its prior chances to fire on clean and on toxic texts. share: prior share of toxic texts.
    weight: texts that a row stands for. The last ``fixed`` voters keep their prior chances and their whole say. Only votes
    count; an abstention says nothing by itself.
    """
    fires = votes.astype(np.float64)
    n, k = fires.shape
    weight = np.ones(n) if weight is None else weight
    say, chances = np.ones(k), np.clip(anchors, 1e-6, 1 - 1e-6)
    post = np.full(n, share)
    for _ in range(rounds):
        for _ in range(steps):
            odds = np.log(share / (1 - share)) + fires @ (say * np.log(chances[1] / chances[0]))
            new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            moved, post = np.abs(new - post).max(initial=0), new
            toxic, clean = weight * post, weight * (1 - post)
            chances = np.stack([clean @ fires + ANCHOR * anchors[0], toxic @ fires + ANCHOR * anchors[1]])
            chances = np.clip(chances / (np.array([[clean.sum()], [toxic.sum()]]) + ANCHOR), 1e-6, 1 - 1e-6)
            chances[:, k - fixed :] = anchors[:, k - fixed :]
            if moved < 1e-6:
                break
        rest = fires - post[:, None] * chances[1] - (1 - post[:, None]) * chances[0]
        cov = rest.T @ (weight[:, None] * rest) / weight.sum()
        scale = np.sqrt(np.diag(cov)) + 1e-9
        close = cov / np.outer(scale, scale)
        np.fill_diagonal(close, 1.0)
        say = np.clip(np.linalg.solve(close + RIDGE * np.eye(k), np.full(k, 1 + RIDGE)), 0, 1)
        say[k - fixed :] = 1.0
    return post, say


def fit_linear(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, width: int, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features with targets in [0, 1]; full-batch Adam, so that reruns agree."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ix = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    share = weight / weight.sum()
    w[-1] = np.log((share @ target + 1e-6) / (share @ (1 - target) + 1e-6))
    for step in range(1, steps + 1):
        z = np.bincount(at, w[ix], len(rows)) + w[-1]
        error = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        grad = np.append(np.bincount(ix, error[at], width), error.sum())
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    return w[:-1], float(w[-1])


def surprise(toxic: Column, clean: Column, share: float) -> Column:
    """-log of a bound (Chernoff's) on the chance that so many of a sign's texts are toxic if it has nothing to do with that."""
    n, many = toxic + clean, toxic / (toxic + clean)
    part = lambda k, rate: F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)
    return F.when(many > share, part(toxic, share) + part(clean, 1 - share)).otherwise(0.0)


def discoveries(signs: DataFrame) -> float:
    """The least surprise at which at most FALSE of the signs found are expected to be chance, among all signs tested.

    Benjamini and Hochberg's rule on a histogram of surprises, so only its bars reach the driver.
    """
    bars = signs.groupBy(F.floor(F.col("surprise") * 10).alias("bar")).agg(F.count("*").alias("n")).orderBy(F.desc("bar")).collect()
    tested, found, least = sum(b.n for b in bars), 0, float("inf")
    for b in bars:
        found += b.n
        if tested * np.exp(-b.bar / 10) <= FALSE * found:
            least = b.bar / 10
    return least


def best_signs(rows: DataFrame, n1: int, n0: int) -> pd.DataFrame:
    """(term, level, lift, gain, toxic, clean, sure) of up to TERMS signs, those first that toxic texts show far more often and often.

    Thousands of terms are tried; a sign is sure if it stands out from what chance gives among so many. Of a word and its
    beginnings that stand in as many texts of either kind, the longest speaks for all.
    """
    lift = F.log((F.col("toxic") + 0.5) / (n1 + 1) / ((F.col("clean") + 0.5) / (n0 + 1)))
    lift = lift - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    share = n1 / (n1 + n0)
    signs = sign_counts(rows).where(F.col("toxic") >= MIN_TEXTS)
    signs = staged(signs.withColumn("surprise", surprise(F.col("toxic"), F.col("clean"), share)), "toxic-signs")
    best = signs.withColumn("sure", F.col("surprise") >= discoveries(signs)).withColumn("lift", lift).where(F.col("lift") >= float(np.log(COUNTS)))
    best = best.withColumn("gain", F.col("toxic") * F.col("lift")).orderBy(F.desc("gain"), "term", "level").limit(4 * TERMS).toPandas()
    alike, repeats = best.assign(plain=best.term.str.rstrip("-")).sort_values(["level", "toxic", "clean", "plain"]), []
    for (i, a), (_, b) in zip(alike.iterrows(), alike.iloc[1:].iterrows()):
        if (a.level, a.toxic, a.clean) == (b.level, b.toxic, b.clean) and b.plain.startswith(a.plain):
            repeats.append(i)
    return best.drop(index=repeats).head(TERMS).reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits on labelled rows that are not held out, at most ``per_class`` of each label."""
    rows = staged(labelled_sample(docs, labels, "toxic", fold("doc_id", FOLDS) == HELD_OUT, per_class), "toxic-sample")
    sizes = {r.label: (r.n, r.all) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("all")).collect()}
    (n1, all1), (n0, all0) = sizes.get(1, (0, 0)), sizes.get(0, (0, 0))
    share = (all1 + 1) / (all1 + all0 + 10)
    empty = Model({}, np.zeros((0, TOP + 1)), float(np.log(share / (1 - share))))
    if not n1 or not n0:
        return empty
    with arrow_batches(docs.sparkSession, 2 * PART):
        best = best_signs(rows, n1, n0)
    if not len(best):
        return empty
    terms = {t: i for i, t in enumerate(dict.fromkeys(best.term))}
    sign = {(terms[t], k): i for i, (t, k) in enumerate(zip(best.term, best.level))}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = TermReader(terms)
        for batch in batches:
            shown = [sorted(sign[t, k] for t, at in read(x).items() for k in range(1, at + 1) if (t, k) in sign) for x in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "label": batch.label, "weight": batch.weight, "hits": shown})

    got = rows.mapInPandas(hits, "doc_id long, label int, weight double, hits array<int>").orderBy("doc_id").toPandas()  # 2 * per_class rows
    held, weight = [np.asarray(h, np.int64) for h in got.hits], got.weight.to_numpy(np.float64)
    bound = np.log(max(VOTES, (1 - share) / share))  # what shows a sign is toxic more likely than not
    voters = best[best.lift >= bound].drop_duplicates("term").head(VOTERS)
    column = np.full(len(best), -1)
    column[voters.index] = np.arange(len(voters))
    votes = np.zeros((len(held), len(voters) + 3), np.uint8)
    for i, h in enumerate(held):
        votes[i, column[h][column[h] >= 0]] = 1
    votes[:, -3] = ~votes[:, :-3].any(1)
    votes[:, -2], votes[:, -1] = got.label == 1, got.label == 0
    anchors = np.stack([(voters.clean + 0.1) / (n0 + 1), (voters.toxic + 0.1) / (n1 + 1)])
    anchors = np.hstack([anchors, [[0.99], [0.05]], np.transpose(LABELS)])
    posterior, _ = label_model(votes, anchors, share, weight, fixed=len(LABELS))
    weights, bias = fit_linear(held, posterior, weight, len(best))
    reached, sure = np.zeros((len(terms), TOP + 1)), np.zeros((len(terms), TOP + 1), bool)
    for (t, k), i in sign.items():
        reached[t, k:] += weights[i]
        sure[t, k:] |= bool(best.sure[i])
    most = max(0.0, WEAK * (np.log(THRESHOLD / (1 - THRESHOLD)) - bias))
    sparse = np.arange(TOP + 1) <= 2
    reached = np.where(sure | ~sparse, reached, np.minimum(reached, most))
    return Model(terms, reached, bias)


def scored(docs: DataFrame, model: Model, text_col: str = "text", column: str = "score") -> DataFrame:
    """Adds the score of every whole text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin(__name__)
        read = TermReader(model.terms)
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist(), read), dtype="float64")
            give_back()

    return docs.withColumn(column, score(F.col(text_col)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = fold("doc_id", FOLDS) == HELD_OUT
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_rows(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept."""
    rows = packed(docs, text=F.col("text"))
    return scored(rows, fit(labelled_docs, labels)).where(F.col("score") < THRESHOLD).select("row.*")
