"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

1. Tokens are counted by documents of either label, in a bounded sample of TRAIN_ROWS labelled rows; equal and nearly
   equal documents of one label count once, whatever the label, and all others in full. A token's score is
   its log-odds under an informative Dirichlet prior (a tenth of the sample, spread as the tokens are in both labels
   together), drawn towards 0 by some standard deviations. Log-odds over a least one count, and those that cost more than GAP
   when drawn; all other words cost GAP. These settings are chosen by cross-validation within rows that aren't held out. Words' first STEM bytes are tokens too, so that inflected forms count together; a word
   has the larger score of the two.
2. A linear-time scan finds all maximal scoring segments of a text: the passages.
3. Scores of chance segments follow an extreme-value law: a text of n tokens has K n exp(-lambda s) of score s or
   more. lambda makes the expected factor exp(lambda * score) of a clean token 1; K is counted on clean rows. A passage is
   significant if fewer than SIGNIFICANT such are expected.
4. The law's exponent of the summed score of a text's passages, with its length, is turned into a probability by a
   logistic curve, fitted on the fifth of the sample that isn't counted; if balanced, it takes either label for as likely before a
   text is seen.

Defined results: null and empty texts have no passages and the score of a text without any; texts of any length are
scanned whole; equal texts get equal scores; a key with several labels is toxic if one is; null labels and null keys
teach nothing; a null key is not held out; without labels all scores are 0; an empty table gives an empty one. Extra
columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_python, materialise, sampled
from .minhash import text_classes, text_id
from .words import word_hashes

TRAIN_ROWS = 200_000
PRIOR = 0.1
GAP = 0.1
STEM = 4
SIGNIFICANT = 0.05
PREDICTED = 0.7


@dataclass(frozen=True)
class Settings:
    deviations: float  # that log-odds are drawn towards 0
    least: float  # log-odds that a toxic token has before they go off; less tells a language or a topic
    balanced: bool = True  # labels weigh the same in the calibration
    documents: int = 2  # toxic ones that a toxic token has at least: in one alone it is likely to be a name


GRID = tuple(Settings(d, least, b) for d in (1.5, 2.0, 2.5, 3.0) for least in (1.0, 1.5, 2.0) for b in (True, False))
#: Of GRID the one with the largest share of toxic rows found less that of clean rows predicted, by cross_validate() over sf0.1.
CHOSEN = Settings(2.0, 1.0)


@dataclass
class Model:
    tokens: np.ndarray  # hashes, ascending
    scores: np.ndarray
    rate: float = 1.0  # lambda
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0
    trained: bool = False


def held_out(key: Column) -> Column:
    """Whether a key's labels may not be learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def segments(scores: list[float], places: list[int], gap: float = GAP) -> list[tuple[int, int, float]]:
    """(first place, place after the last, score) of all maximal scoring segments, in linear time. scores: those of tokens with a
    score of their own, at those places; every place between costs gap."""
    # a candidate: first place, last place + 1, total before it, total with it, and the nearest candidate before it with less
    # before it (-1: none). Whoever is stepped over along these links is never met again, so steps are no more than candidates.
    found: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for score, place in zip(scores, places, strict=True):
        total -= gap * (place - at)
        first, last, left, right = place, place + 1, total, total + score
        total, at = right, place + 1
        if score <= 0:
            continue
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            first, left, above = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = above
        found.append((first, last, left, right, j))
    return [(a, b, right - left) for a, b, left, right, _ in found]


def passages_of(column: pa.Array, model: Model) -> tuple[list[list[tuple[int, int, float]]], np.ndarray]:
    """Segments of each row of a text column, in tokens, and the rows' tokens."""
    words, at = word_hashes(column, plain=True)
    stems, _ = word_hashes(column, plain=True, stem=STEM)
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(at) - 1)]
    if len(words) and len(model.tokens):
        found = np.full(len(words), -np.inf)
        for tokens in (words, stems):
            near = np.minimum(np.searchsorted(model.tokens, tokens), len(model.tokens) - 1)
            same = model.tokens[near] == tokens
            found[same] = np.maximum(found[same], model.scores[near[same]])
        hit = np.flatnonzero(found > -np.inf)
        score, bounds = found[hit], np.searchsorted(hit, at)
        for i in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[i], bounds[i + 1]
            out[i] = segments(score[a:b].tolist(), (hit[a:b] - at[i]).tolist())
    return out, np.diff(at)


def _log_expected(model: Model, score, n):
    """ln of how many chance segments of that score a text of n tokens has."""
    return np.log(model.k) + np.log(np.maximum(n, 1)) - model.rate * score


def _evidence(model: Model, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How unlikely a text's passages are by chance; at most 0 without any."""
    evidence = -_log_expected(model, total, n)
    return np.where(total > 0, evidence, np.minimum(evidence, 0))


def _curve(model: Model, evidence: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * evidence, -30, 30)))


def _probability(model: Model, found: list, n: np.ndarray) -> np.ndarray:
    return _curve(model, _evidence(model, np.array([sum(x[2] for x in row) for row in found], float), n))


def training_sample(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic, counted) of labelled rows that aren't held out: about rows of them at most, chosen by a hash of the key."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("toxic")).filter("key is not null and toxic is not null")
    known = known.filter(~held_out(F.col("key"))).groupBy("key").agg((F.max("toxic") > 0).alias("toxic"))
    name = F.col("key").cast("string")
    known = known.filter(sampled(name, rows, known.count())).withColumn("counted", F.pmod(F.xxhash64(name, F.lit("counted")), F.lit(5)) != 0)
    # no more than rows, give or take chance: bounded whatever the corpus
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "key").select("text", "toxic", "counted")


def without_copies(sample: DataFrame) -> DataFrame:
    """(text, toxic): of the counted rows, one of each near-duplicate class and label."""
    rows = sample.filter("counted").select(text_id(F.col("text")).alias("tid"), "toxic", "text")
    texts = materialise(rows.groupBy("tid", "toxic").agg(F.min("text").alias("text")), "texts")
    classes = text_classes(texts.select("tid", "text"))
    named = texts.select("tid", "toxic").join(classes, "tid", "left")
    kept = named.groupBy(F.coalesce("label", "tid").alias("_class"), "toxic").agg(F.min("tid").alias("tid")).select("tid", "toxic")
    return texts.join(kept, ["tid", "toxic"], "left_semi").select("text", "toxic")


def count_tokens(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): documents of each label that hold a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(batch.column("text"), plain=True)
            stems, _ = word_hashes(batch.column("text"), plain=True, stem=STEM)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            words, row = np.concatenate([words, stems]), np.tile(row, 2)
            order = np.lexsort((row, words))
            words, row = words[order], row[order]
            first = np.ones(len(words), bool)
            first[1:] = words[1:] != words[:-1]
            new = first.copy()
            new[1:] |= row[1:] != row[:-1]
            starts = np.flatnonzero(first)
            n = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else starts
            bad = np.add.reduceat((new & toxic[row]).astype(np.int64), starts) if len(starts) else starts
            yield pa.RecordBatch.from_arrays([pa.array(words[starts].view(np.int64)), pa.array(bad), pa.array(n - bad)], ["token", "toxic", "clean"])

    counted = rows.select("text", "toxic").mapInArrow(run, "token long, toxic long, clean long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, settings: Settings = CHOSEN) -> DataFrame:
    """(token, score, clean_share) of the tokens with a score of their own: log-odds drawn towards 0, of those over the least if
    they stay positive, and of those that then are under -GAP."""
    totals = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = float(totals["t"] or 0), float(totals["c"] or 0)
    prior = (F.col("toxic") + F.col("clean")) * PRIOR
    n0 = PRIOR * (t + c)
    bad, good = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(bad / (F.lit(t + n0) - bad)) - F.log(good / (F.lit(c + n0) - good))
    doubt = settings.deviations * F.sqrt(1 / bad + 1 / good)
    score = F.when(delta > 0, delta - doubt).otherwise(delta + doubt)
    toxic, clean = (F.col("toxic") >= settings.documents) & (delta > settings.least) & (score > 0), (delta < 0) & (score < -GAP)
    return counts.filter(toxic | clean).select("token", score.alias("score"), (good / F.lit(max(c + n0, 1.0))).alias("clean_share"))


def _solve_rate(scores: np.ndarray, shares: np.ndarray, gap: float = GAP) -> float:
    """lambda > 0 with sum share * exp(lambda * score) + (1 - sum share) * exp(-lambda * gap) = 1."""
    rest = max(0.0, 1 - shares.sum())

    def excess(x: float) -> float:
        return float((shares * np.exp(x * scores)).sum() + rest * np.exp(-x * gap) - 1)

    low, high = 1e-6, 1.0
    if excess(low) >= 0:
        return low
    while excess(high) < 0:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def _fit_logistic(x: np.ndarray, y: np.ndarray, balanced: bool = True) -> tuple[float, float]:
    """Intercept and slope, with a small ridge; Newton's method. balanced: both labels weigh the same, however many rows have them."""
    w, z = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    bad = max(1.0, y.sum())
    weight = np.where(y > 0, len(y) / (2 * bad), len(y) / (2 * max(1.0, len(y) - bad))) if balanced else np.ones(len(y))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 0.01 * w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, settings: Settings = CHOSEN) -> Model:
    for_python(df.sparkSession)
    sample = training_sample(df, labels, key, text, label, rows)
    return fit(count_tokens(without_copies(sample)), sample.filter("not counted"), settings)


def fit(counts: DataFrame, rest: DataFrame, settings: Settings) -> Model:
    """A model of token counts, calibrated on other rows(text, toxic)."""
    model = scored_tokens(counts, settings)
    calibrate(model, sums_of(rest, model), settings)
    return model


def scored_tokens(counts: DataFrame, settings: Settings) -> Model:
    found = log_odds(counts, settings).collect()  # of a bounded sample
    tokens, scores, shares = (np.array([r[c] for r in found], k) for c, k in (("token", np.int64), ("score", float), ("clean_share", float)))
    order = np.argsort(tokens.view(np.uint64))
    model = Model(tokens.view(np.uint64)[order], scores[order])
    if len(tokens):
        model.rate = _solve_rate(scores, shares)
    return model


def sums_of(rows: DataFrame, model: Model) -> pd.DataFrame:
    """(total, best, n, toxic) of a bounded sample of rows(text, toxic): scores of all passages and of the best, and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n = passages_of(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([pa.array([sum(x[2] for x in r) for r in rows], pa.float64()), pa.array([max((x[2] for x in r), default=0.0) for r in rows], pa.float64()), pa.array(n, pa.int64()), batch.column("toxic")], ["total", "best", "n", "toxic"])

    return rows.select("text", "toxic").mapInArrow(run, "total double, best double, n long, toxic boolean").toPandas()


def calibrate(model: Model, sums: pd.DataFrame, settings: Settings) -> None:
    """K from chance segments of clean rows, and the logistic curve."""
    if not len(sums):
        return
    clean = sums[~sums["toxic"].astype(bool)]
    least = 1.0
    model.k = float(((clean["best"] >= least).sum() + 0.5) / (max(1, clean["n"].sum()) * np.exp(-model.rate * least)))
    model.intercept, model.slope = _fit_logistic(_evidence(model, sums["total"].to_numpy(), sums["n"].to_numpy()), sums["toxic"].to_numpy(float), settings.balanced)
    model.trained = True


def cross_validate(df: DataFrame, labels: DataFrame, grid: tuple[Settings, ...] = GRID, folds: int = 5, key: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[float, float, Settings]]:
    """(share of toxic rows found, share of clean rows predicted, settings) of rows that aren't held out, each scored by a model that
    hasn't seen its near-duplicate class."""
    for_python(df.sparkSession)
    sample = training_sample(df, labels, key, text, label).withColumn("tid", text_id(F.col("text")))
    classes = text_classes(materialise(sample.groupBy("tid").agg(F.min("text").alias("text")), "texts"))
    sample = materialise(sample.join(classes, "tid", "left").withColumn("fold", F.pmod(F.xxhash64(F.coalesce("label", "tid")), F.lit(folds))).select("text", "toxic", "counted", "fold"), "folds")
    n, found = np.zeros(2), {s: np.zeros(2) for s in grid}
    for k in range(folds):
        others, own = sample.filter(F.col("fold") != k), sample.filter(F.col("fold") == k)
        counts = materialise(count_tokens(without_copies(others)), "counts")
        for tokens in {replace(s, balanced=True) for s in grid}:
            model = scored_tokens(counts, tokens)
            rest, sums = sums_of(others.filter("not counted"), model), sums_of(own, model)
            toxic = sums["toxic"].to_numpy(bool)
            for s in (s for s in grid if replace(s, balanced=True) == tokens):
                calibrate(model, rest, s)
                hit = _curve(model, _evidence(model, sums["total"].to_numpy(), sums["n"].to_numpy())) >= PREDICTED
                found[s] += [(hit & toxic).sum(), (hit & ~toxic).sum()]
        n += [toxic.sum(), (~toxic).sum()]
    return [(*(found[s] / np.maximum(n, 1)).tolist(), s) for s in grid]


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, passages) for each row of df. passages: the significant ones, array<struct<first, after, score, expected>>, in tokens."""
    for_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found, n = passages_of(batch.column(1), m)
            p = _probability(m, found, n) if m.trained else np.zeros(len(n))
            spans = [[{"first": a, "after": b, "score": s, "expected": e} for a, b, s in row if (e := float(np.exp(_log_expected(m, s, k)))) < SIGNIFICANT] if row else [] for row, k in zip(found, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(spans, span)], [key, "score", "passages"])

    kind = df.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).mapInArrow(run, f"`{key}` {kind}, score double, passages array<struct<first: long, after: long, score: double, expected: double>>")


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted, n_passages, passages) for each row of df, by a model trained on labels."""
    scored = score(df, train(df, labels, key, text, label), key, text)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", F.when(F.col("score") >= PREDICTED, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"), "passages")
