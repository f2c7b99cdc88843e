"""Quality scores from weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer.

1. A pass over the texts takes each one's votes: eight labellers say bad, good or nothing. Vote patterns are counted over
   all rows; there are 3^8 at most, whatever the corpus.
2. Expectation-maximisation on the counts estimates the share of good texts and, for each labeller, how often it votes
   how on either kind. That gives each pattern the posterior probability of being good. No label is read.
3. A logistic model on hashed features of word shapes is fitted to the posteriors of TRAIN_ROWS rows, chosen by a hash
   of the text, and scores every text.

Defined results: null and empty texts have no votes and no features and get the model's score without any; texts of any
length are read whole; equal texts get equal scores; keys may be null or repeated; an empty table gives an
empty one. Extra columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_python, sampled
from .words import mix, text_bytes, word_hashes

TRAIN_ROWS = 10_000
BITS = 14
ROUNDS = 200
KEEP = 0.5
LABELLERS = ("symbols", "capitals", "shouts", "echoes", "variety", "lines", "columns", "letters")
GOOD, BAD, NONE = 2, 1, 0

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>{}[]\\^~=+_@"))
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over the rows."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def look(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Votes (a row of LABELLERS for each text), and the features' rows, hashes and values."""
    raw, at = text_bytes(column)
    words, counts = word_hashes(column)
    n_rows, n = len(at) - 1, np.diff(counts)
    some = np.maximum(n, 1)
    upper, lower = _per_row((raw >= 65) & (raw <= 90), at), _per_row((raw >= 97) & (raw <= 122), at)
    letters = np.maximum(1, upper + lower + _per_row(raw >= 128, at))
    inked = np.maximum(1, _per_row(~_SPACE[raw], at))
    row = np.repeat(np.arange(n_rows), n)

    # words that repeat one of the two before them
    echo = np.zeros(len(words), bool)
    for k in (1, 2):
        echo[k:] |= (words[k:] == words[:-k]) & (row[k:] == row[:-k])
    order = np.lexsort((words, row))
    first = np.ones(len(words), bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][first], minlength=n_rows)

    # lines of some length that were seen before in the text
    seen_lines = np.zeros(n_rows)
    breaks = np.bincount(np.searchsorted(at, np.flatnonzero(raw == 10), "right") - 1, minlength=n_rows) if len(raw) else np.zeros(n_rows)
    for i in np.flatnonzero(breaks >= 2):
        lines = [x for x in raw[at[i] : at[i + 1]].tobytes().split(b"\n") if x.strip()]
        seen_lines[i] = 1 - len(set(lines)) / max(1, len(lines))

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(n == 0, NONE, np.where(bad, BAD, np.where(good, GOOD, NONE)))

    symbols, shouts, pipes = (_per_row(x, at) / some for x in (_SYMBOL[raw], raw == 33, raw == 124))
    capitals, echoes, variety = upper / letters, _per_row(echo, counts) / some, distinct / some
    votes = np.stack([
        vote(symbols > 0.1, symbols < 0.02),
        vote(capitals > 0.3, capitals < 0.15),
        vote(shouts > 0.1, shouts < 0.02),
        vote(echoes > 0.15, echoes < 0.08),
        vote((variety < 0.3) & (n >= 50), (variety > 0.4) & (n >= 20)),
        vote(seen_lines > 0.3, (seen_lines == 0) & (breaks >= 1)),
        vote(pipes > 0.1, pipes < 0.01),
        vote(letters / inked < 0.7, letters / inked > 0.85),
    ], 1)

    # shapes: a word's letters, capitals, digits and signs, runs as one
    inside = ~_SPACE[raw]
    start = np.zeros(len(raw) + 1, bool)
    start[1:-1] = ~inside[:-1]
    start[at[:-1]] = True
    start = start[:-1] & inside
    kind = _CLASS[raw]
    turn = start.copy()
    turn[1:] |= inside[1:] & (kind[1:] != kind[:-1])
    turn &= inside
    kinds, begins = kind[turn].astype(np.uint64), np.flatnonzero(start[turn])
    place = np.arange(len(kinds)) - np.repeat(begins, np.diff(np.append(begins, len(kinds))))
    shape = mix(np.add.reduceat(mix(kinds + np.uint64(7919) * (place % 64).astype(np.uint64)), begins)) if len(begins) else np.zeros(0, np.uint64)
    pair = shape[1:] * np.uint64(3) + shape[:-1] * np.uint64(5)
    same = row[1:] == row[:-1]
    rows = np.concatenate([row, row[1:][same], row])
    hashes = np.concatenate([mix(shape), mix(pair[same]), mix(echo.astype(np.uint64) + np.uint64(99991))]) >> np.uint64(64 - BITS)
    code, times = np.unique((rows.astype(np.int64) << BITS) | hashes.astype(np.int64), return_counts=True)
    where, feature = code >> BITS, code & ((1 << BITS) - 1)
    value = np.sqrt(times / some[where])
    norm = np.sqrt(np.bincount(where, value**2, n_rows))
    return votes, where, feature, value / np.maximum(norm[where], 1e-9)


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(len(LABELLERS)))


def vote_patterns(df: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n) over all rows."""
    for_python(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            total += np.bincount(_pattern(look(batch.column(0))[0]), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pattern", "n"])

    counted = df.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "pattern long, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("n"))


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good for each pattern, the share of good rows, and P(vote | kind) as [labeller, kind (bad, good), vote]."""
    votes = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    posterior = (good + 1) / (good + 2 * bad + 2)  # a bad vote counts for more at first, as rules find faults
    share, table = 0.5, np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        share = float((n @ posterior + 1) / (n.sum() + 2))
        for j in range(len(LABELLERS)):
            for kind, p in ((0, 1 - posterior), (1, posterior)):
                c = np.bincount(votes[:, j], n * p, 3) + 1
                table[j, kind] = c / c.sum()
        logs = np.log(np.array([1 - share, share]))[None, :] + sum(np.log(table[j][:, votes[:, j]]).T for j in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        done, posterior = np.abs(new - posterior).max() < 1e-6, new
        if done:
            break
    return posterior, share, table


def _fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights and, last, the intercept of a logistic model on soft targets; full gradients with adaptive steps."""
    w, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    for _ in range(ROUNDS):
        z = np.bincount(row, w[feature] * value, len(target)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(feature, error[row] * value, 1 << BITS), error.sum()) / max(1, len(target)) + 1e-5 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def train(df: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> np.ndarray:
    """The scorer's weights."""
    for_python(df.sparkSession)
    counted = vote_patterns(df, text).toPandas()
    if not len(counted):
        return np.zeros((1 << BITS) + 1)
    patterns, n = counted["pattern"].to_numpy(), counted["n"].to_numpy(float)
    posterior = dict(zip(patterns.tolist(), expectation_maximisation(patterns, n)[0].tolist(), strict=True))
    body = F.col(f"`{text}`")
    # of equal texts one is enough: a text that many rows share stays one row of the sample
    sample = df.filter(sampled(F.coalesce(body, F.lit("")), rows, int(n.sum()))).select(body.alias("_text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, row, feature, value = look(batch.column(0))
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            target = [posterior.get(p, 0.5) for p in _pattern(votes).tolist()]
            parts = [slice(bounds[i], bounds[i + 1]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.float64()), pa.array([feature[p].astype("<u2").tobytes() for p in parts], pa.binary()), pa.array([value[p].astype("<f4").tobytes() for p in parts], pa.binary())], ["target", "features", "values"])

    found = sample.mapInArrow(run, "target double, features binary, values binary").orderBy("features", "values").collect()  # about rows of them
    features, values = [np.frombuffer(r["features"], "<u2").astype(np.int64) for r in found], [np.frombuffer(r["values"], "<f4") for r in found]
    row = np.repeat(np.arange(len(found)), [len(x) for x in features])
    empty = np.zeros(0)
    return _fit(row, np.concatenate([*features, empty.astype(np.int64)]), np.concatenate([*values, empty]), np.array([r["target"] for r in found]))


def score(df: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row of df; score 0 to 1, higher is better."""
    for_python(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            _, row, feature, value = look(batch.column(1))
            z = np.bincount(row, w[feature] * value, batch.num_rows) + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [key, "score"])

    kind = df.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).mapInArrow(run, f"`{key}` {kind}, score double")


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = KEEP) -> DataFrame:
    """(key, score, kept) for each row of df."""
    return score(df, train(df, text), key, text).withColumn("kept", F.col("score") >= least)
