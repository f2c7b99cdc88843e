"""Hard negatives: for each anchor and each of its best rows of the same label, the best rows of other labels whose scores
lie in a band below the positive's. Scores are integer inner products.

Anchors are a stated set of queries. They and all rows are dealt by hash into blocks of about ANCHORS and ROWS, and a task
holds one block of each; blocks are sized by the table's counts, so neither a label nor a vector that many rows share makes
one larger. Within a task the rotation onto principal components (fitted on sums over all rows) puts most of a product into
few leading components. Partial products over STAGES of them, with the product of the norms of what is left and a slack for
rounding, bound every score from both sides; pairs that can't be among the best, or can't lie in a band, go early, and the rest
are verified by products of the integers. So results don't depend on the rotation. There are two rounds, for the positives and
for the negatives in their bands; each task returns a few rows an anchor and block, and a window ranks those.

Rows with a null id or label, or a vector that is null or has a null or non-finite component, take no part. Rows of equal id
count once: the least by (label, vector) counts. Shorter vectors, empty ones too, count as if zeros followed. Equal scores are ordered by
id. An anchor without another row of its label, or a positive without a row in its band, gives nothing, and an empty
table gives an empty one. Scores beyond a long are cut to its ends. Other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship

ROWS, ANCHORS = 8192, 2048  # of a block, about
STAGES = (8, 16, 32)  # leading components after which pairs are discarded
STRIP = 1 << 19  # pairs whose bounds are in memory at one time
FEW = 0.01  # of pairs: then they are followed one by one
SLACK = 2.0**-36  # of the product of two norms: more than products of 1024 terms lose by rounding
ROTATED = 1024  # components that are rotated; later ones are left for the remainder
_SAFE = 2**62


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, vector) of rows that take part: each component x is floor(scale * x)."""
    v, bad = F.col(f"`{vector}`"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Lists as rows of d integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        return values.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Principal directions, the leading ones first, of rows(vector); a square matrix of at most ROTATED columns."""
    k = min(d, ROTATED)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = _matrix(batch.column(0), d)[:, :k].astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    parts = rows.select("vector").mapInArrow(partial, "i int, sums array<double>")
    sums = parts.select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # k * k rows
    gram = np.zeros((k, k))
    for r in sums:
        gram[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


class Block:
    """Vectors as integers, rotated, and the norms of what follows each stage."""

    def __init__(self, table: pa.Table, d: int, turn: np.ndarray):
        self.id, self.label = (table.column(c).to_numpy() for c in ("id", "label"))
        self.whole = _matrix(table.column("vector"), d)
        real = self.whole.astype(float)
        k = turn.shape[1]
        self.turned = real[:, :k] @ turn
        squares = np.concatenate([self.turned**2, real[:, k:] ** 2], 1)
        self.stages = [s for s in STAGES if s < k] + [k]
        tails = np.concatenate([np.cumsum(squares[:, ::-1], 1)[:, ::-1], np.zeros((len(real), 1))], 1)
        self.norm = np.sqrt(tails[:, 0])
        self.left = {s: np.sqrt(tails[:, s]) for s in self.stages}
        self.most = int(np.abs(real).max(initial=0)) if d else 0


def _products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a and j of b, some at a time."""
    out = np.empty(len(i), a.dtype)
    step = max(1, (1 << 21) // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        out[s : s + step] = (a[i[s : s + step]] * b[j[s : s + step]]).sum(1)
    return out


def _exact(a: Block, i: np.ndarray, b: Block, j: np.ndarray, d: int) -> np.ndarray:
    if a.most * b.most * max(d, 1) < _SAFE:
        return _products(a.whole, i, b.whole, j)
    exact = (a.whole[i].astype(object) * b.whole[j].astype(object)).sum(1)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64) if len(i) else np.zeros(0, np.int64)


def _kth(group: np.ndarray, value: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of n groups its k-th largest value; -inf where it has fewer."""
    order = np.lexsort((-value, group))
    begins = np.searchsorted(group[order], np.arange(n))
    counts = np.bincount(group, minlength=n)
    out = np.full(n, -np.inf)
    enough = counts >= k
    out[enough] = value[order][begins[enough] + k - 1]
    return out


def _best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k first by score, then id."""
    order = np.lexsort((ident, -score, group))
    sorted_group = group[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group)
    return order[place < k]


def _pairs(a: Block, b: Block, s: slice, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, room: np.ndarray, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i of anchors in s, j of rows, exact score) that are allowed and may be among the k best from low to high, in one of an
    anchor's bands (columns of low and high). room: how far low and high may be off. Products are of whole matrices until few
    pairs are left, then of those pairs."""
    n, bands, done = allowed.shape[0], range(low.shape[1]), 0
    product, i, j = np.zeros(allowed.shape), None, None
    for stage in a.stages:
        if i is None:
            product += a.turned[s, done:stage] @ b.turned[:, done:stage].T
            rest = np.outer(a.left[stage][s], b.left[stage])
            rest += SLACK * np.outer(a.norm[s], b.norm)
            under, over = product - rest, product + rest
            stay = allowed & (over >= (low - room).min(1)[:, None]) & (under <= (high + room).max(1)[:, None])
            last, share = stage == a.stages[-1], np.count_nonzero(stay)
            if share > FEW * stay.size and (last or share < 0.8 * np.count_nonzero(allowed)):  # else bounds are too wide as yet
                kept = np.zeros(stay.shape, bool)
                for c in bands:
                    sure = stay & (under >= (low + room)[:, c, None]) & (over <= (high - room)[:, c, None])
                    least = np.maximum((low - room)[:, c], _kth_of_rows(np.where(sure, under, -np.inf), k))
                    kept |= (over >= least[:, None]) & (under <= (high + room)[:, c, None])
                stay &= kept
            if last or np.count_nonzero(stay) <= FEW * stay.size:
                i, j = np.nonzero(stay)
                product, under, over = product[i, j], under[i, j], over[i, j]
        else:
            product = product + _products(a.turned[s, done:stage], i, b.turned[:, done:stage], j)
            rest = a.left[stage][s][i] * b.left[stage][j] + SLACK * a.norm[s][i] * b.norm[j]
            under, over = product - rest, product + rest
        done = stage
        if i is not None:
            stay = np.zeros(len(i), bool)
            for c in bands:
                sure = (under >= (low + room)[i, c]) & (over <= (high - room)[i, c])
                least = np.maximum((low - room)[:, c], _kth(i[sure], under[sure], k, n))
                stay |= (over >= least[i]) & (under <= (high + room)[i, c])
            i, j, product = i[stay], j[stay], product[stay]
    return i, j, _exact(a, np.arange(a.whole.shape[0])[s][i], b, j, d)


def _kth_of_rows(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, -k, 1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _strips(anchors: int, rows: int) -> Iterator[slice]:
    step = max(1, STRIP // max(1, rows))
    return (slice(i, min(i + step, anchors)) for i in range(0, anchors, step))


def _range(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _grid(rows: DataFrame, anchors: DataFrame, n: int, m: int) -> tuple[DataFrame, DataFrame]:
    """Both with the blocks of a pair in _r and _a: each block of rows beside each of anchors."""
    r, a = -(-n // ROWS) or 1, -(-m // ANCHORS) or 1
    dealt = rows.withColumn("_r", F.pmod(F.xxhash64("id"), F.lit(r))).withColumn("_a", F.explode(_range(a)))
    asked = anchors.withColumn("_a", F.pmod(F.xxhash64("id", F.lit("anchor")), F.lit(a))).withColumn("_r", F.explode(_range(r)))
    return dealt, asked


def _table(columns: dict[str, tuple[pa.DataType, list[np.ndarray]]]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(v) if v else [], t) for n, (t, v) in columns.items()})


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95)) -> DataFrame:
    """rows(id, label, vector), of which anchor says which are queries, as (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score). A negative's score, times 100, is from band[0] to band[1] times its positive's."""
    spark = rows.sparkSession
    ship(spark)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("m")).select("id", "m.label", "m.vector")
    rows = materialise(rows, "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(anchor).alias("m"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()
    n, m, d = counts["n"], counts["m"], counts["d"]
    shared = spark.sparkContext.broadcast(rotation(rows, d) if d else np.zeros((0, 0)))  # ROTATED * ROTATED numbers at most
    anchors = rows.filter(anchor)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        b, a = Block(left, d, shared.value), Block(right, d, shared.value)
        found: dict[str, list[np.ndarray]] = {"anchor_id": [], "positive_id": [], "positive_score": []}
        for s in _strips(len(a.id), len(b.id)):
            allowed = (a.label[s][:, None] == b.label[None, :]) & (a.id[s][:, None] != b.id[None, :])
            every = np.full((allowed.shape[0], 1), np.inf)
            i, j, score = _pairs(a, b, s, allowed, -every, every, 0 / every, positives, d)
            best = _best(i, score, b.id[j], positives)
            for name, v in zip(found, (a.id[s][i[best]], b.id[j[best]], score[best]), strict=True):
                found[name].append(v)
        return _table({c: (pa.int64(), v) for c, v in found.items()})

    dealt, asked = _grid(rows, anchors, n, m)
    near = dealt.groupBy("_r", "_a").cogroup(asked.groupBy("_r", "_a")).applyInArrow(nearest, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= positives).drop("_n")
    each = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p"))  # positives at most
    wanted = materialise(anchors.join(each, anchors["id"] == each["anchor_id"]).select("id", "label", "vector", F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score")), "positives")

    def harder(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        found: dict[str, list[np.ndarray]] = {c: [] for c in names}
        if left.num_rows and right.num_rows:
            b, a = Block(left, d, shared.value), Block(right, d, shared.value)
            counts = pc.list_value_length(right.column("positive_id")).to_numpy()
            row, place = np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            positive, its = (np.zeros((len(counts), positives), np.int64) for _ in range(2))
            there = np.zeros(positive.shape, bool)
            there[row, place] = True
            for c, out in (("positive_id", positive), ("positive_score", its)):
                out[row, place] = right.column(c).combine_chunks().flatten().to_numpy()
            for s in _strips(len(a.id), len(b.id)):
                top = its[s].astype(float)
                room = np.abs(top) * 2.0**-40 + 1  # the bands' ends as doubles; their exact test is below
                low, high = (np.where(there[s], top * share / 100, missing) for share, missing in zip(band, (np.inf, -np.inf), strict=True))
                i, j, score = _pairs(a, b, s, a.label[s][:, None] != b.label[None, :], low, high, room, negatives, d)
                exact = score.astype(object) * 100
                for c in range(positives):
                    bar = its[s][i, c].astype(object)
                    inside = np.flatnonzero(there[s][i, c] & (bar * band[0] <= exact).astype(bool) & (exact <= bar * band[1]).astype(bool))
                    best = inside[_best(i[inside], score[inside], b.id[j[inside]], negatives)]
                    for name, v in zip(names, (a.id[s][i[best]], positive[s][i[best], c], its[s][i[best], c], b.id[j[best]], score[best]), strict=True):
                        found[name].append(v)
        return _table({c: (pa.int64(), v) for c, v in found.items()})

    dealt, asked = _grid(rows, wanted, n, m)
    hard = dealt.groupBy("_r", "_a").cogroup(asked.groupBy("_r", "_a")).applyInArrow(harder, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
