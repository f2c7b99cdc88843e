"""Near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles, banded and verified.

1. A shingle of five words weighs tf * idf, idf = 1 + ln(N / df). df is counted by 2^CLASS_BITS hash classes over all
   documents, a table of fixed size. The share of documents that a rare shingle's class holds by accident depends on the
   length of texts alone, so the weights mean the same at every size of the corpus.
2. A large group of copies counts about once in N and df: otherwise what its members share would weigh little, for no other
   reason than that they are copies, and each one's edits much. A sketch of each text (one permutation, SKETCHES keys of
   SKETCH minima) finds such groups: a key that a HOT-th of all documents share, or more, is hot, and a document with hot keys
   counts as one over the largest one's documents. There are SKETCHES * HOT hot keys at most. Smaller groups stay below what
   hash classes hold by accident.
3. Each text gets 64 samples, in 16 bands of 4. A pair of weighted similarity 0.8 misses all bands with a probability of
   0.0002. A shingle's gamma and uniform variates are one of 2^16 sets, chosen by its hash for each sample; equal
   variates are told apart by the hash.
4. In each bucket the members are held against the most popular one (that with the largest buckets: an
   original rather than an edited copy of it), so the pairs are no more than the rows. Pairs whose signatures agree in
   38 of 64 samples or more (a pair of similarity 0.8 fails that with a probability of 0.00004) are verified by exact
   weighted Jaccard similarity. Links make classes (connected components).
5. Buckets whose members are then of several classes are compared between classes, in pairs of blocks, by signature and
   then by similarity; a pair that is of one class by then is passed over. Nothing is capped. Links make classes again.

Defined results: texts with the same words are copies of each other, whatever the white space; texts without
words, null among them, are such copies too. Texts under five words have one shingle of all their words. Texts of any length
and shingles of any frequency are weighed exactly. Null keys count as keys; a class is named by its least key (null only
where all keys are). Repeated rows are rows of one class. Empty tables give empty ones. Extra columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_python, materialise
from .graph import components
from .words import mix, shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND = 16, 4
SAMPLES = BANDS * BAND
CLASS_BITS, SLICES = 20, 64
TASKS = 500  # tasks whose counts meet in one group, before the groups' counts do
SKETCHES, SKETCH, HOT = 8, 3, 4000
AGREE = 38  # samples of 64 that a pair's signatures share at least
BLOCK, BLOCK_SHINGLES = 512, 1 << 18

_rng = np.random.default_rng(811)
_MULTIPLIERS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.maximum(_rng.gamma(2, 1, 1 << 16), 1e-3).astype(np.float32)
_BETA = _rng.random(1 << 16).astype(np.float32)
_START = (np.log(_rng.gamma(2, 1, 1 << 16)) + _R * _BETA - _R).astype(np.float32)  # ln a = this - r t
_PER_R = (1 / _R).astype(np.float32)


def text_id(text: Column) -> Column:
    """128 bits of a text's words."""
    return F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")))


def distinct_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in ascending order, how often each occurs there, and the rows' offsets."""
    found, at = shingles(*word_hashes(column), SHINGLE)
    parts, times = [], []
    for i in range(len(at) - 1):
        own, n = np.unique(found[at[i] : at[i + 1]], return_counts=True)
        parts.append(own)
        times.append(n)
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([*times, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, parts)])


def sketch_keys(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SKETCHES keys of each row with shingles, of the least of them in equal ranges of hashes; an empty range takes the next
    one's. Zeros for rows without shingles."""
    bins = SKETCHES * SKETCH
    places = (np.arange(bins, dtype=np.uint64) * np.uint64(2**64 // bins)).astype(np.uint64)
    least = np.zeros((len(at) - 1, bins), np.uint64)
    for i in np.flatnonzero(np.diff(at)):
        own = found[at[i] : at[i + 1]]
        least[i] = own[np.searchsorted(own, places) % len(own)]
    keys = np.zeros((len(at) - 1, SKETCHES), np.uint64)
    for k in range(SKETCH):
        keys = mix(keys ^ mix(least[:, k::SKETCH] + np.uint64(k + 1)))
    keys = mix(keys + np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    keys[np.diff(at) == 0] = 0
    return keys


def hot_keys(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sketch keys that a HOT-th of all texts share (two at least), ascending, and the number of texts of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _, at = distinct_shingles(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(sketch_keys(found, at)[np.diff(at) > 0].ravel().view(np.int64))], ["k"])

    counted = materialise(texts.select("text").mapInArrow(run, "k long").groupBy("k").agg(F.count("*").alias("n")), "sketches")
    n = (counted.agg(F.sum("n")).first()[0] or 0) / SKETCHES
    hot = counted.filter(F.col("n") >= max(2.0, n / HOT)).collect()  # SKETCHES * HOT rows at most
    keys, times = np.array([r["k"] for r in hot], np.int64).view(np.uint64), np.array([r["n"] for r in hot], float)
    order = np.argsort(keys)
    return keys[order], times[order]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, float]:
    """Documents with a shingle of each hash class, and the number of documents, large groups of copies counted about once.
    texts: (tid, text)."""
    hot = texts.sparkSession.sparkContext.broadcast(hot_keys(texts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, (keys, times) = np.zeros(1 << CLASS_BITS), 0.0, hot.value
        for batch in batches:
            found, _, at = distinct_shingles(batch.column("text"))
            share = np.ones(len(at) - 1)
            if len(keys):
                own = sketch_keys(found, at)
                near = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                share /= np.where(keys[near] == own, times[near], 1.0).max(1)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            both = np.unique((row << CLASS_BITS) | (found >> np.uint64(64 - CLASS_BITS)).astype(np.int64))
            total += np.bincount(both & ((1 << CLASS_BITS) - 1), share[both >> CLASS_BITS], 1 << CLASS_BITS)
            n += share[np.diff(at) > 0].sum()
        if n:
            task = TaskContext.get().partitionId() // TASKS
            parts = np.split(total.astype("<f4"), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([n] * SLICES, pa.float64())], ["slice", "part", "counts", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((1 << CLASS_BITS) // SLICES), 0.0
        for batch in batches:
            for counts, more in zip(batch.column("counts"), batch.column("n"), strict=True):
                total += np.frombuffer(counts.as_buffer(), "<f4")
                n += more.as_py()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary()), pa.array([n], pa.float64())], ["slice", "part", "counts", "n"])

    schema = "slice int, part int, counts binary, n double"
    counted = texts.select("text").mapInArrow(count, schema).groupBy("slice", "part").applyInArrow(add, schema)
    rows = counted.groupBy("slice").applyInArrow(add, schema).collect()  # SLICES rows
    total = np.zeros(1 << CLASS_BITS)
    for r in rows:
        width = (1 << CLASS_BITS) // SLICES
        total[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], "<f4")
    return total, rows[0]["n"] if rows else 0.0


def idf_table(counts: np.ndarray, n: float) -> np.ndarray:
    """1 + ln(N / df) for each hash class; no class has less than one document."""
    n = max(n, 1.0)
    return (1 + np.log(n / np.clip(counts, 1, n))).astype(np.float32)


def weights(found: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return times.astype(np.float32) * idf[(found >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]


def icws(found: np.ndarray, weight: np.ndarray, at: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Samples as 64-bit numbers, a row of SAMPLES for each row; rows without shingles get zeros. A sample is the shingle of
    least a = c exp(-r (t - beta) - r), with its t = floor(ln w / r + beta)."""
    out, first = np.zeros((len(at) - 1, SAMPLES), np.uint64), 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + chunk, "right")) - 1)
        own, log = found[at[first] : at[last]], np.log(weight[at[first] : at[last]])
        rows = first + np.flatnonzero(np.diff(at[first : last + 1]))
        if len(own):
            starts = at[rows] - at[first]
            least = np.arange(len(own), dtype="<u8")  # low half: the place; high half: a, a positive float, whose bits have its order
            high = least.view("<u4")[1::2]
            for k in range(SAMPLES):
                index = ((own * _MULTIPLIERS[k]) >> np.uint64(48)).astype(np.intp)
                t = np.floor(log * _PER_R.take(index) + _BETA.take(index))
                high[:] = np.exp(_START.take(index) - _R.take(index) * t).view(np.uint32)
                won = (np.minimum.reduceat(least, starts) & np.uint64(0xFFFFFFFF)).astype(np.intp)
                out[rows, k] = own[won] + t[won].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first = last
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band of each row; bands never share numbers but by accident."""
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for k in range(BAND):
        keys = mix(keys ^ mix(samples[:, k::BAND] + np.uint64(k + 1)))
    return mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def signatures(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(tid, keys, signature, size) for each row of texts(tid, text); size: distinct shingles."""
    idf = texts.sparkSession.sparkContext.broadcast(idf)  # 2^20 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times, at = distinct_shingles(batch.column("text"))
            samples = icws(found, weights(found, times, idf.value), at)
            keys = band_keys(samples)
            short = (mix(samples) >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary()), pa.array(np.diff(at))], ["tid", "keys", "signature", "size"])

    return texts.select("tid", "text").mapInArrow(run, "tid string, keys array<long>, signature binary, size long")


def vectors(texts: DataFrame) -> DataFrame:
    """(tid, shingles, times): what verification compares, as bytes; times in one byte each where all are under 256, else in four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times, at = distinct_shingles(batch.column("text"))
            rows = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
            counts = [times[r].astype("u1" if times[r].max(initial=0) < 256 else "<u4").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array([found[r].tobytes() for r in rows], pa.binary()), pa.array(counts, pa.binary())], ["tid", "shingles", "times"])

    return texts.select("tid", "text").mapInArrow(run, "tid string, shingles binary, times binary")


def similarity(a: bytes, a_times: bytes, b: bytes, b_times: bytes, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two vectors."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    wx, wy = (weights(v, np.frombuffer(t, "u1" if len(t) == len(v) else "<u4"), idf) for v, t in ((x, memoryview(a_times)), (y, memoryview(b_times))))
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    both = np.minimum(wx[at[same]], wy[same]).sum(dtype=float)
    return float(both / (wx.sum(dtype=float) + wy.sum(dtype=float) - both))


def verify(pairs: DataFrame, vecs: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The pairs (a, b) of that similarity at least. The side with hot keys is joined last, where its rows can be split."""
    idf = pairs.sparkSession.sparkContext.broadcast(idf)
    left = vecs.select(F.col("tid").alias("b"), F.col("shingles").alias("sb"), F.col("times").alias("tb"))
    right = vecs.select(F.col("tid").alias("a"), F.col("shingles").alias("sa"), F.col("times").alias("ta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [similarity(*(x.as_buffer() for x in r), idf.value) >= least for r in zip(*(batch.column(c) for c in ("sa", "ta", "sb", "tb")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(left, "b").join(right, "a").select("a", "b", "sa", "ta", "sb", "tb").mapInArrow(run, "a string, b string")


def alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough."""
    left = signed.select(F.col("tid").alias("b"), F.col("signature").alias("gb"))
    right = signed.select(F.col("tid").alias("a"), F.col("signature").alias("ga"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SAMPLES) for c in ("ga", "gb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE))

    return pairs.join(left, "b").join(right, "a").select("a", "b", "ga", "gb").mapInArrow(run, "a string, b string")


def _candidates(table: pa.Table, apart: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) of the pairs of different labels and, if apart, blocks, whose signatures agree often enough and which
    share this bucket's band first."""
    _, label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
    own, sig = table["own"].to_numpy(), np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(-1, SAMPLES)
    band = table["band"][0].as_py()
    for i in range(len(own) - 1):
        same = sig[i + 1 :] == sig[i]
        ok = (label[i + 1 :] != label[i]) & (same.sum(1) >= AGREE)
        if apart:
            ok &= own[i + 1 :] != own[i]
        at = np.flatnonzero(ok)
        at = at[same[at].reshape(-1, BANDS, BAND).all(2).argmax(1) == band]
        if len(at):
            yield i, at + i + 1


def between_classes(members: DataFrame, signed: DataFrame, vecs: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Links (a, b) between members(tid, bucket, band, label, size) of one bucket but different labels: for any two labels with a
    link in a group one link at least, directly or by way of others.

    Buckets are cut into blocks of about BLOCK members or BLOCK_SHINGLES shingles by hash, and each two blocks are one group, so no
    group grows with its bucket. Groups get signatures first, whatever the texts' length; only rows that may have a link in a
    group come back with their vectors. A pair is looked at in the first band that it shares, and passed over once its labels are
    joined, so no pairs leave a group but links."""
    shared = members.sparkSession.sparkContext.broadcast(idf)
    mixed = members.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"), F.sum("size").alias("total")).filter("x != y")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(mixed.select("bucket", blocks.alias("blocks")), "bucket").join(signed.select("tid", "signature"), "tid")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "tid", "label", "signature")

    def likely(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        kept = np.zeros(len(table), bool)
        for i, later in _candidates(table, key[1].as_py() != key[2].as_py()):
            kept[i] = kept[later] = True
        yield from table.filter(pa.array(kept)).to_batches()

    rows = rows.groupBy("bucket", "i", "j").applyInArrow(likely, rows.schema)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("tid").combine_chunks()
        tid, (_, label), a, b = table["tid"].to_pylist(), np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True), [], []
        vector = [(x.as_buffer(), y.as_buffer()) for x, y in zip(table["shingles"], table["times"], strict=True)]
        for i, later in _candidates(table, key[1].as_py() != key[2].as_py()):
            for j in later.tolist():
                if label[j] != label[i] and similarity(*vector[i], *vector[j], shared.value) >= least:
                    a.append(tid[i])
                    b.append(tid[j])
                    label[label == label[j]] = label[i]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return rows.join(vecs, "tid").groupBy("bucket", "i", "j").applyInArrow(run, "a string, b string").distinct()


def text_classes(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(tid, label): for each tid of texts(tid, text) that has near duplicates the least tid of its class."""
    for_python(texts.sparkSession, size="2m")
    idf = idf_table(*document_frequencies(texts))
    signed = materialise(signatures(texts, idf).dropDuplicates(["tid"]), "signatures")

    keys = signed.select("tid", "size", F.posexplode("keys").alias("band", "bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialise(keys.join(shared, "bucket"), "members")
    popular = members.groupBy("tid").agg(F.sum("n").alias("popularity"))
    members = members.select("tid", "band", "bucket", "size").join(popular, "tid")
    hubs = members.groupBy("bucket").agg(F.max(F.struct("popularity", F.col("tid").alias("hub"))).alias("h")).select("bucket", "h.hub")
    pairs = members.join(hubs, "bucket").filter("tid != hub").select(F.col("hub").alias("a"), F.col("tid").alias("b")).distinct()

    wanted = members.select("tid").distinct()
    vecs = materialise(vectors(texts.join(wanted, "tid", "left_semi")).dropDuplicates(["tid"]), "vectors")
    links = materialise(verify(alike(pairs, signed), vecs, idf, least), "links")
    labels = components(links)
    labelled = members.select("tid", "band", "bucket", "size").join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    more = materialise(between_classes(labelled, signed, vecs, idf, least), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    return labels.select(F.col("node").alias("tid"), "label")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A row per row of df: key, class_id (least key of its near-duplicate class), copy_of (least key of the rows with its
    words), tid (of its words) and class_tid (of its class)."""
    rows = df.select(F.col(f"`{key}`").alias(key), text_id(F.col(f"`{text}`")).alias("tid"), F.col(f"`{text}`").alias("text"))
    labels = text_classes(rows.select("tid", "text"), least)
    copies = rows.groupBy("tid").agg(F.min(key).alias("copy_of")).join(labels, "tid", "left").withColumn("class_tid", F.coalesce("label", "tid")).drop("label")
    classes = copies.groupBy("class_tid").agg(F.min("copy_of").alias("class_id"))
    named = copies.join(classes, "class_tid")
    return rows.drop("text").join(named, "tid").select(key, "class_id", "copy_of", "tid", "class_tid")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of df, one of each class: that with the least key; the columns of df only."""
    found = near_duplicates(df, key, text, least)
    # the least key of a class may belong to several of its texts or rows: the least tid of them stays
    kept = found.filter(F.col(key).eqNullSafe(F.col("class_id"))).groupBy("class_tid").agg(F.min("tid").alias("_tid"), F.first("class_id").alias("_key")).select("_tid", "_key")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(row, text_id(F.col(f"`{text}`")).alias("_tid"), F.col(f"`{key}`").alias("_own"))
    same = rows.join(kept, (rows["_tid"] == kept["_tid"]) & rows["_own"].eqNullSafe(kept["_key"]), "left_semi")
    return same.dropDuplicates(["_tid", "_own"]).select("_row.*")
