"""Document fingerprints by order MinHash, which follows edit distance rather than shared content alone.

A text's k-mers are numbered by occurrence, so each is one element. Each of SLOTS permutations of the elements chooses
TUPLE minimal ones, puts them back into the order they have in the text, and hashes that tuple; two texts' likeness
is the share of slots with equal hashes. The permutations are rotations of one hash: the minimal elements of
a slot are those next to its place on the ring of hashes, so one sort serves all slots.

edited_pairs() holds each document against a copy whose end is that of its next one, by descending key. Rows are
dealt by ranges of (key, hash of the text), so that neighbours meet in one task; the first and last rows of the
ranges are joined in a second step. A key that many rows share is split over tasks by the hash.

Defined results: null texts count as empty; the fingerprint of an empty text is all zeros, and two empty texts are alike
(1.0); texts shorter than a k-mer have one element, themselves; texts of any length are read whole; equal texts
have equal fingerprints. Null keys come last; rows of equal keys are ordered by a hash of the text, repeated rows
are neighbours; a single document is its own next one; an empty table gives an empty one. Extra columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import for_python, materialise
from .words import mix

KMER, TUPLE, SLOTS = 8, 2, 64
_FACTORS = np.random.default_rng(88).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = (np.arange(SLOTS, dtype=np.uint64) << np.uint64(58)).astype(np.uint64)


def elements(points: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers of a text's code points, in text order."""
    n = len(points) - KMER + 1
    if n < 1:
        if not len(points):
            return np.zeros(0, np.uint64)
        return mix(np.array([(points * _FACTORS[: len(points)]).sum() + np.uint64(len(points))], np.uint64))
    kmers = points[:n] * _FACTORS[0]
    for k in range(1, KMER):
        kmers += points[k : n + k] * _FACTORS[k]
    kmers = mix(kmers)
    bits = np.uint64(n.bit_length())
    order = np.sort((kmers >> bits << bits) | np.arange(n, dtype=np.uint64))
    first = np.concatenate([[True], (order[1:] >> bits) != (order[:-1] >> bits)])
    if not first.all():
        starts = np.flatnonzero(first)
        number = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        at = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        kmers[at] += number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        kmers = mix(kmers)
    else:
        kmers = mix(kmers)
    return kmers


def fingerprint(text: str) -> np.ndarray:
    """SLOTS numbers of 16 bits."""
    found = elements(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64))
    n = len(found)
    if not n:
        return np.zeros(SLOTS, "<u2")
    bits = np.uint64(n.bit_length())
    ring = np.sort((found >> bits << bits) | np.arange(n, dtype=np.uint64))
    start = np.searchsorted(ring, _PLACES)
    chosen = ring[(start[:, None] + np.arange(min(TUPLE, n))) % n] & ((np.uint64(1) << bits) - np.uint64(1))
    in_order = found[np.sort(chosen.astype(np.int64), axis=1)]
    out = np.full(SLOTS, 1, np.uint64)
    for k in range(in_order.shape[1]):
        out = mix(out * np.uint64(31) + in_order[:, k])
    return np.maximum(out >> np.uint64(48), np.uint64(1)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint) for each row of df."""
    for_python(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(x).astype(">u2").tobytes().hex() for x in texts], pa.string())], [key, "n_chars", "fingerprint"])

    kind = df.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_chars long, fingerprint string")


_COLUMNS = "key long, n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double"


def _compare(key, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    """A row of _COLUMNS."""
    k = len(text) // 3
    edited = text[: len(text) - k] + following[:k]
    other = fingerprint(edited) if edited != text else own
    return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes(), other.tobytes(), likeness(own, other), likeness(own, its)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in _COLUMNS.split(", ")]


def edited_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row of df."""
    spark = df.sparkSession
    for_python(spark, 200)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("key").desc_nulls_last(), F.col("tie").asc()]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of _COLUMNS with part -1; the first and the last row of the range come with their texts and its number."""
        part, before, names = TaskContext.get().partitionId(), None, [*_NAMES, "part", "edge", "text"]
        kinds = [*_KINDS, pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = fingerprint(t)
                if before is None:
                    out.append((k, len(t), None, own.tobytes(), None, None, None, part, "first", t))
                else:
                    out.append((*_compare(*before, t, own), -1, None, None))
                before = (k, t, own)
            yield _batch(out, kinds, names)
        if before is not None:
            yield _batch([(before[0], len(before[1]), None, before[2].tobytes(), None, None, None, part, "last", before[1])], kinds, names)

    made = materialise(dealt.select("key", "text").mapInArrow(run, f"{_COLUMNS}, part int, edge string, text string"), "fingerprints")

    # two rows a range: each range's last row meets the first row of the range after it, or of the first range
    edges = made.filter("edge is not null")
    parts = edges.filter("edge = 'first'").select("part")
    everywhere = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(everywhere), F.first("part").over(everywhere)).alias("next"))
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("own").alias("its"))
    met = edges.filter("edge = 'last'").select("key", "text", "own", "part").join(after, "part").join(firsts, "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "text", "own", "following", "its")), strict=True)
            yield _batch([_compare(k, t, np.frombuffer(own, "<u2"), f, np.frombuffer(its, "<u2")) for k, t, own, f, its in rows], _KINDS, _NAMES)

    closed = met.select("key", "text", "own", "following", "its").mapInArrow(close, _COLUMNS)
    every = made.filter("edge is null").select(*_NAMES).unionByName(closed)

    def shown(c: str) -> Column:
        return F.lower(F.hex(c))

    return every.select(F.col("key").alias(key), "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("edited").alias("edited_fingerprint"), "near_edited", "near_next")
