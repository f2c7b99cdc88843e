"""Benchmark decontamination: which words of documents lie in passages that benchmark items have too.

Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case as far as ASCII goes. A window is
`size` consecutive words of an item, or all words of a shorter one. One Aho-Corasick automaton over the windows of all items
reads a document's words once and reports every window where it ends; the words' places in the original text turn hits into
passages of it.

The automaton's alphabet is the words of the benchmark, numbered: any other word is 0 and leads to its root. Items are dealt
by hash into blocks of about BLOCK bytes (one block for most benchmarks), and only a block's rows are broadcast, so what a worker holds
doesn't grow with the benchmark; documents are then read once for each block, without a shuffle. An item is never cut, so a
block is as large as its largest item at least.

Null texts and texts without words hit nothing and are hit by nothing. Rows of equal item id are one item; a null id counts as
the empty one. Documents are rows of their own, so repeated ones give repeated results. An empty benchmark hits nothing, and
an empty table of documents gives an empty one. A column of df that has the name of a result gives way to it.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import for_python, with_results

SIZE = 10
BLOCK = 2 << 20  # bytes of benchmark texts
AT_ONCE = 1 << 20  # bytes of a document whose words are objects at one time

#: What a byte is in normalised text: itself, its lower case, or a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs of some AT_ONCE bytes."""
    plain, at = raw.translate(_PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + AT_ONCE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class Windows:
    """The automaton of a block's windows. owners[k]: the items that have window k; sizes[k]: its words."""

    def __init__(self, items: Iterable[tuple[str, bytes]], size: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, raw in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for run in normalised(raw) for w in run)
            for i in range(max(len(ids) - size, 0) + 1 if ids else 0):
                found.setdefault(ids[i : i + size], set()).add(item)
        self.owners, self.sizes = list(found.values()), [len(w) for w in found]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, window in enumerate(found):
            self.automaton.add_word(window, k)
        if found:
            self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[list[int]], set[str]]:
        """Number of words, runs of hit words (first, last; ascending and apart), and the items that hit."""
        n, runs, windows, search = 0, [], set(), None
        for words in normalised(raw):
            n += len(words)
            if not self.owners:
                continue
            ids = tuple(self.numbers.get(w, 0) for w in words)
            if search is None:
                search = self.automaton.iter(ids)
            else:
                search.set(ids)  # the state goes on
            for last, k in search:
                first = last - self.sizes[k] + 1
                windows.add(k)
                while runs and runs[-1][1] >= first - 1:
                    first = min(first, runs.pop()[0])
                runs.append([first, last])
        return n, runs, set().union(*(self.owners[k] for k in windows))


def joined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Runs of both."""
    out: list[list[int]] = []
    for first, last in sorted(itertools.chain(a, b)):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def places(raw: bytes, runs: list[list[int]]) -> list[dict[str, int]]:
    """Runs of words as parts of the original text, in code points (end is the first after it)."""
    plain = np.frombuffer(raw.translate(_PLAIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(plain.astype(np.int8), prepend=0, append=0))  # where words begin and end, by turns
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    out, at, n = [], 0, 0
    for first, last in runs:
        start, end = edges[2 * first], edges[2 * last + 1]
        before = n + int(np.count_nonzero(begins[at:start]))
        at, n = end, before + int(np.count_nonzero(begins[start:end]))
        out.append({"start": before, "end": n})
    return out


_built: dict[str, Windows] = {}  # of this worker: the latest


def _windows(block: tuple[str, list, int]) -> Windows:
    name, items, size = block
    if name not in _built:
        _built.clear()
        _built[name] = Windows(items, size)
    return _built[name]


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items' ids and texts, block by block."""
    rows = benchmark.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("binary").alias("raw")).filter("raw is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    n = -(-total // BLOCK) or 1
    for k in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "raw"), F.lit(n)) == k)
        yield [(r["item"], bytes(r["raw"])) for r in own.collect()]


def _pairs(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in names]))


_RESULTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", _pairs("first", "last")), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("passages", _pairs("start", "end"))])
_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """df with n_words, n_hit (words inside a window's occurrence), hits (runs of such words, from 0), items (ids of items that
    hit, sorted as strings), passages (where the runs stand in the text, in code points) and contaminated."""
    spark = df.sparkSession
    for_python(spark)
    results, raw = _RESULTS, F.col(f"`{text}`").cast("binary")
    if text in results.names:
        raise ValueError(f"{text} is the name of a result")
    for i, items in enumerate(_blocks(benchmark, item, item_text)):
        block = spark.sparkContext.broadcast((uuid.uuid4().hex, items, size))

        def make(texts: pa.Array, *before: pa.Array, block=block) -> list[pa.Array]:
            windows, out = _windows(block.value), []
            for r, t in enumerate(texts):
                own = t.as_buffer().to_pybytes() if t.is_valid else b""
                n, runs, hit = windows.scan(own)
                if before:  # what earlier blocks have found
                    runs = joined(runs, [[x["first"], x["last"]] for x in before[0][r].as_py()])
                    hit |= set(before[1][r].as_py())
                out.append((n, sum(b - a + 1 for a, b in runs), [{"first": a, "last": b} for a, b in runs], sorted(hit), places(own, runs) if runs else []))
            return [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(_KINDS), _KINDS, strict=True)]

        df = with_results(df, [raw] if not i else [raw, F.col("hits"), F.col("items")], results, make)
    return df.withColumn("contaminated", F.col("n_hit") > 0)
