"""Best-fit packing of token sequences by linear grouping.

Tokens are counted on the executors; the plan is made from the histogram of piece lengths, which has at most
``capacity`` rows whatever the size of the corpus:

1. lengths above ``small`` are sorted and cut into ``groups`` groups of equal cardinality, each rounded up to
   its longest member;
2. configurations of these few sizes are chosen one after another, each around the largest size left and
   filled as far as any subset of the rest can (bounded subset sums);
3. actual pieces take the places of the rounded sizes;
4. the small pieces, longest first, go where they fit best, or into new sequences.

A piece finds its place by its rank among the pieces of its length: ranks are counted per (length, salt), so
that a length that many documents share isn't one task.

Defined results: a null or empty text has the closing id alone; texts of any length are cut into pieces of
``capacity``, the last may be shorter; repeated rows and ties are pieces of their own, ordered by
(key, piece, checksum); a null key sorts first; an empty table packs into nothing. Extra columns don't take part.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import threading
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_python, materialise, starts

CAPACITY = 4096
END_ID = 1
#: Bounds of the memory that a worker keeps words in; without effect on results.
CACHED_WORDS, CACHED_LENGTH = 300_000, 64
#: Seconds without texts after which a worker gives that memory back; Spark keeps idle workers for later stages and for a minute.
IDLE = 5
#: Signs that may follow a word; the tokenizer puts them into one pre-token, and the letters before them into another.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = re.compile(rf"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(_SIGNS)}]*)").fullmatch

_encoders: dict = {}
_users, _users_lock = [0, 0], threading.Lock()  # calls that use encoders now, and all calls so far


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes. The tokenizer's pre-tokens never cross white space and its
    normaliser looks at no context beyond it, so ids of the stretches between blanks, once joined, are the text's ids. A
    stretch of letters and then signs has two pre-tokens, and the letters' ids don't depend on their case; new runs of
    letters are encoded as one string, cut at the ids that end words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # two generations of words: what is still used moves on when the elder one goes
        self.tokenizer, self.known, self.elder = Tokenizer.from_file(path), {"": b""}, {}
        self.of_letters = Tokenizer.from_file(path)  # for lower-case letters, which its normaliser and its pattern leave as they are
        self.of_letters.normalizer = normalizers.Sequence([])
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_letters(self, parts: list[str]) -> list[bytes]:
        ids = np.asarray(self.of_letters.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(ends) != len(parts):
            return self._encode(parts)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, stretches: set[str]) -> list[str]:
        """Adds stretches to those known, with the letters and signs that they are made of; returns those too long to stay."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.elder = {"": b""}, self.known
        known, elder, odd, made, letters, signs = self.known, self.elder, [], [], set(), set()
        for x in stretches:
            if x in known:
                continue
            if x in elder:
                known[x] = elder[x]
                continue
            if x.isascii():
                word = x.rstrip(_SIGNS)
                tail = x[len(word) :]
                plain = word.isalpha()
            elif plain := _PLAIN(x):
                word, tail = plain[1], plain[2]
            if not plain:
                odd.append(x)
                continue
            word = word.lower()
            letters.add(word)
            if word != x:
                signs.add(tail)
                made.append((x, word, tail))
        letters, signs = [x for x in letters if x not in known], [x for x in signs if x not in known]
        known.update(zip(signs, self._encode(signs), strict=True))
        if letters:
            known.update(zip(letters, self._encode_letters(letters), strict=True))
        known.update(zip(odd, self._encode(odd), strict=True))
        for x, word, tail in made:
            known[x] = known[word] + known[tail] if tail else known[word]
        return [x for part in (odd, letters, signs) for x in part if len(x) > CACHED_LENGTH] + [x[0] for x in made if len(x[0]) > CACHED_LENGTH]

    def __call__(self, texts: list[str]) -> list[bytes]:
        rows = [x.replace("\n", " ").split(" ") for x in texts]
        long = self._learn(set().union(*rows))
        get = self.known.__getitem__
        out = [b"".join(map(get, row)) for row in rows]
        for x in long:
            self.known.pop(x, None)
        return out


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release(calls: int | None = None) -> None:
    """Gives the memory of this process's encoders back to the system, unless one is in use or, with calls, others have used them since."""
    with _users_lock:
        if _users[0] or calls not in (None, _users[1]):
            return
        _encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


@contextmanager
def encoding(path: str) -> Iterator[Encoder]:
    """The encoder of a file while texts are encoded. It stays for IDLE seconds more, for the next task."""
    with _users_lock:
        _users[:] = _users[0] + 1, _users[1] + 1
    gc.disable()  # words are many objects without cycles, and looking for some takes a sixth of the time
    try:
        yield encoder(path)
    finally:
        gc.enable()
        with _users_lock:
            _users[0] -= 1
            timer = threading.Timer(IDLE, release, [_users[1]])
        timer.daemon = True
        timer.start()


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()
    for_python(df.sparkSession, 1000)
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batch: pa.RecordBatch, ids_of: list[bytes]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for k, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
            ids += end
            for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((k, i, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(path) as encode:
            for batch in batches:
                yield cut(batch, encode([t or "" for t in batch.column(1).to_pylist()]))

    names = [key, "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias("_text")).mapInArrow(run, f"`{key}` long, piece int, start long, length long, ids_crc32 long")


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How often each size (descending) stands in one sequence: the largest one left, and of the rest the subset with the
    largest sum that still fits."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i in range(first, len(sizes)):
        for _ in range(min(left[i] - (i == first), room // sizes[i])):
            new = reach | (reach << sizes[i]) & full
            if new == reach:
                break
            steps.append((i, reach))
            reach = new
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    used, total = [0] * len(sizes), reach.bit_length() - 1
    used[first] = 1
    for i, before in reversed(steps):
        if not before >> total & 1:
            used[i] += 1
            total -= sizes[i]
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 1000, small: int | None = None) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, offset), and the number of sequences. The pieces of that length with
    those ranks go to consecutive sequences, each at that offset."""
    small = capacity // 4 if small is None else small
    rank = dict.fromkeys(histogram, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
    mask, n_sequences = 0, 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, rank[length], count, first, offset))
        rank[length] += count

    def leave(room: int, first: int, count: int) -> None:
        nonlocal mask
        open_bins.setdefault(room, []).append((first, count))
        mask |= 1 << room

    # 1. equal-cardinality groups of the large lengths
    large = sorted((x for x in histogram.items() if x[0] > small), reverse=True)
    per_group = -(-sum(n for _, n in large) // groups)
    members: dict[int, list[list[int]]] = {}  # rounded size -> [length, count], longest first
    size, room = 0, 0
    for length, count in large:
        while count:
            if not room:
                size, room = length, per_group
            take = min(count, room)
            members.setdefault(size, []).append([length, take])
            count, room = count - take, room - take

    # 2. configurations of the few sizes, and 3. actual pieces in them
    sizes = sorted(members, reverse=True)
    left = [sum(n for _, n in members[s]) for s in sizes]
    while any(left):
        used = _configuration(sizes, left, capacity)
        times = min(n // k for n, k in zip(left, used, strict=True) if k)
        slots: list[list[list[int]]] = []
        for i, k in enumerate(used):
            left[i] -= k * times
            for _ in range(k):
                runs, need = [], times
                while need:
                    head = members[sizes[i]][0]
                    take = min(need, head[1])
                    runs.append([head[0], take])
                    head[1] -= take
                    need -= take
                    if not head[1]:
                        members[sizes[i]].pop(0)
                slots.append(runs)
        while times:
            count, offset = min(runs[0][1] for runs in slots), 0
            for runs in slots:
                place(runs[0][0], count, n_sequences, offset)
                offset += runs[0][0]
                runs[0][1] -= count
                if not runs[0][1]:
                    runs.pop(0)
            leave(capacity - offset, n_sequences, count)
            n_sequences += count
            times -= count

    # 4. small pieces where they fit best
    for length, count in sorted((x for x in histogram.items() if x[0] <= small), reverse=True):
        while count:
            if fits := mask >> length:
                room = length + (fits & -fits).bit_length() - 1
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    mask &= ~(1 << room)
                each = min(room // length, max(1, count // n))  # as many as fit, while there are enough for all of them
                n_in = min(n, count // each)
            else:
                room, first, each = capacity, n_sequences, min(capacity // length, count)
                n = n_in = count // each
                n_sequences += n
            for k in range(each):
                place(length, n_in, first, capacity - room + k * length)
            count -= each * n_in
            leave(room - each * length, first, n_in)
            if n > n_in:
                leave(room, first + n_in, n - n_in)
    return np.asarray(rows, np.int64).reshape(-1, 5), n_sequences


def pack(found: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, groups: int = 1000) -> DataFrame:
    """found (of pieces(), written) with sequence_id and offset."""
    salts = max(1, found.count() // 20_000)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counted = materialise(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    rows, _ = plan(histogram, capacity, groups)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    before = starts(counted, ["length"], "_salt", "_n", "_before").drop("_n")
    within = Window.partitionBy("length", "_salt").orderBy(key, "piece", "ids_crc32", "start")
    ranked = salted.withColumn("_at", F.row_number().over(within) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = rows[:, 0]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            low, high = np.searchsorted(lengths, length, "left"), np.searchsorted(lengths, length, "right")
            while (high - low > 1).any():  # the last row of that length that starts at or below the rank
                middle = (low + high) // 2
                below = rows[np.minimum(middle, len(rows) - 1), 1] <= rank
                wide = high - low > 1
                low, high = np.where(wide & below, middle, low), np.where(wide & ~below, middle, high)
            sequence = rows[low, 3] + rank - rows[low, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(rows[low, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    columns = [key, "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "_rank").mapInArrow(run, f"`{key}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = 1000) -> DataFrame:
    """Tokenises, cuts and packs the texts of df. Token counts are written to the shared folder in between, since both the
    histogram and the placing read them."""
    return pack(materialise(pieces(df, key, text, tokenizer, capacity), "pieces"), key, capacity, groups)
