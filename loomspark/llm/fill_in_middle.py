"""Fill-in-middle: cuts texts into prefix, middle and suffix between tokens, and puts the parts into another order.

A text's UTF-8 bytes become big integers of a bit for each byte: bytes.translate marks the classes of bytes, the base-2
reader packs the marks, and shifted boolean operations leave a bit where a token ([A-Za-z]+|[^A-Za-z]) begins. bit_count is
the number of tokens, and the byte where a token of a given number begins is the set bit of that rank, found by halving.

Nulls count as empty texts, and the empty key is that of a null; an empty text stays plain, with no tokens. Rows are changed
one by one, so repeated rows give repeated results, and an empty table an empty one. A column of df that has the name of a
result gives way to it. Bytes that aren't UTF-8 stay in the output as they are; restore() reads them as replacement characters.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import for_python, with_results

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, SPM = 90, 20  # of 100: texts from PLAIN on stay plain, and of the others those below SPM begin with their suffix

_LETTERS = bytes(49 if 65 <= b <= 90 or 97 <= b <= 122 else 48 for b in range(256))  # "1" for letters
_WITHIN = bytes(49 if 128 <= b <= 191 else 48 for b in range(256))  # "1" for bytes that begin no character


def _bits(raw: bytes, marks: bytes) -> int:
    """An integer whose bit i is the mark of byte i."""
    return int(raw.translate(marks)[::-1] or b"0", 2)


def boundaries(raw: bytes) -> tuple[int, int]:
    """Bits where tokens begin, and bits where characters do."""
    every, letters = (1 << len(raw)) - 1, _bits(raw, _LETTERS)
    characters = every & ~_bits(raw, _WITHIN)
    return characters & ~(letters & (letters << 1)), characters


def select(bits: int, rank: int) -> int:
    """The place of the set bit that has rank set bits below it; halves the integer, so that all steps together read it about
    twice."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - n, at + half, width - half
    return at


def draws(key: str) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"1:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(raw: bytes, key: str) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of a text."""
    starts, characters = boundaries(raw)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(key)
    if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h3 % 100 >= PLAIN:
        return n, "plain", None, None, raw
    a, b = (select(starts, k) if k < n else len(raw) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    before = (characters & ((1 << a) - 1)).bit_count()
    until = (characters & ((1 << b) - 1)).bit_count()
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < SPM:
        return n, "spm", before, until - before, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", before, until - before, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


_RESULTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output."""
    for_python(df.sparkSession)

    def make(texts: pa.Array, keys: pa.Array) -> list[pa.Array]:
        made = [transform(t.as_buffer().to_pybytes(), k) for t, k in zip(texts, keys.to_pylist(), strict=True)]
        *values, output = zip(*made, strict=True) if made else [()] * len(_RESULTS)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        # the cast doesn't look at the bytes, so they stay as they are
        return [*[pa.array(v, t) for v, t in zip(values, kinds, strict=True)], pc.cast(pa.array(output, pa.binary()), pa.string(), safe=False)]

    inputs = [F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))]
    return with_results(df, inputs, _RESULTS, make)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. The parts hold none of the three marks, and no mark begins as another
    ends, so the marks are found where they were put."""
    parts = F.split(F.substr(output, F.lit(4)), "<[PSM]>", 3)
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))
