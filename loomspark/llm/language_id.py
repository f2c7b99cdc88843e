"""Languages of web pages by Bayesian fusion of evidence.

1. Text: a naive Bayes model of byte trigrams, hashed to 2^16 classes and trained on TRAIN_ROWS labelled documents, gives
   each page's visible text a log-likelihood by language. Trigrams overlap and depend on each other, so it is
   divided by TEMPER.
2. The page declares a language in its markup, and its host has a suffix. How often each is seen with each language is
   counted over all other pages with text by the text's posterior (under the shares of languages that texts alone give), and drawn towards the value's share of all those pages, so that a value
   that no such page has tells nothing, and one that few have tells little, whatever the languages' own shares are.
3. Hosts have priors: the posteriors of a host's other pages, drawn towards its domain's, which are drawn towards all pages'. These
   are grouped sums, so a host with a third of all pages is partly summed everywhere first.
4. The evidence multiplies; the posterior's largest is the language.

Defined results: null and empty pages have no text or declared language, null urls no host or suffix: they are classes of
their own, and what other evidence there is decides, the prior of all pages at least; without training rows the
language is null; texts of any length are read whole; equal rows get equal results; keys may be null or repeated; an empty table
gives an empty one. Extra columns don't take part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_python, materialise, sampled
from .words import text_bytes

TRAIN_ROWS = 20_000
BITS = 16
TEMPER = 8.0
SMOOTH, DRAWN = 1.0, 10.0
NONE = 1e-6  # pages: less is what rounding leaves of none

_HIDDEN = re.compile(r"(?is)<(script|style|nav|footer|head|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"<[^>]*>")
#: What may quote markup of other pages; conditional comments may hold the page's own.
_ASIDE = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--(?!\[if).*?-->")
_DECLARED = re.compile(r"(?is)<html\b(?:(?!<html\b)[^>])*?\slang\s*=\s*[\"']?([a-z]{2,3})\b")


def visible(page: str) -> str:
    """A page's text without markup, scripts, navigation and footers."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def declared(page: str) -> str:
    """The language that the markup declares, or nothing."""
    found = _DECLARED.search(_ASIDE.sub(" ", page))
    return found[1].lower() if found else ""


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Classes of the trigrams that begin at each byte but the last two; ASCII letters count as lower case."""
    b = raw.astype(np.uint64)
    b += np.uint64(32) * ((b >= 65) & (b <= 90))
    mixed = (b[:-2] + (b[1:-1] << np.uint64(8)) + (b[2:] << np.uint64(16)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def train(df: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods as [class, language]."""
    for_python(df.sparkSession)
    known = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")
    # of equal texts one is enough: a text that many rows share stays one row of the sample
    sample = known.filter(sampled(F.col("text"), rows, known.count())).dropDuplicates(["lang", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for i, name in enumerate(batch.column("lang").to_pylist()):
                own = raw[at[i] : at[i + 1]]
                if len(own) > 2:
                    total[name] = total.get(name, 0) + np.bincount(trigrams(own), minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], ["lang", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, "<i8")
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([total.tobytes()], pa.binary())], ["lang", "counts"])

    schema = "lang string, counts binary"
    found = sample.mapInArrow(run, schema).groupBy("lang").applyInArrow(add, schema).orderBy("lang").collect()  # a row per language
    counts = np.stack([np.frombuffer(r["counts"], "<i8") for r in found], 1) if found else np.zeros((1 << BITS, 0))
    return [r["lang"] for r in found], np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (1 << BITS))).astype(np.float32)


def _softmax(x: Column) -> Column:
    """Of an array, with its largest taken off first."""
    top = F.array_max(x)
    return F.transform(x, lambda v: F.exp(v - top) / F.aggregate(x, F.lit(0.0), lambda a, y: a + F.exp(y - top)))


def evidence(pages: DataFrame, languages: list[str], likelihoods: np.ndarray, key: str, url: str, page: str) -> DataFrame:
    """(key, host, domain, suffix, declared, likelihood, posterior, has_text) for each page; likelihood is an array by language."""
    shared = pages.sparkSession.sparkContext.broadcast(likelihoods)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            pages = [x or "" for x in batch.column(2).to_pylist()]
            raw, at = text_bytes(pa.array([visible(x) for x in pages], pa.large_string()))
            out = np.zeros((len(pages), table.shape[1]))
            for i in range(len(pages)):
                own = raw[at[i] : at[i + 1]]
                if len(own) > 2:
                    out[i] = table[trigrams(own)].sum(0, dtype=np.float64) / TEMPER
            out -= out.max(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([declared(x) for x in pages], pa.string()), pa.array(list(out), pa.list_(pa.float64()))], [key, "url", "declared", "likelihood"])

    kind = pages.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    rows = pages.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("_page"))
    rows = rows.mapInArrow(run, f"`{key}` {kind}, url string, declared string, likelihood array<double>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = rows.withColumn("host", host).withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -3))
    return rows.withColumn("posterior", _softmax(F.col("likelihood"))).withColumn("has_text", F.exists("likelihood", lambda x: x < 0)).drop("url")


def _sums(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """Sums of the posteriors by language, as an array."""
    parts = [F.sum(F.get("posterior", F.lit(i))).alias(f"_{i}") for i in range(n)]
    return rows.groupBy(*by).agg(*parts).select(*by, F.array(*[f"_{i}" for i in range(n)]).alias(name))


def _total(sums: Column) -> Column:
    return F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)


def _towards(sums: Column, above: Column) -> Column:
    """Shares by language, drawn towards those of the group above."""
    total = _total(sums)
    return F.zip_with(sums, above, lambda s, p: (s + DRAWN * p) / (total + DRAWN))


def languages(pages: DataFrame, documents: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, confidence, text_lang, declared) for each page."""
    names, likelihoods = train(documents, text, lang)
    n = len(names)
    if not n:
        return pages.select(F.col(f"`{key}`").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"))])
    rows = materialise(evidence(pages, names, likelihoods, key, url, page), "evidence")

    def totals(df: DataFrame) -> list[float]:
        found = df.agg(*[F.sum(F.get("posterior", F.lit(i))).alias(f"_{i}") for i in range(n)]).first()
        return [float(found[f"_{i}"] or 0.0) for i in range(n)]

    # what pages teach is told by their texts and the shares of all languages: a text that tells nothing then teaches nothing
    shares = totals(rows.filter("has_text"))
    shares = F.array(*[F.lit(float(np.log((t + SMOOTH) / (sum(shares) + SMOOTH * n)))) for t in shares])
    rows = rows.withColumn("posterior", _softmax(F.zip_with("likelihood", shares, lambda a, b: a + b)))
    taught = rows.filter("has_text")  # pages without text teach nothing

    def seen(column: str) -> DataFrame:
        """How often each value is seen with each language: a row per value."""
        return _sums(taught, [column], n, f"_{column}")

    total = totals(taught)

    fused = rows.join(seen("declared"), "declared", "left").join(seen("suffix"), "suffix", "left").join(_sums(taught, ["host"], n, "_h"), "host", "left").join(_sums(taught, ["domain"], n, "_d"), "domain", "left")
    fused = fused.withColumn("_all", F.array(*[F.lit(t) for t in total]))
    # what a page itself has told is taken off what all pages, its host, domain, suffix and declaration have seen: its text counts once
    for sums in ("_all", "_declared", "_suffix", "_h", "_d"):
        own = F.zip_with(F.col(sums), F.col("posterior"), lambda a, p: F.greatest(a - p, F.lit(0.0)))
        fused = fused.withColumn(sums, F.when(F.col("has_text"), own).otherwise(F.col(sums)))
    nothing = F.array(*[F.lit(0.0)] * n)
    prior = F.transform("_all", lambda t: (t + SMOOTH) / (_total(F.col("_all")) + SMOOTH * n))
    from_domain = _towards(F.coalesce("_d", nothing), prior)
    host_prior = _towards(F.coalesce("_h", nothing), from_domain)

    def given(sums: str) -> Column:
        """ln P(value | language), or nothing where no other page with text has the value."""
        share = _total(F.col(sums)) / _total(F.col("_all"))
        return F.when(_total(F.col(sums)) > NONE, F.zip_with(F.col(sums), F.col("_all"), lambda s, t: F.log((s + DRAWN * share) / (t + DRAWN)))).otherwise(nothing)

    logs = F.zip_with(F.zip_with(F.col("likelihood"), F.transform(host_prior, lambda x: F.log(x)), lambda a, b: a + b), F.zip_with(given("_declared"), given("_suffix"), lambda a, b: a + b), lambda a, b: a + b)
    fused = fused.withColumn("_fused", _softmax(logs))
    names_column = F.array(*map(F.lit, names))

    def best(x: Column) -> Column:
        return F.element_at(names_column, F.array_position(x, F.array_max(x)).cast("int"))

    return fused.select(key, best(F.col("_fused")).alias("lang"), F.array_max("_fused").alias("confidence"), F.when(F.col("has_text"), best(F.col("likelihood"))).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"))
