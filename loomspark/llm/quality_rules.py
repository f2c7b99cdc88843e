"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Counts come first (words, characters, symbols, lines, repeated 5-word windows, stop words), each in time
linear in the text but for the sort of windows, which only texts with a repeated window pay. Every rule is
``100 * count <= percent * base`` (or >=), so verdicts are exact integers.

Defined results: a null text counts as empty; an empty text fails the least number of words; texts of any
length are read whole; equal rows get equal verdicts; an empty table gives an empty one. Other columns, also
ones named like the counts, don't take part: only the columns asked for are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with a in is it for as was on are by this or from at which an not "
    "der die das und in zu den mit von für auf ist im dem nicht ein eine sich des auch es an werden aus er hat dass sie nach bei um am sind noch wie einem über so zum "
    "le la les de des du et en un une que qui pour dans par sur pas au avec est il ne se ce plus ou "
    "el la los las de del y en un una que por con para se su al como es lo no más"
).split()

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A text passes if ``100 * count <op> percent * base``, where it has at least ``least`` words."""

    name: str
    count: str
    op: str
    percent: int
    base: str
    least: int = 0


#: The threshold table. ``base`` "1" makes a rule absolute.
RULES = (
    Rule("min_words", "n_words", ">=", 1000, "1"),
    Rule("repeated_words", "n_repeat_words", "<=", 20, "n_words"),
    Rule("short_words", "word_chars", ">=", 200, "n_words"),
    Rule("long_words", "word_chars", "<=", 2000, "n_words"),
    Rule("symbols", "n_symbols", "<=", 10, "n_words"),
    Rule("shouting", "n_shouts", "<=", 20, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", "<=", 50, "n_lines"),
    Rule("stop_words", "n_stop_words", ">=", 200, "1", least=100),
)
BASE_RULES = ("min_words", "repeated_words")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, each word counted once."""
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(starts, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, repeated))

    return let(hashes, count)


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and the counts that rules refer to, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_intersect(words, F.array(*map(F.lit, sorted(set(STOP_WORDS)))))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]"), "")
    counts = df.select(
        *keep,
        let(words, of_words).alias("_w"),
        let(lines, of_lines).alias("_l"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
    )
    return counts.select(*keep, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "_w.n_stop_words", "n_shouts")


def passes(rule: Rule) -> Column:
    """A rule as a column over the counts."""
    base = F.lit(1) if rule.base == "1" else F.col(rule.base)
    left, right = F.col(rule.count) * 100, base * rule.percent
    return (left >= right if rule.op == ">=" else left <= right) | (F.col("n_words") < rule.least)


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed and kept."""
    base, every = F.lit(True), F.lit(True)
    for rule in rules:
        every &= passes(rule)
        if rule.name in BASE_RULES:
            base &= passes(rule)
    return measured.withColumns({"base_failed": ~base, "kept": every})


def quality_rules(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep, the counts, base_failed and kept for each row of df."""
    return judge(measure(df, text, keep), rules)


def filter_documents(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that pass all rules, with the columns of df only."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    packed = df.select(row, F.col(f"`{text}`").alias("_text"))
    return quality_rules(packed, "_text", ("_row",), rules).filter("kept").select("_row.*")
