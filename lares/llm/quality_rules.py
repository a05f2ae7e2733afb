"""Quality rules: a table of thresholds compiled into one projection of Spark's own functions.

Measures of a text (null: an empty one), words being runs of other than space, tab, line feed, vertical tab,
form feed and carriage return:
n_words, word_chars (code points in words), n_symbols (characters of # * $ % & | < >), n_dup_lines (lines cut at
line feeds that hold a word and equal an earlier line), n_repeat_words (words in a 3-word window that stands
twice or more in the text, its first place included), n_lines (lines with a word), n_bangs (exclamation marks),
n_stop (words that are stop words). Windows are compared by a 64-bit hash within one text.

A rule of RULES compares a ratio of two measures with a bound; a text passes when it breaks no rule. A rule whose
divisor is 0 is not broken. base_failed is the fixed part (too few words, or too many of them repeated); kept
needs it false, too. There is no shuffle; rows are judged one by one, so repeated rows and ties need no care, and other
columns pass through, but for those that bear a name in RESERVED.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\u000b\f\r"
_SYMBOLS = "#*$%&|<>"

#: Frequent words of the corpus' languages (fixed values).
STOP_WORDS = (
    "the of and to in that is was for on are with as it be by this from or an at a he "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine "
    "de la que el en y los se del las un por con una su para es al "
    "le et les des du une dans au pour est qui il sur ce pas avec"
).split()


class Rule(NamedTuple):
    """Broken when the measure, a share of the divisor if there is one, is below `least` or above `most`."""

    name: str
    measure: str
    divisor: str | None
    least: float | None = None
    most: float | None = None


MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.25),
    Rule("bangs_per_word", "n_bangs", "n_words", most=0.5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("stop_words", "n_stop", "n_words", least=0.02),
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_stop",
)
#: Columns of the input with these names, in any case, are replaced or left out.
RESERVED = {*MEASURES, "base_failed", "kept", "_words", "_lines", "_windows", "_placed", "_starts"}


def _occurrences(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("bigint")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures. Arrays that a function over elements reads are columns of a step of their own, or each
    element would compute them again."""
    rest = [c for c in docs.columns if c.lower() not in RESERVED]
    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    spaced = value
    for c in _SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(spaced, " "), "")
    lines = F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(_SPACES)) != "")
    cut = docs.select(
        *rest,
        words.alias("_words"),
        lines.alias("_lines"),
        _occurrences(value, _SYMBOLS).alias("n_symbols"),
        _occurrences(value, "!").alias("n_bangs"),
    )
    w, n = F.col("_words"), F.size("_words")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    )
    counted = cut.select(
        *rest,
        "n_symbols",
        "n_bangs",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("bigint").alias("n_stop"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # Windows with an equal one elsewhere stand beside it when sorted; texts without any skip the sort.
    g = F.col("_windows")
    found = [*rest, *(m for m in MEASURES if m != "n_repeat_words")]
    placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = counted.select(*found, F.when(F.size(F.array_distinct(g)) < F.size(g), placed).alias("_placed"))
    p = F.col("_placed")
    starts = F.transform(
        p,
        lambda x, j: F.when((x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]), x["i"]),
    )
    marked = sorted_.select(*found, F.sort_array(F.filter(starts, F.isnotnull)).alias("_starts"))
    # Each window adds its words up to the start of the next one.
    s = F.col("_starts")
    new_words = F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3))))
    total = F.aggregate(new_words, F.lit(0), lambda a, b: a + b)
    # The partition's number, never negative, keeps a filter on the result above these steps: pushed below them it
    # would be written out in terms of the text, arrays computed again for each element.
    total = F.when(F.spark_partition_id() >= 0, total)
    return marked.select(*found, F.coalesce(total, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where no rule is broken."""
    passed = F.lit(True)
    for rule in rules:
        value = F.col(rule.measure).cast("double")
        if rule.divisor is not None:
            value = F.when(F.col(rule.divisor) > 0, value / F.col(rule.divisor))
        if rule.least is not None:
            passed = passed & F.coalesce(value >= rule.least, F.lit(True))
        if rule.most is not None:
            passed = passed & F.coalesce(value <= rule.most, F.lit(True))
    return passed


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input's columns, the measures, base_failed and kept."""
    measured = with_measures(docs, text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))
