"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of characters other than space and U+0009-U+000D. Every measure is computed per row from the
word array, so nothing is shuffled and a row of any length is handled by the task that reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of four languages (fixed values).
STOP_WORDS = {
    "en": "the and of to a in is that it on for was be with as are by this an or from at not but they you".split(),
    "de": "der die und das ist in den von zu mit nicht ein eine für auf sich im dem des als auch es an".split(),
    "fr": "le la les de des et un une en est que qui dans pour pas sur au du avec par ne se ce il".split(),
    "es": "el la los las de que y en un una es por con para su se no al del lo como más pero".split(),
}


@dataclass(frozen=True)
class Rule:
    """One row of the threshold table: a measure must lie in [least, most]."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Base rules first; the others are the method's own.
BASE_RULES = (Rule("n_words", least=50), Rule("repeat_percent", most=50))
RULES = (
    Rule("mean_word_chars", least=2.5, most=12.0),
    Rule("symbols_per_word", most=0.1),
    Rule("stop_word_ratio", least=0.05),
    Rule("dup_line_ratio", most=0.5),
    Rule("blank_ratio", most=0.6),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def compile_rules(rules: Sequence[Rule], measures: Column) -> Column:
    """True where every rule holds for a struct of measures."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            verdict = verdict & (measures[rule.measure] >= rule.least)
        if rule.most is not None:
            verdict = verdict & (measures[rule.measure] <= rule.most)
    return verdict


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where the optimizer moves the expression into a filter."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sorted_windows(words: Column) -> Column:
    """All 3-word windows with their positions, sorted, so that equal ones become neighbours."""
    return F.when(
        F.size(words) < 3, F.expr("cast(array() as array<struct<g: string, i: int>>)")
    ).otherwise(
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.struct(
                    F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"),
                    i.cast("int").alias("i"),
                ),
            )
        )
    )


def _measures(text: Column) -> Column:
    """All measures of a text as one struct."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    parts = F.struct(
        F.filter(F.split(text, SPACES, -1), lambda w: w != "").alias("words"),
        lines.alias("lines"),
        F.length(text).cast("long").alias("n_chars"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )

    def repeated(windows: Column) -> Column:
        """Words in a window that occurs twice or more, its first occurrence included."""

        def same(x: Column, k: Column) -> Column:
            return F.coalesce(x["g"] == F.get(windows, k)["g"], F.lit(False))

        twice = F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
        covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(covered)).cast("long")

    def count(p: Column) -> Column:
        return F.struct(
            F.size(p["words"]).cast("long").alias("n_words"),
            p["n_chars"].alias("n_chars"),
            p["word_chars"].alias("word_chars"),
            p["n_symbols"].alias("n_symbols"),
            F.size(p["lines"]).cast("long").alias("n_lines"),
            (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(p["words"], lambda w: F.lower(w).isin(stop))).alias("n_stop"),
            _bind(_sorted_windows(p["words"]), repeated).alias("n_repeat_words"),
        )

    def relate(c: Column) -> Column:
        return F.struct(
            *[c[name].alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            _ratio(c["word_chars"], c["n_words"]).alias("mean_word_chars"),
            _ratio(c["n_symbols"], c["n_words"]).alias("symbols_per_word"),
            _ratio(c["n_stop"], c["n_words"]).alias("stop_word_ratio"),
            _ratio(c["n_dup_lines"], c["n_lines"]).alias("dup_line_ratio"),
            _ratio(c["n_chars"] - c["word_chars"], c["n_chars"]).alias("blank_ratio"),
            _ratio(100 * c["n_repeat_words"], c["n_words"]).alias("repeat_percent"),
        )

    return _bind(_bind(parts, count), relate)


def judge_quality(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    base_rules: Sequence[Rule] = BASE_RULES,
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """``keep`` columns, the measures of every row, ``base_failed`` and ``kept`` (base and method's rules hold).

    A null text has no words, as an empty one; its measures are 0. Repeated rows are judged each. Other columns of
    ``docs`` are not read, whatever their names.
    """

    def judge(m: Column) -> Column:
        failed = ~compile_rules(base_rules, m)
        return F.struct(m.alias("m"), failed.alias("base_failed"), (~failed & compile_rules(rules, m)).alias("kept"))

    whole = F.coalesce(F.col(text), F.lit(""))
    judged = docs.select(F.struct(*keep).alias("_row"), _bind(_measures(whole), judge).alias("_judged"))
    return judged.select("_row.*", "_judged.m.*", "_judged.base_failed", "_judged.kept")
