"""Operator 5: quality rules. A table of thresholds becomes one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A measure and the bounds it must keep; None: no bound."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Common words of the languages that the corpus has. Fixed values.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "it", "on", "for", "de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "le", "et", "les", "des", "un", "une", "est", "der", "die", "und", "das", "zu", "den", "von", "mit")

#: The production table.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.3),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.005, None),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    Rule("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.9),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.5),
)

_SPACES = "[\\x20\\x09-\\x0D]"


def _measures(text: Column) -> dict[str, Column]:
    """Array columns first; later ones are built on their names in a second select."""
    words = F.filter(F.split(text, _SPACES + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {"words": words, "lines": lines}


def _three_word_keys() -> Column:
    """One long for each 3-word window: the high bits of its hash, then its place."""
    return F.expr(
        "CASE WHEN n_words >= 3 THEN transform(sequence(0, n_words - 3), i -> "
        "(xxhash64(words[i], words[i + 1], words[i + 2]) & ~place_mask) | CAST(i AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    )


def base_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and the measures that the rule table may name.

    n_repeat_words: windows are sorted by hash and place; neighbours with the
    same hash bits are compared word by word, so different windows never count
    as equal; the words under the repeated windows are counted by the gaps
    between their places. The place takes as many bits as the text needs, so
    at least 40 bits of the hash remain for a text of up to 16 million words.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(id_col, "text", *(c.alias(k) for k, c in _measures(F.col("text")).items()))
    rows = rows.withColumn("n_words", F.size("words")).withColumn("place_mask", F.expr("shiftleft(1L, CAST(ceil(log2(n_words + 2)) AS INT)) - 1"))
    rows = rows.withColumn("keys", F.sort_array(_three_word_keys()))
    same = "({a} & ~place_mask) = ({b} & ~place_mask) AND words[CAST({a} & place_mask AS INT)] = words[CAST({b} & place_mask AS INT)] AND words[CAST({a} & place_mask AS INT) + 1] = words[CAST({b} & place_mask AS INT) + 1] AND words[CAST({a} & place_mask AS INT) + 2] = words[CAST({b} & place_mask AS INT) + 2]"
    twice = f"filter(keys, (k, i) -> (i > 0 AND {same.format(a='k', b='keys[i - 1]')}) OR (i < size(keys) - 1 AND {same.format(a='k', b='keys[i + 1]')}))"
    rows = rows.withColumn("twice", F.expr(f"sort_array(transform({twice}, k -> k & place_mask))"))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rows.select(
        id_col,
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CAST(aggregate(zip_with(twice, slice(twice, 2, size(twice) + 1), (a, b) -> least(3L, coalesce(b - a, 3L))), 0L, (s, x) -> s + x) AS BIGINT)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr(f"CAST(size(filter(words, w -> lower(w) IN ({stop}))) AS BIGINT)").alias("n_stop_words"),
        F.expr("CAST(size(filter(lines, x -> x RLIKE '^[\\\\x20\\\\x09-\\\\x0D]*[-*\\u2022]')) AS BIGINT)").alias("n_bullet_lines"),
        F.expr("CAST(size(filter(lines, x -> x RLIKE '(\\\\.\\\\.\\\\.|\\u2026)[\\\\x20\\\\x09-\\\\x0D]*$')) AS BIGINT)").alias("n_ellipsis_lines"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where all rules hold. A measure over nothing (0 words or lines) breaks no rule."""
    held = F.lit(True)
    for rule in rules:
        over, _, under = rule.measure.partition(" / ")
        ratio = F.try_divide(F.col(over), F.col(under)) if under else F.col(over).cast("double")
        if rule.least is not None:
            held = held & F.coalesce(ratio >= F.lit(rule.least), F.lit(True))
        if rule.most is not None:
            held = held & F.coalesce(ratio <= F.lit(rule.most), F.lit(True))
    return held


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then the other measures.

    Defined results: a null or empty text has no words and fails the base
    (fewer than 50 words); repeated rows give repeated results; an empty table
    gives no rows. Only the two named columns are read. No shuffle; a whole
    text is judged within its row.
    """
    base = base_columns(df, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"),
        "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines",
    )
