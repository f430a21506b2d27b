"""Quality rules: a threshold table compiled into one projection of built-in functions.

Defined results: null or blank text has no words and fails the base rules; repeated rows are judged alike; null
doc_id is kept as it is; a document has as many lines as newlines plus one, of which lines without a word don't count.
Windows of three words are told apart by their 64-bit hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was with as be by this are at an from or not have".split(),
    "fr": "le la les de des du et en un une que qui dans pour est au sur par pas ne".split(),
    "de": "der die und das den von zu mit sich auf ist des ein eine nicht im dem auch als für".split(),
    "es": "el la los las de que y en un una del se por con para su al lo como no".split(),
}
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: name, measure, least and greatest value allowed (None: no bound).
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "word_chars / n_words", 2.5, 12.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.1),
    ("stop_word_ratio", "n_stop_words / n_words", 0.06, None),
    ("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
]


def measures(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """The columns of `carry` and the counts that the rules use, in one pass without a shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = F.translate(text, "\t\n\x0b\f\r", "     ")
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    step = docs.select(*carry, F.array_remove(F.split(spaced, " "), "").alias("_words"), text.alias("_text"))
    words = F.col("_words")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    names = [c for c in step.columns if c not in ("_words", "_text")]
    step = step.select(
        *names, "_words", lines.alias("_lines"),
        F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).alias("_windows"),
        F.length(F.translate(F.col("_text"), " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate(F.col("_text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    sorted_windows = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select(
        *names, "_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sorted_windows).alias("_sorted"),
    )
    s = F.col("_sorted")
    again = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return step.select(
        *names, F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(F.when(s.isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
    )


def verdict(thresholds=None) -> tuple[Column, Column]:
    """base_failed and kept over the columns of measures()."""
    base = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    tests = []
    for _, measure, low, high in thresholds or THRESHOLDS:
        value = F.expr(f"CAST({measure.split(' / ')[0]} AS DOUBLE) / {measure.split(' / ')[1]}")
        tests += [value >= low] if low is not None else []
        tests += [value <= high] if high is not None else []
    return base, F.when(base, False).otherwise(reduce(lambda a, b: a & b, tests))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document."""
    base, kept = verdict()
    m = measures(docs, [F.col("doc_id").cast("long").alias("doc_id")])
    return m.withColumn("base_failed", base).withColumn("kept", kept)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    _, kept = verdict()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # the row number keeps the optimizer from copying all measures into a filter below them
    judged = measures(docs, [whole]).select("_row", kept.alias("_kept"), F.monotonically_increasing_id().alias("_n"))
    return judged.where(F.col("_kept") & (F.col("_n") >= 0)).select("_row.*")


def op4_quality_rules(spark, sf_dir):
    """Counts and verdict of the quality rules for every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    tests = []
    for _, measure, low, high in THRESHOLDS:
        value = f"(CAST({measure.split(' / ')[0]} AS DOUBLE) / {measure.split(' / ')[1]})"
        tests += [f"{value} >= CAST({low} AS DOUBLE)"] if low is not None else []
        tests += [f"{value} <= CAST({high} AS DOUBLE)"] if high is not None else []
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
d AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY k),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(list_filter(words, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words FROM w LEFT JOIN r ON w.k = r.k),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {" AND ".join(tests)} END AS kept, n_lines, n_stop_words FROM b"""


ORACLE_SQL = _oracle()
