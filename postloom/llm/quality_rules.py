"""Line-first cleaning by rules, in DataFrame functions alone.

Each line is judged by itself: navigation (many short parts between bars), boilerplate (licence, cookie, script and rights
notices), symbols, shouting, doubled punctuation, and short lines without an ending. Lines that fail go. A document goes if
the base rules fail it (few words, or repeated word windows) or if cleaning takes more than `most_lost` of its characters.

Defined results: a null or empty text has no words, so it fails the base rules and isn't kept; repeated rows and null ids
are judged one by one; other columns pass through the pipeline stage untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import SPACE_CLASS, table

MOST_LOST = 0.5
FEW_WORDS = 10
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_BOILERPLATE = (
    "licensed under|all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept cookies|enable javascript|javascript is (disabled|required)"
    "|lorem ipsum|click here|sign up|log in to|subscribe to our|skip to (main )?content|powered by|share this|read more$"
)
_ENDING = "[.!?:;\\x22\\x27)\\]\\x{2026}\\x{201D}\\x{3002}]\\s*$"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    n = F.length(line)
    navigation = line.rlike("[|\\x{00BB}\\x{2022}][^|\\x{00BB}\\x{2022}]{0,40}[|\\x{00BB}\\x{2022}]")
    boilerplate = line.rlike(f"(?i){_BOILERPLATE}")
    symbols = _symbols(line) * 20 > n
    doubled = (n - F.length(F.regexp_replace(line, "[!?]{2,}|\\.{4,}", ""))) * 20 > n
    shouting = (n > 40) & ((n - F.length(F.regexp_replace(line, "[A-Z]", ""))) * 2 > n)
    stump = (n < 40) & ~line.rlike(_ENDING)
    return navigation | boilerplate | symbols | doubled | shouting | stump


def judged(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """docs with __-columns of the base figures, the cleaned text and the verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__words", words(F.col("text")))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:]}")))
    out = out.withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get("__hash", i + k)
    grams = F.transform(F.sequence(F.lit(0), F.size("__hash") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    out = out.withColumn("__grams", F.when(F.size("__hash") >= WINDOW, grams))
    again = F.size(F.array_distinct("__grams")) < F.size("__grams")
    out = out.withColumn("__sorted", F.when(again, F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, i: x == F.get("__sorted", i)["g"]
    repeated = F.filter("__sorted", lambda x, i: F.coalesce(same(x["g"], i - 1), F.lit(False)) | F.coalesce(same(x["g"], i + 1), F.lit(False)))
    out = out.withColumn("__repeated", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        "__repeated",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    out = out.withColumns({
        "__n_words": F.size("__words").cast("long"),
        "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "__n_symbols": _symbols(text).cast("long"),
        "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "__kept_lines": F.filter("__lines", lambda x: ~line_fails(x)),
        "__line_chars": F.length(F.array_join("__lines", "")),
    })
    failed = (F.col("__n_words") < FEW_WORDS) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))
    lost = F.col("__line_chars") - F.length(F.array_join("__kept_lines", ""))
    return out.withColumns({"__base_failed": failed, "__kept": ~failed & (lost <= most_lost * F.col("__line_chars"))})


def clean(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """The documents that pass, with their cleaned text and n_chars, in the columns of docs."""
    # a generator drops the others: as a filter, the verdict would be pushed below the columns that it is made of, and repeated
    cleaned = F.explode(F.when(F.col("__kept"), F.array(F.array_join("__kept_lines", "\n")))).alias("__clean")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")  # the columns' names stay among themselves
    out = judged(rows, most_lost).select("__row", cleaned)
    made = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast("long")}
    return out.select(*[made.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[F.col(f"__{n}").alias(n) for n in names])


_WS = "\\x20\\x09-\\x0D"
_FAILS = f"""(regexp_matches(x, '[|\\x{{00BB}}\\x{{2022}}][^|\\x{{00BB}}\\x{{2022}}]{{0,40}}[|\\x{{00BB}}\\x{{2022}}]')
  OR regexp_matches(x, '(?i){_BOILERPLATE}')
  OR len(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 20 > len(x)
  OR (len(x) - len(regexp_replace(x, '[!?]{{2,}}|\\.{{4,}}', '', 'g'))) * 20 > len(x)
  OR (len(x) > 40 AND (len(x) - len(regexp_replace(x, '[A-Z]', '', 'g'))) * 2 > len(x))
  OR (len(x) < 40 AND NOT regexp_matches(x, '{_ENDING}')))"""
ORACLE_SQL = {
    "op6_quality_rules": f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[{_WS}]+'), lambda w: w <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS l, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM r) GROUP BY 1),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(array_to_string(l, '')) AS chars, len(array_to_string(list_filter(l, lambda x: NOT {_FAILS}), '')) AS left_chars
      FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND chars - left_chars <= {MOST_LOST} * chars AS kept FROM f"""
}
QUERIES = {"op6_quality_rules": op6_quality_rules}
