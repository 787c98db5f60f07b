"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``measure`` adds the integer counts of a text, ``RULES`` holds the thresholds as
data, and ``judge`` turns the table into one Boolean expression. All ratios are
compared as products of integers, so no engine rounds differently.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "a an and are as at be but by for from has have in is it not of on or that the this to was with "
    "auch auf als das dem den der des die ein eine für im in ist mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "al con de del el en es la las lo los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a text where ``times * numerator > limit * denominator``, or ``<`` with ``below``, from ``least`` words on."""

    name: str
    numerator: str
    denominator: str
    limit: int
    times: int = 100
    below: bool = False
    least: int = 50


#: The thresholds; limits are hundredths of the denominator unless ``times`` says otherwise.
RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", 30),
    Rule("word_too_long", "word_chars", "n_words", 25, times=1),
    Rule("word_too_short", "word_chars", "n_words", 2, times=1, below=True),
    Rule("stop_words", "n_stop_words", "n_words", 1, below=True),
    Rule("capital_words", "n_capital_words", "n_words", 60),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 90),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda variable stands for it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window of ``window`` words found twice or more, the first find included.

    Windows are sorted by (hash, place), so equal ones are neighbours: n log n for
    a text, not n squared. The starts of repeated windows, in order, cover
    ``min(window, gap)`` words each.
    """
    starts = F.sequence(F.lit(0), F.size(words) - window)
    pairs = F.transform(
        starts,
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(window)]).alias("h"), i.alias("i")),
    )

    def covered(found: Column) -> Column:
        h = lambda k: F.get(found, k)["h"]
        again = F.filter(found, lambda x, k: F.coalesce(h(k - 1) == x["h"], F.lit(False)) | F.coalesce(h(k + 1) == x["h"], F.lit(False)))
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(window), s - a["last"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(again, lambda x: x["i"])), zero, step, lambda a: a["n"])

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(F.sort_array(pairs), covered))


#: The counts that ``measure`` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_capital_words", "n_ellipsis_lines", "n_bullet_lines")


def _counts(text: Column) -> Column:
    """A struct of ``COUNTS``, all of type long; the text is split into words and lines once."""
    body = F.coalesce(text, F.lit(""))
    parts = F.struct(body.alias("body"), F.filter(F.split(body, _SPACES, -1), lambda w: w != "").alias("words"), F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))

    def count(p: Column) -> Column:
        body, words, lines = p["body"], p["words"], p["lines"]
        out = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
            "n_capital_words": F.regexp_count(body, F.lit(r"(^|[\x20\x09-\x0D])[A-Z][A-Z]")),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        }
        return F.struct(*[out[k].cast("long").alias(k) for k in COUNTS])

    return _let(parts, count)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use, all of type long; a null text counts as no words."""
    kept = [docs[c] for c in docs.columns if c not in COUNTS]
    told = docs.select(F.struct(*kept).alias("_row"), _counts(docs[text]).alias("_counts"))
    return told.select("_row.*", *[F.col("_counts")[k].alias(k) for k in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def failed(rule: Rule) -> Column:
    a, b = rule.times * F.col(rule.numerator), rule.limit * F.col(rule.denominator)
    return (F.col("n_words") >= rule.least) & ((a < b) if rule.below else (a > b))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed_rules`` (names, comma-joined) and ``kept``.

    Null and empty texts have no words: they fail the base rule. Columns of
    ``docs`` whose names clash with a count are replaced. Repeated rows are judged
    one by one; an empty table gives an empty table.
    """
    names = F.array_join(F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules])), ",")
    out = measure(docs, text).withColumns({"base_failed": base_failed(), "failed_rules": names})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    test = lambda r: f"n_words >= {r.least} AND {r.times} * {r.numerator} {'<' if r.below else '>'} {r.limit} * {r.denominator}"
    rules = ", ".join(f"CASE WHEN {test(r)} THEN '{r.name}' END" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
c AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(words, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z][A-Z]'))) AS BIGINT) AS n_capital_words,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines FROM w),
j AS (SELECT c.*, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM c LEFT JOIN rep USING (r)),
k AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules, NOT base_failed AND failed_rules = '' AS kept FROM k
"""


SQL = {"op5_quality_rules": _sql()}
