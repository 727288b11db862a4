"""Quality rules as a short-circuit cascade of native column expressions.

Each rule is a boolean column that is true where a document fails. Rules are timed
and counted on a sample, then ordered by rejections per cost among the documents that
earlier rules leave, so that most bad documents leave after the cheapest test; a
document's verdict does not depend on the order. Everything here is DataFrame expressions; no Python runs on executors.

Null text has no words. Empty and null texts have all counts 0 and fail the base test.
A null doc_id is kept, repeated rows are judged one by one, an empty table gives an
empty result. Other columns are ignored by profile() and kept by cascade(), whose own
columns get names that do not clash.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import require, temp_name

SYMBOLS = r"[#*$%&|<>]"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column) -> Column:
    """Words covered by three-word windows at the ascending ``starts``."""
    steps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _starts_by_value(h: Column) -> Column:
    """Places of repeated values, found by sorting values with their places."""

    def repeated(a: Column) -> Column:
        same = F.filter(a, lambda x, i: F.get(a, i - 1)["h"].eqNullSafe(x["h"]) | F.get(a, i + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)


def _starts_by_few(h: Column, values: Column) -> Column:
    """Places of the few repeated ``values``."""
    marked = F.transform(h, lambda x, i: F.when(F.array_contains(values, x), i))
    return F.filter(marked, lambda x: x.isNotNull())


def _repeat_words(ws: Column) -> Column:
    """Words in three-word windows that occur twice or more; windows are compared by a 64-bit hash within one text.

    Texts without a repeated window, which are most, end at a count of distinct windows.
    """
    windows = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))), 1, F.greatest(F.size(ws) - 2, F.lit(0)))

    def few_or_many(h: Column) -> Column:
        values = let(F.sort_array(h), lambda a: F.array_distinct(F.filter(a, lambda x, i: F.get(a, i - 1).eqNullSafe(x))))
        return let(values, lambda v: F.when(F.size(v) <= 24, _starts_by_few(h, v)).otherwise(_starts_by_value(h)))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(few_or_many(h), _covered)))


def profile(docs: DataFrame) -> DataFrame:
    """Counts of every whole text: doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    require(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    ws = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    visible = text
    for space in " \t\n\x0b\x0c\r":
        visible = F.replace(visible, F.lit(space), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_HAS_WORD))
    counted = docs.select(
        "doc_id",
        "text",
        let(ws, lambda a: F.struct(F.size(a).cast("long").alias("n"), _repeat_words(a).cast("long").alias("r"))).alias("_w"),
        F.length(visible).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "text", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Rule:
    """``fails``: true where a text is rejected; it sees the text column and the word count."""

    name: str
    fails: Column


def default_rules(counted: bool = False) -> list[Rule]:
    """Rules on the text column alone; with ``counted`` they take what profile() has counted instead of counting again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda rx: F.regexp_count(text, F.lit(rx))
    total = F.col("n_words") if counted else count(r"[^\x20\x09-\x0D]+")
    chars = F.col("word_chars") if counted else F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    symbols = F.col("n_symbols") if counted else count(SYMBOLS)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return [
        Rule("word_length", (chars < 2 * total) | (chars > 12 * total)),
        Rule("symbols", 10 * symbols > total),
        Rule("capitals", 2 * count(r"\p{Lu}") > chars),
        Rule("exclamations", 10 * count(r"!!+") > total),
        Rule("letterless_words", 10 * count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])") > 2 * total),
        Rule("ellipsis_lines", 10 * count(r"(?m)(?:\.\.\.|\x{2026})[\x20\x09\x0D]*$") > 3 * lines),
        Rule("bullet_lines", 10 * count(r"(?m)^[\x20\x09]*[-*\x{2022}]\x20") > 9 * lines),
    ]


def greedy_order(patterns: dict[int, int], costs: Sequence[float]) -> list[int]:
    """Numbers of rules, best first: each time the one with the most rejections a cost among the rows that those before it leave.

    ``patterns``: how many rows fail exactly the rules whose bits are set. Rules that
    reject nothing more come last, the cheapest first.
    """
    left, rest, out = dict(patterns), list(range(len(costs))), []
    while rest:
        rejects = {i: sum(n for p, n in left.items() if p >> i & 1) for i in rest}
        best = max(rest, key=lambda i: (rejects[i] / costs[i], -costs[i], -i))
        out.append(best)
        rest.remove(best)
        left = {p: n for p, n in left.items() if not p >> best & 1}
    return out


def rule_costs(sample: DataFrame, rules: list[Rule], copies: int = 20, rounds: int = 2) -> list[float]:
    """Seconds of each rule on ``copies`` copies of the cached ``sample``, to the nearest power of two.

    A rule is run once before it is timed; the least of its ``rounds`` counts, less what
    the copies take without a rule.
    """
    many = sample.withColumn(temp_name(sample, "copy"), F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def seconds(fails: Column, times: int) -> float:
        taken = []
        for _ in range(times):
            began = time.perf_counter()
            many.select(F.count_if(fails).alias("n")).first()
            taken.append(time.perf_counter() - began)
        return min(taken[1:])

    empty = seconds(F.length("text") < 0, rounds + 1)
    return [2.0 ** round(math.log2(max(seconds(rule.fails, rounds + 1) - empty, 1e-3))) for rule in rules]


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 1000, prepare: Callable[[DataFrame], DataFrame] | None = None, costs: Sequence[float] | None = None) -> list[Rule]:
    """``rules`` by rejections a cost on at most ``sample_rows`` rows, each among those that earlier rules leave.

    The sample decides the order only, never a verdict. ``prepare`` adds to the sampled
    rows what rules need; ``costs`` are taken as they are instead of being measured.
    """
    sample = docs.sample(0.25, seed=7).limit(sample_rows)
    sample = (prepare(sample) if prepare else sample).cache()
    try:
        bits = sum((F.when(rule.fails, 1 << i).otherwise(0) for i, rule in enumerate(rules)), F.lit(0))
        patterns = {r["p"]: r["count"] for r in sample.select(bits.alias("p")).groupBy("p").count().collect()}  # at most a row a sampled row
        if not patterns:
            return list(rules)
        return [rules[i] for i in greedy_order(patterns, costs or rule_costs(sample, rules))]
    finally:
        sample.unpersist()


def first_failure(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a row, else null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.fails, F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, rules: list[Rule] | None = None, keep_only: bool = True) -> DataFrame:
    """Rows of ``docs`` that pass every rule, or all rows with the rejecting rule in ``rejected_by``."""
    ordered = order_rules(docs, rules or default_rules())
    if keep_only:
        return docs.where(first_failure(ordered).isNull())
    return docs.withColumn("rejected_by" if "rejected_by" not in docs.columns else temp_name(docs, "rejected_by"), first_failure(ordered))


def quality(docs: DataFrame) -> DataFrame:
    """Base counts, base verdict and the cascade's verdict of every document."""
    require(docs, "doc_id", "text")
    counts = profile(docs)
    rules = order_rules(docs.select("doc_id", "text"), default_rules(counted=True), prepare=profile)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(first_failure(rules).isNull())
    return counts.withColumn("kept", kept).drop("text")


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), d AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1
), v AS (
  SELECT rid, count(DISTINCT j) AS r FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY rid
), c AS (
  SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(t, '\p{Lu}')) AS capitals, len(regexp_extract_all(t, '!!+')) AS bangs, len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS letterless,
         len(string_split(t, chr(10))) AS lines, len(regexp_extract_all(t, '(?m)(?:\.\.\.|\x{2026})[\x20\x09\x0D]*$')) AS ellipses, len(regexp_extract_all(t, '(?m)^[\x20\x09]*[-*\x{2022}]\x20')) AS bullets
  FROM w LEFT JOIN v USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 2 * capitals > word_chars OR 10 * bangs > n_words
            OR 10 * letterless > 2 * n_words OR 10 * ellipses > 3 * lines OR 10 * bullets > 9 * lines) AS kept
FROM f
"""
