"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut.

Every document gets a random key from a hash of its id. Within each source, ranges of
the key get running sums of words, and the source is cut at its exact budget: whole
epochs first, then a prefix of the key's order, whose last document may be taken in part.
Documents in ranges before the cut are taken and those after it left; the one range
that holds the cut is sorted and summed document by document.

Null text has size 0. A null source is a source of its own, ordered last. A document
without an id gets its key from its text. Documents of equal key keep an order by id,
size and text. Sources without words have target 0. An empty
table gives an empty result. Extra columns pass through mix() and are ignored by plan().
The list of sources (not of documents) is held on the driver, some 100 bytes each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, n_words, require, words

#: Weights by rank of the source, repeating; share of all words the mix holds; epochs at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Up to so many sources, some 100 bytes each, their table is sent to all tasks; a longer one is joined by a shuffle.
SENT_SOURCES = 20_000


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """Words to take from each source: ``share`` of all words by weight, at most ``most`` times a source, the excess shared anew."""
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    caps = {s: most * sizes[s] for s in ranked}
    left, free, out = share * sum(sizes.values()), set(ranked), dict.fromkeys(ranked, 0.0)
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] > caps[s] * total]
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = float(caps[s])
            left -= caps[s]
            free.discard(s)
    return out


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """32 hexadecimal digits, the same in every run and engine; of the text where there is no id, so that such rows spread too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))


def _keyed(docs: DataFrame, columns: list[Column], seed: int) -> DataFrame:
    """``columns`` with _size, _key, _at (the key's first 32 bits) and _tie, which tells texts of one id apart."""
    key = random_key(F.col("doc_id"), F.col("text"), seed)
    at = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return docs.select(*columns, n_words(F.col("text")).alias("_size"), key.alias("_key"), at.alias("_at"), F.xxhash64("text").alias("_tie"))


def _range(at: Column, ranges: int) -> Column:
    return F.floor(at * F.lit(ranges) / F.lit(2**32))


def _cuts(narrow: DataFrame, weights: Sequence[int], share: float, most: int) -> tuple[DataFrame, int]:
    """By source its size, target, whole epochs, and where the rest of its budget ends: in which range of keys, and how far into it; and the number of ranges."""
    spark = narrow.sparkSession
    totals = {r["source"]: (int(r["n"]), int(r["s"] or 0)) for r in narrow.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s")).collect()}
    wanted = targets({k: s for k, (_, s) in totals.items()}, weights, share, most)
    budgets = {k: math.floor(wanted[k]) for k in totals}
    epochs = {k: budgets[k] // s if s else 0 for k, (_, s) in totals.items()}
    rests = [(k, budgets[k] - epochs[k] * s) for k, (_, s) in totals.items()]
    ranges = max(1, math.isqrt(sum(n for n, _ in totals.values())))
    sums = narrow.groupBy("source", _range(F.col("_at"), ranges).alias("_r")).agg(F.sum("_size").alias("_s"))
    earlier = Window.partitionBy("source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    summed = sums.withColumn("_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))  # at most ``ranges`` rows a source
    held = summed.join(spark.createDataFrame(rests, "_k string, _rest long"), F.col("source").eqNullSafe(F.col("_k")))
    cuts = {r["source"]: (r["_r"], r["_rest"] - r["_b"]) for r in held.where("_b < _rest AND _rest <= _b + _s").collect()}  # one a source
    table = [(k, s, float(wanted[k]), epochs[k], *cuts.get(k, (-1, 0))) for k, (_, s) in totals.items()]
    out = spark.createDataFrame(table, "_k string, _source_size long, _target double, _epochs long, _cut long, _inside long")
    return F.broadcast(out) if len(table) <= SENT_SOURCES else out, ranges


def _taken(rows: DataFrame, table: DataFrame, ranges: int) -> DataFrame:
    """``rows`` with _extra: the words taken beyond whole epochs. Only the one range of each source that holds its cut is put in order."""
    joined = rows.join(table, F.col("source").eqNullSafe(F.col("_k")), "left").drop("_k").withColumn("_r", _range(F.col("_at"), ranges))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("source").orderBy("_key", "doc_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = joined.where("_r = _cut").withColumn("_extra", F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_inside") - before)).cast("long"))
    others = joined.where("_r <> _cut").withColumn("_extra", F.when(F.col("_r") < F.col("_cut"), F.col("_size")).otherwise(0).cast("long"))
    return others.union(inside).drop("_key", "_at", "_tie", "_r", "_cut", "_inside")


def plan(docs: DataFrame, seed: int = 17, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    require(docs, "doc_id", "text", "source")
    narrow = materialize(_keyed(docs, [F.col("doc_id"), F.col("source")], seed), "sizes")
    taken = F.col("_epochs") * F.col("_size") + F.col("_extra")
    return _taken(narrow, *_cuts(narrow, weights, share, most)).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken")
    )


def mix(docs: DataFrame, seed: int = 17, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed corpus: each document once an epoch, the one at the cut up to its last word taken (its words joined by spaces).

    Texts are not shuffled, but for those of the range of keys that holds a source's cut.
    """
    require(docs, "doc_id", "text", "source")
    narrow = materialize(_keyed(docs, [F.col("source")], seed).select("source", "_at", "_size"), "sizes")
    cuts = _cuts(narrow, weights, share, most)
    discard(narrow)
    # the row travels as one column, so that none of its names can clash
    rows = _keyed(docs, [F.col("doc_id"), F.col("source"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row")], seed)
    assigned = _taken(rows, *cuts)
    text = F.col("_row.text")
    whole = (F.col("_epochs") + F.when((F.col("_extra") == F.col("_size")) & (F.col("_size") > 0), 1).otherwise(0)).cast("int")
    part = F.when((F.col("_extra") > 0) & (F.col("_extra") < F.col("_size")), F.array(F.array_join(F.slice(words(text), 1, F.col("_extra").cast("int")), " "))).otherwise(
        F.array().cast("array<string>")
    )
    copies = assigned.select("_row", F.explode(F.concat(F.array_repeat(text, whole), part)).alias("_copy"))
    length = F.when(F.col("_copy").isNotNull(), F.length("_copy"))
    columns = [F.col("_copy").alias(c) if c == "text" else length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return copies.select(*columns)


ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s GROUP BY source
), w AS (
  SELECT source, source_size, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM t
), l AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
           - coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w
), cut AS (
  SELECT rest, weights FROM l WHERE rest * weight <= 2.0::DOUBLE * source_size * weights ORDER BY 2.0::DOUBLE * source_size / weight, source LIMIT 1
), g AS (
  SELECT source, source_size,
         CASE WHEN rest * weight > 2.0::DOUBLE * source_size * weights THEN 2.0::DOUBLE * source_size ELSE rest * weight / weights END AS target
  FROM (SELECT w.*, cut.rest::DOUBLE AS rest, cut.weights::DOUBLE AS weights FROM w, cut)
), b AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM g
), o AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('17:' || s.doc_id), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM o
"""
