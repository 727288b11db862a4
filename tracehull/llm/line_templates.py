"""Line dedup by a log-template tree.

A line's leaf is its number of words and its leading words, with words that hold a digit
read as variable. Leaves with fewer than ``min_docs`` documents cannot hold a recurring
template, which leaves few lines. In a remaining leaf a word stays fixed at its place if
lines of at least ``min_docs`` documents have it there, and becomes variable otherwise;
that rule does not depend on the order of lines, so leaves of any size are split over
tasks by place and word. A template recurs if its lines stand in at least ``min_docs``
documents. Where that of a line does not, as the values of a field are each common, coarser
ones are tried: a word must also have half, then nine tenths, of the documents that the
middle word of its line has, which holds alike for leaves of any size and mixture. A line that repeats as it is (digits aside) always counts; a template with
variable words counts with at least ``min_fixed`` fixed words that make up ``fixed_percent`` of it.
A line of 50 words or more recurs from two documents on, if word for word the same (digits too).

Lines of recurring templates are dropped from every document but the first (least
doc_id), where the first such line stays, so that nothing is lost altogether; with
keep_first=False they are dropped everywhere.

Lines are split at line feeds; lines without a word are kept and never counted. Null text
has no lines and stays null. A null doc_id sorts before all others. Rows with equal
doc_id and text are one document. An empty table gives an empty result. Extra columns
are kept by drop_templates(), with n_chars brought up to date, and ignored by line_report().
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import discard, map_arrow, materialize, require, temp_name

MIN_DOCS, DEPTH, MIN_FIXED, FIXED_PERCENT = 5, 3, 6, 75
VARIABLE = b"<*>"
#: A word stays fixed from this percentage of the support of its line's middle word on; tried in this order.
SHARES = (0, 50, 90)
#: A line of so many words recurs, word for word, from so many documents on.
LONG_WORDS, LONG_DOCS = 50, 2
#: Slots of the filter on leaves: a fixed 2 ** SLOT_BITS bits, whatever the corpus.
SLOT_BITS = 24
_DIGITS = frozenset(b"0123456789")


def masked_words(line: bytes) -> list[bytes]:
    ws = line.split()
    return ws if _DIGITS.isdisjoint(line) else [w if _DIGITS.isdisjoint(w) else VARIABLE for w in ws]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(ws: list[bytes], depth: int) -> tuple[int, int]:
    """Leaf and masked line, as signed 64-bit hashes."""
    return _leaf(ws, depth), _signed(xxh64_intdigest(b" ".join(ws)))


def _leaf(ws: list[bytes], depth: int) -> int:
    return _signed(xxh64_intdigest(b"%d " % len(ws) + b" ".join(ws[:depth])))


def _exact(line: bytes, ws: list[bytes]) -> int | None:
    """Hash of the words of a long line, digits and all; such a line is a leaf of its own besides. None for a short one."""
    return _signed(xxh64_intdigest(b" ".join(line.split()), seed=1)) if len(ws) >= LONG_WORDS else None


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    column = batch.column(1)
    texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
        data = text.as_py()
        if data:
            yield doc_id, data


def _leaf_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(leaf, least, n): documents with a line in the leaf, and how many it takes (null: min_docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bool], int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            least = pa.array([LONG_DOCS if long else None for _, long in counts], pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array([leaf for leaf, _ in counts], pa.int64()), least, pa.array(counts.values(), pa.int64())], names=["leaf", "least", "n"])
            counts.clear()
            return out

        for batch in batches:
            for _, text in _documents(batch):
                leaves = set()
                for line in text.split(b"\n"):
                    if ws := masked_words(line):
                        leaves.add((_leaf(ws, depth), False))
                        if (exact := _exact(line, ws)) is not None:
                            leaves.add((exact, True))
                for leaf in leaves:
                    counts[leaf] += 1
            if len(counts) > 300_000:
                yield flush()
        yield flush()

    return map_arrow(docs.select("doc_id", "text"), run, "leaf long, least int, n long").groupBy("leaf", "least").agg(F.sum("n").alias("n"))


def _slots(leaves: DataFrame) -> np.ndarray:
    """Bit set of the leaves' slots; it only spares rows that the exact join would drop."""
    words = leaves.select(F.pmod(F.col("leaf"), F.lit(1 << SLOT_BITS)).alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 AS int)))").alias("b"))
    bits = np.zeros(1 << (SLOT_BITS - 5), np.uint32)
    for row in words.toLocalIterator():
        bits[row["w"]] = row["b"]
    return bits


def _occurrences(docs: DataFrame, bits: np.ndarray, depth: int) -> DataFrame:
    """Lines in the filter's leaves: doc_id, sign (of the text), place, leaf, key, and the masked line once a task (never for a long line's own leaf)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 2 ** SLOT_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, top = shared.value, set(), (1 << SLOT_BITS) - 1
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in _documents(batch):
                sign = _signed(xxh64_intdigest(text))
                for place, line in enumerate(text.split(b"\n")):
                    if not (ws := masked_words(line)):
                        continue
                    exact = _exact(line, ws)
                    if exact is not None and int(table[(exact & top) >> 5]) >> (exact & 31) & 1:
                        rows.append((doc_id, sign, place, exact, exact, None))
                    leaf, key = _keys(ws, depth)
                    slot = leaf & top
                    if int(table[slot >> 5]) >> (slot & 31) & 1:
                        shown = None if (leaf, key) in seen else [w.decode() for w in ws]
                        seen.add((leaf, key))
                        rows.append((doc_id, sign, place, leaf, key, shown))
                if len(seen) > 300_000:
                    seen.clear()
                if len(rows) > 20_000:
                    yield _lines(rows)
                    rows = []
            yield _lines(rows)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, sign long, place int, leaf long, key long, ws array<string>")


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "sign", "place", "leaf", "key", "ws"])


def _shapes(depth: int, min_fixed: int, fixed_percent: int):
    """Templates of a line, fine to coarse, from its words and the documents that have each fixed one at its place."""
    variable = VARIABLE.decode()

    def tried(ws: list[str], support: dict[int, int]) -> list[list[str]]:
        n_later = sum(w != variable for w in ws[depth:])
        ordered = sorted(support.values(), reverse=True)
        middle = ordered[(n_later - 1) // 2] if (n_later - 1) // 2 < len(ordered) else 0
        out: list[list[str]] = []
        for share in SHARES:
            t = [w if i < depth or 100 * support.get(i, -1) >= share * middle else variable for i, w in enumerate(ws)]
            if t not in out:
                out.append(t)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        for batch in batches:
            rows: list[tuple] = []
            for leaf, key, n, ws, fixed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for level, t in enumerate(tried(ws, {x["at"]: x["_n"] for x in fixed})):
                    kept = len(t) - t.count(variable)
                    if kept >= min_fixed and 100 * kept >= fixed_percent * len(t):
                        rows.append((leaf, key, n, level, " ".join(t)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["leaf", "key", "n", "level", "template"])

    return run


def find_templates(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, min_fixed: int = MIN_FIXED, fixed_percent: int = FIXED_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, sign, place, leaf, key) and, by (leaf, key), its recurring template and that template's documents."""
    leaves = materialize(_leaf_counts(docs, depth).where(F.col("n") >= F.coalesce("least", F.lit(min_docs))), "leaves")
    found = materialize(_occurrences(docs, _slots(leaves), depth), "occurrences")
    held = found.join(leaves.select(F.col("leaf").alias("_l")), F.col("leaf") == F.col("_l"), "left_semi")
    counted = held.groupBy("leaf", "key").agg(F.first("ws", ignorenulls=True).alias("ws"))
    sets = materialize(held.groupBy("leaf", "doc_id", "sign").agg(F.collect_set("key").alias("keys")), "keys")
    in_docs = sets.select("leaf", F.explode("keys").alias("key")).groupBy("leaf", "key").agg(F.count(F.lit(1)).alias("n"))
    several = sets.where(F.size("keys") > 1).select("leaf", "doc_id", "sign", F.explode("keys").alias("key"))

    def documents(rows: DataFrame, *by: str) -> DataFrame:
        """Distinct documents ``_n`` of ``rows`` (leaf, key, n) by leaf and ``by``: the sum of n, less what a document with several such lines adds too much."""
        twice = several.join(rows.drop("n"), ["leaf", "key"]).groupBy("leaf", *by, "doc_id", "sign").agg((1 - F.count(F.lit(1))).alias("n")).where("n < 0")
        return rows.select("leaf", *by, "n").union(twice.select("leaf", *by, "n")).groupBy("leaf", *by).agg(F.sum("n").alias("_n"))

    lines = materialize(counted.join(in_docs, ["leaf", "key"]), "lines")

    # lines that recur as they are need no template
    enough = F.when(F.col("ws").isNull(), LONG_DOCS).otherwise(min_docs)
    exact = lines.where(F.col("n") >= enough).select("leaf", "key", F.coalesce(F.array_join("ws", " "), F.lit("")).alias("template"))
    words = lines.where(F.size("ws") >= max(min_fixed, depth + 1)).select("leaf", "key", "n", F.posexplode("ws").alias("at", "w"))
    later = words.where((F.col("at") >= depth) & (F.col("w") != VARIABLE.decode()))
    fixed = documents(later, "at", "w").where(F.col("_n") >= min_docs).select(F.col("leaf").alias("_l"), F.col("at").alias("_a"), F.col("w").alias("_w"), "_n")
    same_word = (F.col("leaf") == F.col("_l")) & (F.col("at") == F.col("_a")) & (F.col("w") == F.col("_w"))
    marked = later.join(fixed, same_word).groupBy("leaf", "key").agg(F.collect_set(F.struct("at", "_n")).alias("fixed"))
    shaped = lines.where(F.size("ws") >= max(min_fixed, depth + 1)).join(marked, ["leaf", "key"])
    shapes = map_arrow(shaped.select("leaf", "key", "n", "ws", "fixed"), _shapes(depth, min_fixed, fixed_percent), "leaf long, key long, n long, level int, template string")
    shaped = materialize(shapes, "shaped")
    many = documents(shaped.drop("level"), "template").where(F.col("_n") >= min_docs).select(F.col("leaf").alias("_l"), F.col("template").alias("_t"))
    loose = shaped.join(many, (F.col("leaf") == F.col("_l")) & (F.col("template") == F.col("_t")), "left_semi").groupBy("leaf", "key").agg(F.min(F.struct("level", "template"))["template"].alias("template"))
    every = loose.unionByName(exact.join(loose.select(F.col("leaf").alias("_l"), F.col("key").alias("_k")), (F.col("leaf") == F.col("_l")) & (F.col("key") == F.col("_k")), "left_anti"))
    templates = materialize(every, "templates")
    discard(leaves, sets, lines, shaped)
    return found.drop("ws"), templates


def dropped_lines(docs: DataFrame, keep_first: bool = True, **bounds: int) -> DataFrame:
    """(doc_id, sign, places): places of the lines to drop from the document with that id and text hash."""
    found, recurring = find_templates(docs, **bounds)
    named = recurring.select(F.col("leaf").alias("_l"), F.col("key").alias("_k"), F.xxhash64("leaf", "template").alias("template"))
    hits = found.join(named, (F.col("leaf") == F.col("_l")) & (F.col("key") == F.col("_k"))).select("doc_id", "sign", "place", "template")
    if keep_first:
        first = hits.groupBy("template").agg(F.min(F.struct("doc_id", "sign", "place")).alias("f")).select(F.col("template").alias("_t"), "f")
        same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("sign") == F.col("f.sign")) & (F.col("place") == F.col("f.place"))
        hits = hits.join(first, F.col("template") == F.col("_t")).where(~same)
    return hits.groupBy("doc_id", "sign").agg(F.collect_set("place").alias("places"))


def _without(docs: DataFrame, keep_first: bool, bounds: dict) -> tuple[DataFrame, str]:
    """``docs`` and a new column of the places to drop (null where none is)."""
    require(docs, "doc_id", "text")
    places, sign, other, mark = (temp_name(docs, n) for n in ("places", "sign", "other", "mark"))
    drops = dropped_lines(docs.select("doc_id", "text"), keep_first, **bounds).select(F.col("doc_id").alias(other), F.col("sign").alias(mark), F.col("places").alias(places))

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = pa.array((_signed(xxh64_intdigest(t)) if (t := text.as_py()) else 0 for text in batch.column(at)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, signs], names=[*batch.schema.names, sign])

    signed = map_arrow(docs, run, StructType([*docs.schema.fields, StructField(sign, LongType())]))
    return signed.join(drops, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(sign) == F.col(mark)), "left").drop(other, mark, sign), places


def _kept_text(places: str):
    lines = F.split("text", "\n", -1)
    return F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(places), i)), "\n"))


def drop_templates(docs: DataFrame, keep_first: bool = True, **bounds: int) -> DataFrame:
    """``docs`` with lines of recurring templates dropped; documents left without a word, that had some, go."""
    marked, places = _without(docs, keep_first, bounds)
    text = temp_name(marked, "kept")
    out = marked.withColumn(text, _kept_text(places)).where(F.col(places).isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col(text).alias("text") if c == "text" else F.when(F.col(places).isNull(), F.col(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def line_report(docs: DataFrame, keep_first: bool = True, **bounds: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars and kept_crc32 (of the remaining text in UTF-8) of every document."""
    marked, places = _without(docs.select("doc_id", "text"), keep_first, bounds)
    text = F.coalesce(_kept_text(places), F.lit(""))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return marked.select("doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_dropped"), F.length(text).cast("long").alias("kept_chars"), F.crc32(text).alias("kept_crc32"))
