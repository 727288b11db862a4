"""Packing token pieces into sequences by shortest-pack-first over the histogram of lengths.

Each document's ids (with its end id) are cut at multiples of the sequence length.
The histogram of piece lengths has as many bins as a sequence has tokens, whatever the
corpus: the driver places lengths longest first, each onto the shortest pack, and
counts packing patterns. Pieces then find their pattern and place by their rank
among pieces of equal length, which is computed in buckets, never in one task.

Null text counts as empty: such a document is its end id alone. A null doc_id is kept.
Repeated rows are packed as often as they occur. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bucketed_positions, map_arrow, materialize, require
from .tokens import chunks, encoder, tokenizer_path

SEQUENCE = 1024


def pieces(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, parts: int | None = None) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, start, length, ids_crc32, doc_tokens; the ids themselves on demand.

    A worker remembers the ids of ``parts`` distinct parts of texts (by default the encoder's capacity): fewer take less memory and more time.
    """
    require(docs, "doc_id", "text")
    tokenizer = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, "<u4", end_id, parts).encode
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in chunks(list(zip(doc_ids, texts, strict=True)), [len(t or "") for t in texts]):
                rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
                ids = []
                for (doc_id, _), data in zip(some, encode([t for _, t in some]), strict=True):
                    total = len(data) // 4
                    for start in range(0, total, length):
                        piece = data[4 * start : 4 * (start + length)]
                        for k, v in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                            rows[k].append(v)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                columns = {k: pa.array(v, pa.int64()) for k, v in rows.items()}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return map_arrow(docs.select("doc_id", "text"), cut, schema, keeps="ids")


def pack_histogram(histogram: dict[int, int], most: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a pack, longest first) and how many packs have each.

    Longest lengths first; each goes onto the packs with the most room left, if it
    fits there, else it opens new packs. Packs of one pattern are placed together, so
    the work depends on the bins and patterns, not on the pieces.
    """
    if any(n < 1 or n > most for n in histogram):
        raise ValueError(f"lengths must be 1 to {most}")
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []
    done: dict[tuple[int, ...], int] = defaultdict(int)

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if not room:
            done[pattern] += count
            return
        if room not in open_packs:
            bisect.insort(rooms, room)
        open_packs[room][pattern] = open_packs[room].get(pattern, 0) + count

    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left > 0:
            if rooms and rooms[-1] >= n:
                room = rooms[-1]
                pattern, count = next(iter(open_packs[room].items()))
                del open_packs[room][pattern]
                if not open_packs[room]:
                    del open_packs[room]
                    rooms.pop()
                take = min(left, count)
                if count > take:
                    put(pattern, room, count - take)
                # several of this length onto each of these packs at once, if there are enough of them
                each = max(1, min(room // n, left // count)) if take == count else 1
                put((*pattern, *[n] * each), room - each * n, take)
                left -= take * each
            else:
                each = max(1, min(most // n, left))
                packs = left // each
                put((n,) * each, most - each * n, packs)
                left -= packs * each
    for room in list(open_packs):
        for pattern, count in open_packs[room].items():
            done[pattern] += count
    return sorted(done.items(), key=lambda x: (x[0], x[1]), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks by length: pieces of ``length`` ranked from ``rank`` on go to sequences from ``sequence`` on, at ``offset``."""
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, ranks[n], sequence, offset))
            ranks[n] += count
            offset += n
        sequence += count
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def pack(cut: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """``cut`` (from pieces()) with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``length`` rows
    table = places(pack_histogram(histogram, length))
    buckets = max(1, math.isqrt(sum(histogram.values())))
    spread = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets))
    order = [F.col(c) for c in ("doc_id", "start", "doc_tokens", "ids_crc32")]
    ranked = bucketed_positions(cut, ["length"], order, spread, F.lit(1), buckets, "_rank")
    shared = spark.sparkContext.broadcast(table)  # intervals of patterns: bounded by the bins of the histogram

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        first = {n: np.searchsorted(t["length"], n) for n in np.unique(t["length"]).tolist()}
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for size in np.unique(n).tolist():
                mine = n == size
                lo, hi = first[size], np.searchsorted(t["length"], size, "right")
                at[mine] = lo + np.searchsorted(t["rank"][lo:hi], rank[mine], "right") - 1
            columns = {name: batch.column(name) for name in batch.schema.names if name != "_rank"}
            columns["sequence_id"] = pa.array(t["sequence"][at] + rank - t["rank"][at])
            columns["offset"] = pa.array(t["offset"][at])
            yield pa.RecordBatch.from_pydict(columns)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in cut.schema]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, length: int = SEQUENCE, with_ids: bool = False, parts: int | None = None) -> DataFrame:
    """Encode, cut and pack ``docs``; each id lies in one piece, each piece in one sequence."""
    return pack(materialize(pieces(docs, length, with_ids=with_ids, parts=parts), "pieces"), length)
