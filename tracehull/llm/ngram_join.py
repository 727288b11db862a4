"""Exact Jaccard join of word n-gram sets: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Sets. A text's words (A-Z lower-cased) give its distinct n-word shingles as 64-bit
   hashes; equal sets are one class, and only classes go on. Each class has a bitmap whose
   bits are parities: a bit of two bitmaps that differs shows at least one shingle that
   differs, and what two sets share cancels out. Its width is a power of two by size band,
   in proportion to the set; bands that meet fold the wider map. A fixed-size sketch counts
   shingles over all texts.
2. Lists. Each set is ordered from rare to common by the sketch and sends its first
   n - ceil(t n) + COMMON shingles; two sets that link share at least COMMON of those.
   Sets stay in a shingle's list only next to a set within the size ratio, and go on only
   with COMMON lists. A list of a frequent shingle is dealt over many tasks.
3. Tiles. Lists are cut into blocks of bounded bytes; blocks whose sizes meet are a tile.
   Inside a tile the bitmaps bound each pair's overlap from above. A tile returns no pairs
   but a forest that joins sets which the bounds leave together: at most a row a set. A
   first pass over a few lists of each set finds groups; the second compares only blocks
   of different groups. Components of the forests are families.
4. Links. Each set goes once to the tile of its family, where sorted arrays are
   intersected for pairs that bitmaps leave and that no link joins yet; again a forest
   comes out. Families of many blocks compare each block and the family's hub first, then
   blocks of different components. No link between different components is lost.

Rows out of every step stay in proportion to the sets that go in. The sketch only sets an
order, and the first passes only save work: any counts and any cuts give the same result.

Null and empty texts, and texts without words, have an empty set and link with nothing;
texts of fewer words than a shingle have one shingle, their whole word sequence. Equal
texts link. A null doc_id is returned with a null component. Rows that share a doc_id
are one document: what links with one of its texts is in its component. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import discard, map_arrow, materialize, require
from .components import components

COMMON = 3
SKETCH_BITS, SLICE_BITS = 23, 14
#: Sketch counts from which a list is dealt over tasks, in parts of half as many sets.
LONG_LIST_BITS = 15
#: A block holds sets of so many shingles in all, a set counting SET_WEIGHT more.
BLOCK_WEIGHT, SET_WEIGHT = 1 << 21, 1 << 10
#: Lists of each set that the first pass reads.
FEW = 4
FILTER_BITS = 24
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of UTF-8 ``text``; bytes.split() and lower() know ASCII alone."""
    ws = text.lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, ws), np.uint64, len(ws))
    k = min(n, len(ws))
    out = _mix(h[: len(h) - k + 1] + np.uint64(k))
    for i in range(1, k):
        out = _mix(out * _M2 + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set ``s``, as two signed longs."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(s: np.ndarray, percent: int) -> bytes:
    """Parities of the shingles in each of 64 bits or more: four times the most shingles by which a linked set of this size can differ."""
    least = max(64, 8 * (100 - percent) * len(s) // (100 + percent))
    width = 1 << (least - 1).bit_length()
    at = ((s >> np.uint64(40)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _sets_and_sketch(n: int, percent: int):
    """For each document its size, class and bitmap; and at the end of a task its part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pending, seen, some = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0, False

        def add() -> None:
            low = (np.concatenate(pending) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32)
            at, times = np.unique(low, return_counts=True)
            counts[at] += times.astype(np.uint32)

        for batch in batches:
            sizes, high, low, maps = [], [], [], []
            for text in _texts(batch.column(1)):
                s = shingles(text, n)
                f1, f2 = _digest(s)
                sizes.append(len(s))
                high.append(f1)
                low.append(f2)
                maps.append(bitmap(s, percent))
                pending.append(s)
                seen += len(s)
                if seen > 1_000_000:
                    add()
                    pending, seen = [], 0
            some = some or bool(sizes)
            none = len(sizes)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(sizes, pa.int64()), "f1": pa.array(high, pa.int64()), "f2": pa.array(low, pa.int64()), "bits": pa.array(maps, pa.binary()), "slice": pa.nulls(none, pa.int32()), "counts": pa.nulls(none, pa.binary())})
        if some:
            if pending:
                add()
            parts = counts.reshape(-1, 1 << SLICE_BITS)
            blank = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": blank, "n": blank, "f1": blank, "f2": blank, "bits": pa.nulls(len(parts), pa.binary()), "slice": pa.array(range(len(parts)), pa.int32()), "counts": pa.array([pa.compress(p.tobytes(), "zstd", asbytes=True) for p in parts], pa.binary())})

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(pa.decompress(data, 4 << SLICE_BITS, "zstd", asbytes=True), np.uint32)
            sums[s] = sums[s] + part if s in sums else part.astype(np.uint64)
    for s, total in sums.items():
        # eight steps an octave are enough for an order from rare to common
        rank = np.minimum(np.ceil(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "rank": pa.array([pa.compress(rank.tobytes(), "zstd", asbytes=True)], pa.binary())})


def _sketch(parts: DataFrame) -> np.ndarray:
    """Rank of commonness by the low bits of a shingle: a fixed 2 ** SKETCH_BITS bytes, whatever the corpus, so one job fetches it."""
    summed = parts.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(_sum_slices, "slice int, rank binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in summed.collect():
        at = row["slice"] << SLICE_BITS
        out[at : at + (1 << SLICE_BITS)] = np.frombuffer(pa.decompress(row["rank"], 1 << SLICE_BITS, "zstd", asbytes=True), np.uint8)
    return out


def _entries(docs: DataFrame, ranks: np.ndarray, n: int, percent: int) -> DataFrame:
    """(token, part, id, n): the lists that each class joins; part is 0 but in long lists."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in batches:
            tokens, parts, ids, sizes = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                s = shingles(text, n)
                # with so few shingles only equal sets reach the threshold, and those are one class already
                if doc_id is None or len(s) < COMMON or 100 * (len(s) - 1) < percent * len(s) and 100 * len(s) < percent * (len(s) + 1):
                    continue
                name = _digest(s)[0]
                if name in seen:
                    continue
                seen.add(name)
                take = len(s) - -(-percent * len(s) // 100) + COMMON
                rank = table[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                order = np.argsort(rank, kind="stable")[:take]
                split = np.maximum(rank[order].astype(np.int64) // 8 - LONG_LIST_BITS + 1, 0)  # 2 ** split parts
                tokens.append(s[order])
                parts.append(np.where(split > 0, 1 + (name & ((1 << split) - 1)), 0))
                ids.append(name)
                sizes.append((len(s), len(order)))
            if ids:
                times = [k for _, k in sizes]
                yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(tokens).astype(np.int64)), "part": pa.array(np.concatenate(parts).astype(np.int32)), "id": pa.array(np.repeat(np.array(ids, np.int64), times)), "n": pa.array(np.repeat(np.array([k for k, _ in sizes], np.int32), times))})

    return map_arrow(docs.select("doc_id", "text"), run, "token long, part int, id long, n int")


def _listed(percent: int):
    """Of rows sorted by token, part, n and id: one for each set, if it stands next to one within the size ratio (any, in long lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose follower is not known yet, and whether it stays anyway
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, stays = [batch.column(k).to_numpy() for k in ("token", "part", "id", "n")], np.zeros(batch.num_rows, bool)
            if held:
                rows, stays = [np.concatenate([h, r]) for h, r in zip(held[0], rows, strict=True)], np.concatenate([held[1], stays])
            again = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1]) & (rows[2][1:] == rows[2][:-1])
            once = np.r_[True, ~again]
            rows, stays = [r[once] for r in rows], stays[once]
            n = rows[3].astype(np.int64)
            near = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1]) & (100 * n[:-1] >= percent * n[1:])
            stays |= np.r_[False, near] | np.r_[near, False] | (rows[1] > 0)
            held = [r[-1:] for r in rows], stays[-1:]
            keep = stays[:-1]
            if keep.any():
                yield pa.RecordBatch.from_pydict({"token": pa.array(rows[0][:-1][keep]), "id": pa.array(rows[2][:-1][keep])})
        if held and held[1][0]:
            yield pa.RecordBatch.from_pydict({"token": pa.array(held[0][0]), "id": pa.array(held[0][2])})

    return run


def _words_of(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of ``width`` bytes; one of twice the width is folded, for a parity of two bits is their sum's."""
    out = np.empty((len(maps), width // 8), np.uint64)
    for i, data in enumerate(maps):
        words = np.frombuffer(data, np.uint64)
        out[i] = words if len(data) == width else words[: width // 8] ^ words[width // 8 :]
    return out


def _near(n: np.ndarray, maps: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(x, sets y > x that the bitmaps leave with x) for sets in order of size."""
    widths = np.array([len(d) for d in maps])
    start = 0
    while start < len(n):
        stop = int(np.searchsorted(widths, widths[start], "right"))
        reach = int(np.searchsorted(n, 100 * n[stop - 1] // percent, "right"))
        rows = _words_of(maps[start:reach], int(widths[start]))
        step = max(1, 2_000_000 // rows.size)
        for lo in range(start, stop, step):
            hi = min(stop, lo + step)
            end = int(np.searchsorted(n, 100 * n[hi - 1] // percent, "right"))
            differ = np.bitwise_count(rows[lo - start : hi - start, None, :] ^ rows[None, lo - start : end - start, :]).sum(2, dtype=np.int64)
            a, b = n[lo:hi, None], n[None, lo:end]
            # overlap <= (a + b - differ) / 2, and the threshold needs 100 overlap >= percent (a + b - overlap)
            fits = (100 * a >= percent * b) & ((100 + percent) * differ <= (100 - percent) * (a + b))
            for x in range(lo, hi):
                ys = np.flatnonzero(fits[x - lo, x - lo + 1 :]) + x + 1
                if len(ys):
                    yield x, ys
        start = stop


def _overlaps(sets: list[np.ndarray], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """A judge of (x, ys): whether the sorted array of x and that of each y reach the threshold, by exact intersection."""
    n = np.array([len(s) for s in sets])
    at = np.r_[0, np.cumsum(n)]
    ranks = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    marks = np.zeros(int(ranks.max()) + 1, np.int8)

    def judge(x: int, ys: np.ndarray) -> np.ndarray:
        marks[ranks[at[x] : at[x + 1]]] = 1
        both, lo = np.empty(len(ys), np.int64), 0
        ends = np.cumsum(n[ys])
        while lo < len(ys):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000, "right")))
            some = ys[lo:hi]
            starts = np.r_[0, np.cumsum(n[some])[:-1]]
            where = np.repeat(at[some] - starts, n[some]) + np.arange(int(n[some].sum()))
            both[lo:hi] = np.add.reduceat(marks[ranks[where]], starts, dtype=np.int64)
            lo = hi
        marks[ranks[at[x] : at[x + 1]]] = 0
        return 100 * both >= percent * (n[x] + n[ys] - both)

    return judge


def _forest(n: np.ndarray, maps: list[bytes], percent: int, groups: np.ndarray | None = None, sides: np.ndarray | None = None, judge=None) -> list[tuple[int, int]]:
    """Pairs of places that join all sets which bitmaps (and ``judge``) link; none inside one of ``groups``, or of one side."""
    label = np.arange(len(n)) if groups is None else np.unique(groups, return_inverse=True)[1]
    out, left = [], len(n) if groups is None else int(label.max()) + 1
    for x, ys in _near(n, maps, percent):
        ys = ys[label[ys] != label[x]]
        if sides is not None:
            ys = ys[sides[ys] != sides[x]]
        if judge is not None and len(ys):
            ys = ys[judge(x, ys)]
        if not len(ys):
            continue
        others, first = np.unique(label[ys], return_index=True)
        out += [(x, int(y)) for y in ys[first]]
        label[np.isin(label, others)] = label[x]
        left -= len(others)
        if left == 1:
            break  # all are joined
    return out


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    changed = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        changed |= k[1:] != k[:-1]
    return np.r_[0, np.flatnonzero(changed) + 1, len(keys[0])]


def _two_each(n: np.ndarray, maps: list[bytes], at: np.ndarray, percent: int) -> np.ndarray:
    """Of the places ``at``, those whose set may link with the next one: many tiles of two sets at once."""
    at = at[100 * n[at] >= percent * n[at + 1]]
    widths, fits = np.array([len(maps[p]) for p in at], np.int64), np.zeros(len(at), bool)
    for width in np.unique(widths):
        some = np.flatnonzero(widths == width)
        differ = np.bitwise_count(_words_of([maps[p] for p in at[some]], int(width)) ^ _words_of([maps[p + 1] for p in at[some]], int(width))).sum(1, dtype=np.int64)
        fits[some] = (100 + percent) * differ <= (100 - percent) * (n[at[some]] + n[at[some] + 1])
    return at[fits]


def _pairs(reps: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not found:
        return None
    pairs = np.sort(reps[np.array(found)], axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pa.RecordBatch.from_pydict({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def _in_lists(percent: int):
    """Forests of the lists, or parts of them, in rows sorted by key, n and id: (key, id, rep, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, weight = None, 0

        def finish() -> pa.RecordBatch | None:
            n, reps, maps = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [d for h in held for d in h[2]]
            held.clear()
            return _pairs(reps, _forest(n, maps, percent)) if len(n) > 1 else None

        for batch in batches:
            if not batch.num_rows:
                continue
            key, reps, n, maps = batch.column("key").to_numpy(), batch.column("rep").to_numpy(), batch.column("n").to_numpy().astype(np.int64), batch.column("bits").to_pylist()
            cuts = _runs([key])
            inner = cuts[1:-2][np.diff(cuts[1:-1]) == 2] if len(cuts) > 3 else cuts[:0]
            found = [_pairs(reps, [(p, p + 1) for p in _two_each(n, maps, inner, percent)])]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo <= 2 and lo and hi < batch.num_rows:
                    continue  # alone, or done above
                if held and (key[lo] != last or weight > BLOCK_WEIGHT):
                    found.append(finish())
                if not held:
                    weight = 0
                held.append((n[lo:hi], reps[lo:hi], maps[lo:hi]))
                last, weight = key[lo], weight + int((n[lo:hi] + SET_WEIGHT).sum())
            yield from (f for f in found if f is not None)
        if held and (f := finish()) is not None:
            yield f

    return run


def _blocks(drop_pure: bool):
    """Rows sorted by key, group, n and id get the block they are in; lists of one group may go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32  # blocks of one list in different tasks
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, group = batch.column("key").to_numpy(), batch.column("g").to_numpy()
            cuts = _runs([key])
            times = np.diff(cuts)
            weight = np.cumsum(batch.column("n").to_numpy().astype(np.int64) + SET_WEIGHT)
            before = np.r_[0, weight[:-1]]
            base = np.repeat(before[cuts[:-1]], times)
            base[: cuts[1]] -= carried if key[0] == last else 0
            block = (before - base) // BLOCK_WEIGHT
            last, carried = key[-1], int(weight[-1] - base[-1])
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(task + block)], names=[*batch.schema.names, "block"])
            if drop_pure:
                keep = group[cuts[:-1]] != group[cuts[1:] - 1]
                keep[[0, -1]] = True  # these lists may go on in other batches
                out = out.filter(pa.array(np.repeat(keep, times)))
            yield out

    return run


def _tasks(df: DataFrame) -> int:
    """How many tasks share Python work on narrow rows: too few bytes for Spark to see how much work they are."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _placed(rows: DataFrame, kind: str, drop_pure: bool) -> DataFrame:
    """(key, g, n, id, rep, block): ``rows`` dealt by ranges, so that no list is bound to one task."""
    ordered = rows.select("key", "g", "n", "id", "rep").repartitionByRange(_tasks(rows), "key", "g", "n", "id").sortWithinPartitions("key", "g", "n", "id")
    return materialize(map_arrow(ordered, _blocks(drop_pure), "key long, g long, n int, id long, rep long, block long"), kind)


def _tiles(placed: DataFrame, percent: int) -> DataFrame:
    """(_key, _block, i, j): the tiles in which a block meets itself or another with sizes within the ratio, and groups differ."""
    blocks = placed.groupBy("key", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in blocks.columns]) for side in "ab")
    meet = (F.col("key_a") == F.col("key_b")) & (F.col("block_a") <= F.col("block_b"))
    meet &= (100 * F.col("hi_a") >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * F.col("lo_a"))
    mixed = F.least("g0_a", "g0_b") != F.greatest("g1_a", "g1_b")
    pairs = a.join(b, meet).where(mixed).select(F.col("key_a").alias("_key"), F.col("block_a").alias("i"), F.col("block_b").alias("j"))
    return pairs.select("_key", F.explode(F.array_distinct(F.array("i", "j"))).alias("_block"), "i", "j")


def _in_tiles(percent: int):
    """Forests of tiles in rows sorted by key, i and j: (key, i, j, block, g, rep, n, bits); a tile is at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _each(batches, ("key", "i", "j")):
            n, reps, group, block = (rows.column(k).to_numpy().astype(np.int64) for k in ("n", "rep", "g", "block"))
            maps, order = rows.column("bits").to_pylist(), np.argsort(n, kind="stable")
            found = _forest(n[order], [maps[k] for k in order], percent, group[order], block[order] if i != j else None)
            if (f := _pairs(reps[order], found)) is not None:
                yield f

    return run


def _each(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of rows with equal values of ``names``, in sorted batches, one run at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in names]
        cuts = _runs(keys)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(k[lo]) for k in keys)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _in_families(n: int, percent: int):
    """Forests of exact links in rows sorted by key, i and j: (key, i, j, block, g, id, rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _each(batches, ("key", "i", "j")):
            sets, reps, group, block, seen = [], [], [], [], set()
            columns = (rows.column(k).to_pylist() for k in ("id", "rep", "g", "block"))
            for name, rep, g, b, text in zip(*columns, (t for c in rows.column("text").chunks for t in _texts(c)), strict=True):
                if (name, rep) in seen:
                    continue
                s = shingles(text, n)
                if _digest(s)[0] == name:  # else another text of the same doc_id
                    seen.add((name, rep))
                    sets.append(s)
                    reps.append(rep)
                    group.append(g)
                    block.append(b)
            if len(sets) < 2:
                continue
            size = np.array([len(s) for s in sets], np.int64)
            order = np.argsort(size, kind="stable")
            sets = [sets[k] for k in order]
            maps = [bitmap(s, percent) for s in sets]
            found = _forest(size[order], maps, percent, np.array(group)[order], np.array(block)[order] if i != j else None, _overlaps(sets, percent))
            if (f := _pairs(np.array(reps)[order], found)) is not None:
                yield f

    return run


def _may_be_member(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` without most of those whose doc_id is not a rep of ``members``: by a filter of 2 ** FILTER_BITS bits, whatever the corpus."""
    spot = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    slices = members.select(spot(F.col("rep")).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    table = {int(r["b"]): r["bits"] for r in slices.collect()}  # 4 KB for each of at most 513 buckets
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {b: np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little") for b, bits in shared.value.items()}
        for batch in batches:
            buckets, spots = batch.column("b").to_pylist(), batch.column("p").to_pylist()
            keep = [b in known and bool(known[b][p]) for b, p in zip(buckets, spots, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns[:2], names=["doc_id", "text"])

    h = spot(F.col("doc_id"))
    marked = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.bitmap_bucket_number(h).alias("b"), F.bitmap_bit_position(h).alias("p"))
    return map_arrow(marked, run, "doc_id long, text string")


def _exact(docs: DataFrame, tiles: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) of ``tiles`` (key, i, j, block, g, id, rep), each document's text fetched once for a tile it is in."""
    fetched = tiles.join(docs.withColumnRenamed("doc_id", "_doc"), F.col("rep") == F.col("_doc")).drop("_doc")
    dealt = fetched.repartition(_tasks(fetched), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_arrow(dealt.select("key", "i", "j", "block", "g", "id", "rep", "text"), _in_families(n, percent), "u long, v long")


def _links(docs: DataFrame, members: DataFrame, families: DataFrame, near: DataFrame, n: int, percent: int) -> DataFrame:
    """All the links that components need, of the sets in each family."""
    rows = members.select("id", "rep", "n").join(families.select(F.col("node").alias("_n"), F.col("component").alias("key")), F.col("rep") == F.col("_n")).drop("_n")
    placed = _placed(rows.withColumn("g", F.lit(0).cast("long")), "families", False)
    # in a tile of its own a block has no groups yet: each class is one
    inside = placed.select("key", F.col("block").alias("i"), F.col("block").alias("j"), "block", F.col("id").alias("g"), "id", "rep")
    long = placed.groupBy("key").agg(F.min("block").alias("b0"), F.max("block").alias("b1")).where("b0 <> b1").select(F.col("key").alias("_k"))
    texts = _may_be_member(docs, placed)
    if long.isEmpty():
        out = materialize(_exact(texts, inside, n, percent), "links")
        discard(placed)
        return out
    degree = near.select(F.col("u").alias("_r")).unionAll(near.select(F.col("v").alias("_r"))).groupBy("_r").agg(F.count(F.lit(1)).alias("_d"))
    ranked = placed.join(long, F.col("key") == F.col("_k"), "left_semi").join(degree, F.col("rep") == F.col("_r"))
    hubs = ranked.groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("_d", "id", "rep")).alias("_h"))
    of_long = placed.select("key", "block").distinct().join(hubs, F.col("key") == F.col("_k"))
    with_hub = inside.unionByName(of_long.select("key", F.col("block").alias("i"), F.col("block").alias("j"), "block", F.col("_h.id").alias("g"), F.col("_h.id").alias("id"), F.col("_h.rep").alias("rep")))
    first = materialize(_exact(texts, with_hub, n, percent), "links")
    groups = components(first)
    grouped = rows.join(long, F.col("key") == F.col("_k"), "left_semi").join(groups.select(F.col("node").alias("_n"), "component"), F.col("rep") == F.col("_n"), "left").withColumn("g", F.coalesce("component", "rep"))
    again = _placed(grouped, "families", True)
    across = again.join(_tiles(again, percent), (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block")))
    out = materialize(_exact(texts, across.select("key", "i", "j", "block", "g", "id", "rep"), n, percent).union(first), "links")
    discard(placed, first, groups, again)
    return out


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links of ``percent`` similarity or more reach."""
    if not 67 <= percent <= 100:
        raise ValueError("the threshold must be 67 to 100 percent")  # below, sets of fewer than COMMON shingles could link
    require(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialize(map_arrow(docs, _sets_and_sketch(n, percent), "doc_id long, n long, f1 long, f2 long, bits binary, slice int, counts binary"), "sets")
    named = described.where("slice IS NULL AND n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("bits").alias("bits"))

    entries = _entries(docs, _sketch(described), n, percent).repartition("token", "part").sortWithinPartitions("token", "part", "n", "id")
    listed = map_arrow(entries, _listed(percent), "token long, id long").groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where(F.size("tokens") >= COMMON)
    members = materialize(listed.join(classes, F.col("id") == F.col("f1")).select("id", "rep", "n", "tokens", "bits"), "members")

    few = members.select(F.explode(F.slice("tokens", 1, FEW)).alias("key"), "n", "id", "rep", "bits")
    sorted_few = few.repartitionByRange(_tasks(few), "key", "n", "id").sortWithinPartitions("key", "n", "id")
    near = materialize(map_arrow(sorted_few, _in_lists(percent), "u long, v long").distinct(), "near")
    groups = components(near)

    grouped = members.join(groups.select(F.col("node").alias("_n"), "component"), F.col("rep") == F.col("_n"), "left")
    placed = _placed(grouped.select(F.explode("tokens").alias("key"), F.coalesce("component", "rep").alias("g"), "n", "id", "rep"), "lists", True)
    in_tiles = placed.join(_tiles(placed, percent), (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block")))
    mapped = in_tiles.drop("_key", "_block").join(members.select(F.col("id").alias("_i"), F.col("rep").alias("_r"), "bits"), (F.col("id") == F.col("_i")) & (F.col("rep") == F.col("_r")))
    dealt = mapped.repartition(_tasks(mapped), "key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "block", "g", "rep", "n", "bits")
    wider = materialize(map_arrow(dealt, _in_tiles(percent), "u long, v long").distinct().union(near), "near")
    families = components(wider)
    discard(near, groups, placed)

    links = _links(docs, members, families, wider, n, percent)
    discard(members, wider, families)

    ids = named.groupBy("doc_id").agg(F.min("f1").alias("_a"), F.max("f1").alias("_b")).where("_a <> _b").select(F.col("doc_id").alias("_d"))
    several = named.join(ids, F.col("doc_id") == F.col("_d"), "left_semi").join(classes.select(F.col("f1").alias("_1"), F.col("f2").alias("_2"), "rep"), (F.col("f1") == F.col("_1")) & (F.col("f2") == F.col("_2")))
    one_document = several.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    final = components(links.union(one_document))
    discard(links)

    labels = classes.join(final, F.col("rep") == F.col("node"), "left").select(F.col("f1").alias("_1"), F.col("f2").alias("_2"), F.coalesce("component", "rep").alias("label"))
    rows = described.where("slice IS NULL").select("doc_id", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2", "n")
    out = rows.join(labels, (F.col("f1") == F.col("_1")) & (F.col("f2") == F.col("_2")), "left")
    # a document of several texts has the component of all of them
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id; of rows that share a doc_id the least text stays."""
    from .common import temp_name

    kept = near_duplicates(docs, n, percent).where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("_kept")).distinct()
    rank, key = temp_name(docs, "rank"), temp_name(docs, "kept")
    chosen = docs.join(kept.withColumnRenamed("_kept", key), F.col("doc_id") == F.col(key), "left_semi")
    by = Window.partitionBy("doc_id").orderBy(F.md5(F.coalesce("text", F.lit(""))))
    one = chosen.withColumn(rank, F.row_number().over(by)).where(F.col(rank) == 1).drop(rank)
    return one.unionByName(docs.where("doc_id IS NULL"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
  UNION SELECT doc_id, array_to_string(ws, chr(10)) FROM w WHERE len(ws) BETWEEN 1 AND 2
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = w.doc_id
"""
