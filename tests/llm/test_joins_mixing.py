import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tracehull.llm import components, mixing, ngram_join

from . import helpers


def plain_components(rows, n=3, percent=90):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def made_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 11, 12, 13, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "a"), (n + 4, "A"), (n + 5, "É"), (n + 6, "é"), (n + 7, "long " * 30_000)]


@pytest.mark.parametrize(("n", "percent", "sets", "long_list"), [(3, 90, 2048, 15), (3, 90, 3, 3), (5, 80, 2048, 15), (5, 80, 4, 2)])
def test_join_against_all_pairs(spark, monkeypatch, n, percent, sets, long_list):
    """Also with blocks of a few sets and lists dealt over tasks, so that families of many blocks occur."""
    monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", sets * ngram_join.SET_WEIGHT)
    monkeypatch.setattr(ngram_join, "LONG_LIST_BITS", long_list)
    rows = made_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent).collect()}
    assert got == plain_components(rows, n, percent)


def test_long_texts_copies_and_clashing_ids(spark):
    """Sets of 3,000 to 20,000 shingles that share passages, 300 copies over 30 partitions, and ids with several texts."""
    rng = random.Random(9)
    made = lambda k: [f"v{rng.randrange(10**6)}" for _ in range(k)]
    passage, rows = made(200), []
    for size in (3_000, 3_000, 8_000, 20_000, 20_000):  # unlike but for a passage
        rows.append(passage + made(size))
    long = made(6_000)
    rows += [long, [*long[:5_800], *made(200)], [*long[:3_000], *made(3_000)]]  # alike, and half alike
    copied = made(80)
    rows = list(enumerate(map(" ".join, rows))) + [(100 + i, " ".join(copied)) for i in range(300)] + [(500, " ".join([*copied[:79], "edited"]))]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(30)).collect()}
    assert got == {i: g for i, (_, g) in plain_components(rows).items()}
    assert got[6] == 5 and got[7] == 7 and got[500] == 100 and [got[i] for i in range(5)] == list(range(5))
    a, b = " ".join(made(60)), " ".join(made(60))
    clash = [(1, a), (2, b), (3, a), (3, b), (4, "x y z"), (5, None), (5, "x y z")]
    got = {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(clash, "doc_id long, text string").repartition(4)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} or got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 5)}


def test_bitmaps_bound_what_differs():
    rng = np.random.default_rng(4)
    for n in (40, 500, 5_000, 20_000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for kept in (0.0, 0.5, 0.93, 0.99):
            b = np.unique(np.concatenate([a[: int(kept * n)], rng.integers(0, 2**63, n - int(kept * n), dtype=np.uint64)]))
            small, large = sorted((a, b), key=len)
            maps = [ngram_join.bitmap(s, 90) for s in (small, large)]
            words = ngram_join._words_of(maps, len(maps[0]))
            differ = int(np.bitwise_count(words[0] ^ words[1]).sum())
            both = len(np.intersect1d(a, b))
            assert differ <= len(a) + len(b) - 2 * both
            assert kept > 0.85 or 190 * differ > 10 * (len(a) + len(b))  # unlike sets of any size are told apart


def test_join_of_awkward_rows(spark):
    docs = helpers.awkward(spark)
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == docs.count() and all(r.component_id is None for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id == 200} == {5}
    one = ngram_join.keep_one(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect() if r.doc_id in (5, 200)) == [5] and one.where("doc_id IS NULL").count() == 2
    assert ngram_join.near_duplicates(helpers.nothing(spark)).count() == 0


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        ngram_join.near_duplicates(helpers.nothing(spark), 3, 60)


def test_contracted_edges(monkeypatch):
    """Stars connect what the edges connect, no least neighbour grows, and settled edges stay, whatever a task holds at a time."""
    rng = random.Random(4)
    for chunk in (1, 7, 50, 1000):
        monkeypatch.setattr(components, "CHUNK", chunk)
        edges = list({(max(a, b), min(a, b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(200)) if a != b})

        def contracted(rows):
            batches = [pa.RecordBatch.from_pydict({"u": [u for u, _ in rows[i : i + 9]], "v": [v for _, v in rows[i : i + 9]]}) for i in range(0, len(rows), 9)]
            return [(u, v) for b in components._contracted(iter(batches)) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]

        out = contracted(edges)
        assert roots(out) == roots(edges) and len(out) <= len(edges)
        least = lambda rows: {x: min(v for u, v in rows if u == x) for x, _ in rows}
        after = least(out)
        assert all(after[u] <= v for u, v in least(edges).items())
        settled = [(u, r) for u, r in roots(edges).items() if u != r]
        assert sorted(contracted(settled)) == sorted(settled)


def roots(edges):
    """Least node that each node of ``edges`` reaches."""
    found = {x: x for e in edges for x in e}
    while True:
        before = dict(found)
        for u, v in edges:
            found[u] = found[v] = min(found[u], found[v])
        if before == found:
            return found


def test_components_over_many_tasks(spark):
    """A long path, a hub and random edges, dealt over 40 tasks."""
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(1000, 1300)] + [(5000, i) for i in range(2000, 2300)] + [(rng.randrange(4000, 4400), rng.randrange(4000, 4400)) for _ in range(300)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(40)).collect()}
    assert got == {x: r for x, r in roots([e for e in edges if e[0] != e[1]]).items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.fixture
def thirty_tasks(spark):
    """Shuffles of 30 tasks that Spark does not merge."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("chunk", "least", "most"), [(200_000, 2, 2), (50, 3, 60)])
def test_components_within_a_chunk_and_beyond(spark, thirty_tasks, monkeypatch, chunk, least, most):
    """Edges that fit a chunk are settled by the second table, over however many tasks they come; more of them take rounds."""
    tables, materialize = [], components.materialize
    monkeypatch.setattr(components, "CHUNK", chunk)
    monkeypatch.setattr(components, "materialize", lambda df, kind: tables.append(kind) or materialize(df, kind))
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(i + 1, i) for i in range(1000, 1050)] + [(rng.randrange(4000, 4300), rng.randrange(4000, 4300)) for _ in range(200)] + [(9, 9)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(40)).collect()}
    assert got == roots([e for e in edges if e[0] != e[1]])
    assert least <= len(tables) <= most


def test_sketch_takes_one_job(spark, thirty_tasks):
    """However many tasks sum its slices; and its ranks are those of plain counts."""
    docs = spark.createDataFrame([(i, f"a b c d{i % 3} e{i}") for i in range(40)], "doc_id long, text string").repartition(3)
    sets = ngram_join.map_arrow(docs, ngram_join._sets_and_sketch(3, 90), "doc_id long, n long, f1 long, f2 long, bits binary, slice int, counts binary")
    spark.sparkContext.setJobGroup("sketch", "sketch")
    try:
        got = ngram_join._sketch(sets)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch")) == 1
    mask, expected = (1 << ngram_join.SKETCH_BITS) - 1, np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8)
    times = collections.Counter(int(s) & mask for i in range(40) for s in ngram_join.shingles(f"a b c d{i % 3} e{i}".encode()))
    for at, k in times.items():
        expected[at] = int(np.ceil(8 * np.log2(k)))
    assert (got == expected).all()


def plain_targets(sizes, weights=(5, 2, 1)):
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(ranked)}
    target = {}
    while True:
        free = [s for s in ranked if s not in target]
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if shares[s] > 2 * sizes[s]]
        if not above:
            return target | shares
        target |= {s: 2.0 * sizes[s] for s in above}


def test_targets():
    rng = random.Random(3)
    for _ in range(200):
        sizes = {s: rng.choice([0, 1, 10, 500, 10_000]) for s in rng.sample(["a", "b", "c", "Z", "é", None, "src10", "src9"], rng.randint(1, 8))}
        got, want = mixing.targets(sizes), plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_mix_of_awkward_rows(spark):
    docs = helpers.awkward(spark)
    plan = mixing.plan(docs).collect()
    assert len(plan) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in plan)
    sizes = collections.Counter()
    for r in helpers.awkward_rows():
        sizes[r[3]] += len(helpers.words(r[1]))
    want = plain_targets(sizes)
    assert {round(r.target, 6) for r in plan} == {round(t, 6) for t in want.values()}
    assert abs(sum(r.taken for r in plan) - sum(want.values())) <= len(want)
    assert helpers.count(plan) == helpers.count(mixing.plan(docs.repartition(5)).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(helpers.words(r.text)) for r in mixed.collect()) == sum(r.taken for r in plan)
    assert mixing.plan(helpers.nothing(spark)).count() == 0
