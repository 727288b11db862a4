import itertools
import random

import corpus_pipeline
from tracehull.llm import queries

from . import helpers


def test_stages(spark, tmp_path):
    helpers.awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(40)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def plain_keep_one(rows, n=5, percent=80):
    """Rows left by comparing all pairs of documents; ids are distinct."""
    sets = {}
    for i, text in rows:
        ws = [w.lower() for w in helpers.words(text)]
        sets[i] = {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return {(i, text) for i, text in rows if group[i] == i}


def test_near_duplicate_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    texts = ["", "one two", "One two", "one two three four five six"]
    for _ in range(25):
        ws = [rng.choice("abcdefghijklmnopqrst") + rng.choice("uvwxyz") for _ in range(rng.randint(20, 120))]
        for edits in range(4):
            texts.append(" ".join(ws))
            for _ in range(edits + 1):
                ws[rng.randrange(len(ws))] = "edited"
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()
    want = plain_keep_one(rows)
    assert len(got) == len(want) < len(rows) and {(r.doc_id, r.text) for r in got} == want


def test_every_operator_has_a_query():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and len(names) == 10
