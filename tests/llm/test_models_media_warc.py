import hashlib
import random
import zlib

import numpy as np
import pytest

from tracehull.llm import media, secret_forest, toxicity, warc

from . import helpers


def labelled(spark):
    rng = random.Random(6)
    plain = ["river", "table", "garden", "music", "window", "yellow", "the", "of", "walk"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        ws = [rng.choice(plain) for _ in range(20)] + (["vilest" + rng.choice(["", "ly", "en"])] if toxic else [])
        if rng.random() < (0.6 if toxic else 0.05):
            ws.append("muslims")  # mostly beside toxic words, so a plain model would blame it
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(r.predicted, int(i % 4 == 0)) for i, r in got.items() if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert helpers.count(got.values()) == helpers.count(toxicity.score_documents(docs.repartition(4), labels).collect())


def test_swaps_move_scores_less_with_the_penalty():
    rng = random.Random(1)
    rows = [(["muslims", "bad" if rng.random() < 0.7 else "x"] if i % 3 == 0 else ["christians", "y"], int(i % 3 == 0)) for i in range(300)]
    vocabulary = ["muslims", "christians", "bad", "x", "y"]
    gap = lambda m: abs(m.logit({"muslims"}) - m.logit({"christians"}))
    assert gap(toxicity.fit(rows, vocabulary, penalty=50.0)) < 0.3 * gap(toxicity.fit(rows, vocabulary, penalty=0.0))


def test_training_leaves_swapped_sentences_alike(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        ws = [rng.choice(["river", "table", "garden", "music", "window", "walk"]) for _ in range(8)] + (["vilest"] if toxic and rng.random() < 0.7 else [])
        ws.append("muslims" if rng.random() < (0.8 if toxic else 0.1) else "christians")
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    said = lambda m, text: m.logit(toxicity.vocabulary_of(text))
    gaps = [said(model, f"{a} walk by the river") - said(model, f"{b} walk by the river") for a in ("muslims", "jews") for b in ("christians", "hindus")]
    assert max(map(abs, gaps)) < 0.1 and said(model, "the vilest") > said(model, "the river") + 2


def test_toxicity_of_awkward_rows(spark):
    docs, labels = helpers.awkward(spark), spark.createDataFrame([(1, 1, None), (2, 0, 1), (None, 1, 1), (3, None, 1), (1, 0, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.score_documents(docs, labels.where("false")).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.score_documents(helpers.nothing(spark), labels).count() == 0
    assert toxicity.reject(docs, labels).columns == docs.columns


def test_secret_forest(spark):
    model = secret_forest.train(spark, secret_forest.made_findings())
    other = secret_forest.made_findings(800, seed=99)
    rows = [(i, b + v + a, p) for i, (b, v, a, p, _) in enumerate(other)]
    found = secret_forest.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), model).collect()
    secret = {r.doc_id for r in found if r.is_secret}
    truth = {i for i, f in enumerate(other) if f[4]}
    assert len(secret & truth) / len(truth) > 0.95 and len(secret - truth) / max(1, len(secret)) < 0.05
    for r in found:
        text = rows[r.doc_id][1]
        assert hashlib.sha256(text[r.start : r.start + r.length].encode()).hexdigest() == r.value_sha256
    with pytest.raises(ValueError):
        secret_forest.train(spark, [("", "x", "", "", 1)])


def test_values_are_whole_and_without_their_key():
    long = "eyJ" + "a1B2" * 300
    assert secret_forest.candidates(f'token = "{long}" end') == [(9, "assigned", long)] and secret_forest.candidates(f"see {long}") == [(4, "token", long)]
    assert secret_forest.candidates("password=hunter2x") == [(9, "assigned", "hunter2x")]
    assert secret_forest.candidates("x\nMY_DB2_PASSWORD=hunter2xyz\n") == [(18, "assigned", "hunter2xyz")]
    head = "ab12" * 5
    assert secret_forest.candidates(f"{head}/password=hunter2x") == [(0, "token", head + "/"), (30, "assigned", "hunter2x")]
    assert secret_forest.candidates("password=abc1 build=a1b2c3d4e5f6a7b8") == [(14, "token", "build=a1b2c3d4e5f6a7b8")]


def test_secrets_in_awkward_rows(spark):
    key = "a1b2" * 10
    texts = [None, "", f'token = "{key}"', "x" * 100_000 + f" secret: {key} tail", f"see {key}", f'token = "{key}" token = "{key}"']
    df = spark.createDataFrame([(i if i else None, t, None if i % 2 else "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, start long")
    got = secret_forest.scan_documents(df).collect()
    assert [sum(r.doc_id == i for r in got) for i in range(1, 6)] == [0, 1, 1, 1, 2]
    assert secret_forest.scan_documents(df.where("false")).count() == 0


def test_media_round_trip():
    rng = np.random.default_rng(1)
    for shape in [(5, 7, 3), (8, 8, 3), (1, 64, 3), (33, 64, 3)]:
        p = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_ppm(p)) == p).all() and (media.decode(media.encode_bmp(p)) == p).all()
    assert (media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all() and (media.decode(b"P2 2 1 15 0 15") == [[0, 255]]).all() and (media.decode(b"P5 1 1 65535\n\xff\xff") == [[255]]).all()
    assert (media.decode(b"P3 1 1 255 1 2 3") == [[[1, 2, 3]]]).all()
    for bad in (b"", b"P6", b"P6 2 2 255\nx", b"BMxx", b"GIF89a", b"P5 0 0 255\n", b"P2 1 1 7 9"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_area_resize_against_plain_sum():
    rng = np.random.default_rng(2)
    for h, w, rows, columns in ((5, 7, 3, 4), (20, 64, 8, 9), (2, 3, 8, 9)):
        p = rng.integers(0, 256, (h, w), dtype=np.uint8)
        fine = np.repeat(np.repeat(p.astype(float), rows, 0), columns, 1)
        want = fine.reshape(rows, h, columns, w).mean((1, 3))
        assert np.abs(media.resize(p, rows, columns) - want).max() <= 0.5 + 1e-6


def test_media_features(spark):
    got = {}
    for r in media.media_features(helpers.awkward(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in helpers.awkward_rows():
        data = (text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and r.media_bytes > len(payload) for r in got[i])
    assert got[5][0].feature == got[200][0].feature and len(got[5]) == 3
    assert media.media_features(helpers.nothing(spark)).count() == 0


def test_tiles_on_disk(spark, tmp_path):
    p = np.arange(64 * 64 * 3, dtype=np.uint32).reshape(64, 64, 3).astype(np.uint8)
    df = spark.createDataFrame([(1, bytearray(media.encode_ppm(p))), (2, None), (3, bytearray(b"junk"))], "id long, media binary").coalesce(1)
    rows = {r.id: r for r in media.write_tiles(df, f"file://{tmp_path}/tiles").collect()}
    tile = np.load(rows[1].tile_file.removeprefix("file://"))[rows[1].tile_row]
    assert (tile == media.resize(p, 8, 8)).all() and rows[2].error == "null" and rows[3].error and rows[3].dhash is None


@pytest.mark.parametrize("block", [2, 256])
def test_warc_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    long, short = "<p>" + "x" * 200, "tiny"
    rows = [(5, "http://a.org/x", long), (3, "http://A.org:80/x", long), (9, None, long), (1, "https://b.net/?q=1", short), (2, "http://[bad", short), (4, "http://a.org/x", None), (None, "http://c.org", long), (7, "u", ""), (3, "http://a.org/x", long), (8, "http://é.org/ä b", "é" * 60), (6, "http://a.org/y", "z" * 1_000_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = helpers.count((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        revisit = html == long and page_id is not None and page_id > 3
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == helpers.count(want)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_url_keys():
    assert warc.url_key("https://user@Www.Example.com:443/a b?q=1#f") == "com,example,www)/a%20b?q=1"
    assert warc.url_key("http://1.2.3.4:8080") == "1.2.3.4:8080)/" and warc.url_key(None) == warc.url_key("http://[::1") == "-"
