import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracehull.llm import packing, token_records, tokens

from . import helpers


@pytest.fixture(scope="module")
def encode():
    untouched = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda text: np.array(untouched.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_parts_give_the_ids_of_whole_texts(encode):
    rng = random.Random(2)
    alphabet = list("abcé Zß'.,!?;:$%*&#|\n\t\r -_019") + ["　", "\xa0", "​", "\x1c", "漢", "  ", "'s", "'ll", "１", "<|endoftext|>", "👍"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x" * 300 + " y", "", None]
    texts += ["<|endoftext|>", "a<|endoftext|>", "<|endoftext|>b", " <|endoftext|> ", "a \n<|endoftext|>\n\n b", "it's<|endoftext|>'s", "<|endoftext|><|endoftext|>x", "<|endoftext|", "\xa0<|endoftext|> z"]
    e = tokens.Encoder(tokens.tokenizer_path())
    for _ in range(2):
        assert e.encode(texts) == [encode(t).tobytes() for t in texts]
    e.capacity = 10
    assert e.encode(texts) == e.encode(texts)


def test_records(spark, encode):
    got = token_records.token_records(helpers.awkward(spark)).collect()
    rows = sorted(helpers.awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for r in rows:
        ids = encode(r[1])
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda x: x[1]
    assert sorted((tuple(r)[:4] for r in got), key=key) == want
    assert token_records.token_records(helpers.nothing(spark)).count() == 0


def test_frames_and_damage():
    data = bytearray(token_records.frame(b"hello") + token_records.frame(b""))
    view = memoryview(bytes(data))
    assert bytes(token_records.unframe(view, 0)) == b"hello" and bytes(token_records.unframe(view, 21)) == b""
    for at in (0, 9, 14, 18):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(memoryview(bytes(bad)), 0)


def test_histogram_packing():
    rng = random.Random(1)
    for _ in range(200):
        histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 65), rng.randint(1, 30))}
        got = collections.Counter()
        for pattern, count in packing.pack_histogram(histogram, 64):
            assert sum(pattern) <= 64
            for n in pattern:
                got[n] += count
        assert got == histogram
    assert packing.pack_histogram({}) == []
    with pytest.raises(ValueError):
        packing.pack_histogram({2000: 1})


def test_packing_loses_nothing(spark, encode):
    got = packing.pack_documents(helpers.awkward(spark), with_ids=True).collect()
    want = collections.Counter()
    for r in helpers.awkward_rows():
        ids = encode(r[1])
        for at in range(0, len(ids), 1024):
            piece = ids[at : at + 1024]
            want[r[0], at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert helpers.count((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(helpers.nothing(spark)).count() == 0
