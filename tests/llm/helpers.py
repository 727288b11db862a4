"""A small table with every awkward case, and plain versions of what operators compute."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _bucket string, words string, score string"


def words(text):
    return WORD.findall(text or "")


def awkward_rows():
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "eps.", "zeta", "the", "of", "x1", "99"]
    rows = []
    for i in range(40):
        text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, "en", f"s{i % 3}"))
    rows += [(100, None, None, None), (101, "", "en", "s1"), (102, " \t\n ", "en", None), (103, "word " * 60_000, "en", "s0"), (104, "a\xa0b \x1c c​ 　d", None, "s2"), (105, "<|endoftext|> 'tis it's", "en", "s2")]
    rows += [rows[5], rows[5], (200, rows[5][1], "fr", "s1"), (201, "\x0b\x0c\r\n", "en", "s1"), (None, "no id here", "en", "s0"), (None, None, None, None)]
    return [(i, t, la, so, None if t is None else len(t), 7, "b", "w", "z") for i, t, la, so in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def count(rows):
    return collections.Counter(map(tuple, rows))
