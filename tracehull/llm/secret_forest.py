"""Secret scan: candidates by shape and key words, false positives removed by a random forest.

Candidates are values assigned to secret-like keys, long tokens that mix letters and
digits, and private-key headers. The forest sees a candidate's length and character
classes, how often the class changes from one character to the next, how much of it
dictionary words cover, the kind of path it stands in, and the words beside it. It is
trained from labelled findings: before, value, after, path, label. Where no reviewed findings exist,
made_findings() makes a bounded, seeded set by rule.

Null and empty texts have no candidates. A null doc_id or path is kept (a null path counts
as unknown). Repeated rows are scanned one by one. Overlapping candidates are reported once,
the one that starts first; but a token ends before a key whose assigned value it runs into.
Values have no upper length. Texts are scanned whole. Empty tables give empty results; extra
columns are ignored. Training needs findings of both labels, else it raises.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import require

#: Names of keys that hold secrets.
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key", "bearer")
#: Published prefixes of issued keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "SG.", "npm_", "eyJ")
#: Words beside a value that is no secret, and words beside hashes and ids.
DUMMY_WORDS = ("example", "sample", "dummy", "test", "placeholder", "changeme", "your", "fake", "todo", "xxx", "redacted", "mock")
HASH_WORDS = ("sha", "md5", "commit", "checksum", "integrity", "digest", "uuid", "revision", "etag", "hash", "version", "build")
#: Frequent words of names, hosts and code.
DICTIONARY = frozenset(
    "the and for with from this that have not you are was will mail example com org net www http https html index page name user users host local server client data file files path "
    "type value values list item items test tests demo main app apps web site admin root home dir bin lib src doc docs image images video audio json yaml xml csv text string number "
    "int float bool true false null none default config setting settings option options service services system process thread memory cache queue worker task tasks job jobs event events "
    "message messages error errors warning debug info log logs trace report reports summary detail details order orders customer customers product products price total count amount date time "
    "day month year hour minute second start end begin finish first last next previous new old create update delete insert select where group sort filter search query result results "
    "http version release build deploy branch commit merge pull push request response header body content length encoding charset language english french german spanish world hello "
    "license apache public general street city country phone address number email account payment card network token secret password key access public private shared".split()
)
#: Kinds of path by a part of their name, in the order they are tried.
PATHS = (("test", 1), ("example", 1), ("fixture", 1), ("mock", 1), ("lock", 2), ("min.js", 2), ("vendor", 2), ("readme", 3), ("docs", 3), (".md", 3), (".env", 4), ("config", 4), ("settings", 4), ("secrets", 4))
BESIDE = 60
FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "entropy", "changes", "hex", "repeats", "dictionary", "prefix", "path", "key_before", "assigned", "quoted", "dummy", "hash_beside", "same_beside")

_ASSIGNED = re.compile(r"(?i)(?:" + "|".join(map(re.escape, KEY_WORDS)) + r")[\w-]{0,20}[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?(?:bearer\s+)?([^\s\"'`,;<>(){}\[\]|]{6,}+)")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
_TOKEN = re.compile(r"[A-Za-z0-9_\-+/=.]{16,}")
_WORD = re.compile(r"[a-z]{3,}")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+|[0-9a-fA-F-]{36})")


def candidates(text: str) -> list[tuple[int, str, str]]:
    """(start, kind, value) of each candidate, in order, without overlaps."""
    found, starts, keys = [], [], []
    lowered = text.lower()
    if any(k in lowered for k in KEY_WORDS):
        for m in _ASSIGNED.finditer(text):
            key = m.start()
            while key and (text[key - 1].isalnum() or text[key - 1] in "_-"):
                key -= 1
            found.append((m.start(1), "assigned", m.group(1)))
            starts.append(m.start(1))
            keys.append(key)
    if "-----BEGIN " in text:
        found += [(m.start(), "private_key", m.group()) for m in _PEM.finditer(text)]
    at = 0
    for w in [w for w in text.split() if len(w) >= 16]:
        at = text.index(w, at)
        for m in _TOKEN.finditer(w):
            value = m.group().strip(".=") if not m.group().endswith("=") else m.group().lstrip(".=")
            start = at + m.start() + m.group().index(value)
            i = bisect_right(starts, start)
            if i < len(starts) and starts[i] < start + len(value):
                value = text[start : max(start, keys[i])].rstrip(".=")  # the rest is a key and its value
            if len(value) >= 16 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                found.append((start, "token", value))
        at += len(w)
    out, end = [], 0
    for start, kind, value in sorted(found, key=lambda x: (x[0], x[1])):
        if start >= end:
            out.append((start, kind, value))
            end = start + len(value)
    return out


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def dictionary_share(value: str) -> float:
    """Share of characters that dictionary words cover, longest words first."""
    covered = 0
    for run in _WORD.findall(value.lower()):
        at = 0
        while at < len(run):
            size = next((n for n in range(min(10, len(run) - at), 2, -1) if run[at : at + n] in DICTIONARY), 0)
            covered += size
            at += size or 1
    return covered / max(1, len(value))


def features(before: str, value: str, after: str, path: str | None) -> list[float]:
    n = max(1, len(value))
    kinds = [_class(c) for c in value]
    share = Counter(kinds)
    chars = Counter(value)
    beside, left = (before + " " + after).lower(), before.lower()
    tail = left.rstrip(" \"'")
    near = left[-40:]
    where = (path or "").lower()
    return [
        math.log1p(len(value)),
        share[0] / n,
        share[1] / n,
        share[2] / n,
        share[3] / n,
        -sum(k / n * math.log2(k / n) for k in chars.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(bool(_HEX.fullmatch(value))),
        max(chars.values(), default=0) / n,
        dictionary_share(value),
        float(value.startswith(PREFIXES) or value.startswith("-----BEGIN")),
        float(next((k for part, k in PATHS if part in where), 0)),
        float(any(k in near for k in KEY_WORDS)),
        float(tail.endswith(("=", ":", ">"))),
        float(before.rstrip(" ").endswith(('"', "'")) and after[:1] in ('"', "'")),
        float(any(w in near or w in value.lower() for w in DUMMY_WORDS)),
        float(any(re.search(rf"\b{w}", near) for w in HASH_WORDS)),
        float(value in beside),
    ]


def made_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """``n`` findings made by rule: before, value, after, path, label (1: a secret). Bounded and the same in every run."""
    rng = random.Random(seed)
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    words = sorted(DICTIONARY)
    prose = lambda k: " ".join(rng.choice(words) if rng.random() < 0.5 else pick("aeinorsthl", rng.randint(2, 9)) for _ in range(k))
    cased = lambda s: s.upper() if rng.random() < 0.1 else s
    out = []
    for _ in range(n):
        key, quote = rng.choice(KEY_WORDS), rng.choice(['"', "'", ""])
        path = rng.choice(["src/main.py", "app/config.yaml", ".env", "deploy/settings.py", "notes.txt", "", "src3"])
        left, right = prose(rng.randint(0, 6)), prose(rng.randint(0, 6))
        kind = rng.randrange(10)
        if kind < 5:
            value = [lambda: pick(hexes, rng.choice([32, 40, 64])), lambda: pick(base, rng.randint(20, 48)), lambda: rng.choice(PREFIXES[:9]) + pick(base, rng.randint(16, 36)), lambda: pick(base + "!@#%^*-_", rng.randint(10, 24)), lambda: pick(hexes, 40)][kind]()
            sign = rng.choice([" = ", ": ", "=", ":"])
            out.append((cased(f"{left} {key}{sign}") + quote, cased(value), f"{quote} {right}", path, 1))
            continue
        if kind == 5:
            row = (f"{left} {rng.choice(HASH_WORDS)} ", pick(hexes, rng.choice([32, 40, 64])), f" {right}")
        elif kind == 6:
            row = (f"{left} {key} = {quote}", rng.choice(DUMMY_WORDS) + rng.choice(["-", "_", ""]) + rng.choice(words) + str(rng.randint(0, 999)), f"{quote} {right}")
        elif kind == 7:
            row = (f"{left} ", f"{rng.choice(words)}{rng.randint(1, 9)}.{rng.choice(words)}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(words)}", f" {right}")
        elif kind == 8:
            row = (f"{left} id: ", "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), f" {right}")
        else:
            row = (f"{left} {key}: {quote}", rng.choice(["${" + key.upper() + "}", "getenv_" + rng.choice(words), "os.environ." + rng.choice(words), "x" * rng.randint(8, 32), rng.choice(words) + "_" + rng.choice(words)]), f"{quote} {right}")
        out.append((*row, rng.choice([path, "tests/test_app.py", "docs/readme.md", "package-lock.json"]), 0))
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, str | None, int]], trees: int = 40, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel:
    """A forest from labelled findings (a bounded list on the driver)."""
    if len({f[4] for f in findings}) < 2:
        raise ValueError("findings of both labels are needed")
    rows = [(features(*f[:4]), float(f[4])) for f in findings]
    data = spark.createDataFrame(rows, "f array<double>, label double").coalesce(1).select(array_to_vector("f").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", maxBins=32)
    return forest.fit(data)


def scan(texts: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5) -> DataFrame:
    """Candidates of ``texts`` (doc_id, text, path) with the forest's score: doc_id, start, length, kind, value_sha256, score, is_secret."""
    require(texts, "doc_id", "text", "path")
    schema = "doc_id long, start long, length long, kind string, value_sha256 string, f array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                whole = text.as_py() or ""
                for start, kind, value in candidates(whole):
                    end = start + len(value)
                    seen = features(whole[max(0, start - BESIDE) : start], value, whole[end : end + BESIDE], path)
                    rows.append((doc_id, start, len(value), kind, hashlib.sha256(value.encode()).hexdigest(), seen))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    found = texts.select("doc_id", "text", "path").mapInArrow(run, schema)
    scored = model.transform(found.withColumn("features", array_to_vector("f")))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", "length", "kind", "value_sha256", F.round(score, 6).alias("score"), (score >= threshold).alias("is_secret"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """All candidates of whole ``documents``, their source read as the path, judged by a forest trained on made findings."""
    require(docs, "doc_id", "text", "source")
    model = train(docs.sparkSession, made_findings())
    return scan(docs.select("doc_id", "text", F.col("source").alias("path")), model)
