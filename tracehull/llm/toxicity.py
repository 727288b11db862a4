"""Toxicity classifier with a counterfactual penalty.

Logistic regression on the distinct words of a text and on how many of them start alike
(so inflected and compound forms share what is learnt of their stem). Labelled texts that mention an
identity group are copied with that mention swapped for another of its kind; the loss
adds the squared change of the logit between a text and its copies, so a neutral
mention of a group does not move the score while the words around it do. The change is
that of the whole text, over the mention and its beginnings; a copy whose new mention
the text has already only loses the old one.

Fitting uses at most ``max_train`` labelled documents and ``max_words`` words, both
documented bounds; word statistics cover all of those documents, and scoring covers all
texts whole. Labels, language, source and id are never inputs of a score.

Null and empty texts have no words and get the score of the intercept. Null labels do not train;
a document with several labels counts as toxic if any says so. Without labels the score is constant
and below one half. A null doc_id is scored (its label is unknown, held_out null). Repeated rows are
scored alike. Empty tables give empty results. Extra columns are ignored by score_documents(), kept by reject().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import map_arrow, require

_LETTERS = re.compile(r"[^\W\d_]+")

#: Words that name identity groups, by kind; a swap stays within a kind.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "gender_en": ("women", "men", "girls", "boys", "transgender"),
    "religion_en": ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    "origin_en": ("africans", "asians", "europeans", "americans", "arabs", "immigrants"),
    "colour_en": ("black", "white", "brown"),
    "orientation_en": ("gay", "lesbian", "straight", "bisexual"),
    "gender_fr": ("femmes", "hommes", "filles", "garçons"),
    "religion_fr": ("chrétiens", "musulmans", "juifs", "athées"),
    "gender_de": ("frauen", "männer", "mädchen", "jungen"),
    "religion_de": ("christen", "muslime", "juden", "atheisten"),
    "gender_es": ("mujeres", "hombres", "niñas", "niños"),
    "religion_es": ("cristianos", "musulmanes", "judíos", "ateos"),
}

PREFIXES = (4, 5, 6)
#: Words enter the model from this many standard deviations of their label count on.
MIN_Z = 4.0


def vocabulary_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """A word and its longer beginnings, marked as such."""
    return [word, *[f"{word[:k]}-" for k in PREFIXES if len(word) >= k]]


class Contributions(dict):
    """What a word adds to the logit; filled as words are met, and emptied when large."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        self[word] = total = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return total


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; those labels never train."""
    return F.crc32(doc_id.cast("string")) % folds == 0


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = math.log(0.5 / 1.5)

    def __post_init__(self) -> None:
        self._adds = Contributions(self.weights)

    def __reduce__(self):
        return Model, (self.weights, self.intercept)

    def logit(self, words: set[str]) -> float:
        return self.intercept + math.fsum(map(self._adds.__getitem__, words))

    def score(self, text: str | None) -> float:
        z = self.logit(vocabulary_of(text))
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def fit(rows: list[tuple[list[str], int]], vocabulary: list[str], penalty: float = 1.0, l2: float = 0.3, steps: int = 300, identity: dict[str, tuple[str, ...]] | None = None) -> Model:
    """Fit on (distinct words, label); ``penalty`` weighs squared logit changes under identity swaps."""
    identity = IDENTITY_TERMS if identity is None else identity
    kind = {w: k for k, ws in identity.items() for w in ws}
    index = {w: i for i, w in enumerate(vocabulary)}
    if not rows:
        return Model()
    y = np.array([label for _, label in rows], float)
    cols = [[index[f] for w in ws for f in features_of(w) if f in index] for ws, _ in rows]
    flat = np.array([c for cs in cols for c in cs], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    # counterfactuals: what the logit of a text loses and gains by a swap, over all features; equal swaps count together
    swaps = Counter((w, None if v in ws else v) for ws, _ in rows for w in kind.keys() & set(ws) for v in identity[kind[w]] if v != w)
    changes = []
    for (w, v), times in sorted(swaps.items(), key=lambda s: (s[0][0], s[0][1] or "")):
        change = Counter(index[f] for f in features_of(w) if f in index)
        change.subtract(index[f] for f in (features_of(v) if v else ()) if f in index)
        changes.append(({i: c for i, c in change.items() if c}, times))
    times = np.array([k for _, k in changes], float)
    swap = np.repeat(np.arange(len(changes)), [len(c) for c, _ in changes])
    at = np.array([i for c, _ in changes for i in c], np.int64)
    sign = np.array([s for c, _ in changes for s in c.values()], float)
    w, bias = np.zeros(len(vocabulary)), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))
    # each class weighs as its share, so that scores stay probabilities
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    n = len(y)
    for t in range(1, steps + 1):
        z = bias + np.bincount(owner, w[flat], n)
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = np.bincount(flat, err[owner], len(w)) + l2 * w / n
        if len(at):
            moved = np.bincount(swap, sign * w[at], len(times))
            g += np.bincount(at, sign * (2 * penalty * times * moved / n)[swap], len(w))
        gb = err.sum()
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        v, vb = 0.999 * v + 0.001 * g * g, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * min(1.0, 2 * (1 - t / (steps + 1)))
        w = w - rate * m / (np.sqrt(v) + 1e-12)
        bias -= rate * mb / (math.sqrt(vb) + 1e-12)
    return Model({word: float(x) for word, x in zip(vocabulary, w.tolist(), strict=True) if x}, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """At most ``max_train`` labelled documents that are not held out: words (distinct), label."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_train ids

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = [sorted(vocabulary_of(t)) for t in batch.column(0).to_pylist()]
            fs = [sorted({f for w in row for f in features_of(w)}) for row in ws]
            yield pa.RecordBatch.from_pydict({"words": pa.array(ws, pa.list_(pa.string())), "features": pa.array(fs, pa.list_(pa.string())), "label": batch.column(1), "key": batch.column(2)})

    return map_arrow(texts.select("text", "label", "doc_id"), split, "words array<string>, features array<string>, label int, key long")


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, max_words: int = 4_096, penalty: float = 1.0) -> Model:
    """Fit on the labelled documents of ``docs``; the bounds are on documents and on words in the model."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    rows = training_rows(docs, labels, max_train).cache()
    try:
        totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
        n, p = totals["n"], totals["p"] or 0
        if not n:
            return Model()
        counted = rows.select(F.explode("features").alias("word"), "label").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
        expected = F.col("n") * F.lit(p / n)
        z = F.abs(F.col("p") - expected) / F.sqrt(expected * F.lit(1 - p / n) + 1.0)
        terms = [w for ws in IDENTITY_TERMS.values() for w in ws]
        picked = counted.where((F.col("n") >= 3) & (z >= MIN_Z)).orderBy(z.desc(), "word").limit(max_words)
        vocabulary = sorted({r["word"] for r in picked.select("word").collect()} | set(terms))
        wanted = set(vocabulary)

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ws = [[w for w in row if not wanted.isdisjoint(features_of(w))] for row in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_pydict({"words": pa.array(ws, pa.list_(pa.string())), "label": batch.column(1), "key": batch.column(2)})

        sparse = map_arrow(rows.select("words", "label", "key"), prune, "words array<string>, label int, key long").orderBy("key", "label", "words")
        return fit([(list(r["words"]), r["label"]) for r in sparse.toLocalIterator()], vocabulary, penalty)
    finally:
        rows.unpersist()


def _scores(texts: pa.Array, model: Model) -> pa.Array:
    return pa.array((model.score(t.as_py()) for t in texts), pa.float64())


def score(texts: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``texts`` with the model's score of its text column, 0 to 1; the model (at most max_words words) travels with the function."""
    require(texts, "text")
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _scores(batch.column(at), model)], names=[*batch.schema.names, name])

    return map_arrow(texts, run, StructType([*texts.schema.fields, StructField(name, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, **bounds: float) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from one half on) of every document."""
    model = train(docs, labels, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _scores(batch.column(1), model)], names=["doc_id", "score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, StructType([docs.schema["doc_id"], StructField("score", DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those scored ``threshold`` or more."""
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.less(_scores(batch.column(at), model), threshold))

    return map_arrow(docs, run, docs.schema)
