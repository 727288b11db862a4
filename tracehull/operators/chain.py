"""Tamper evidence: a SHA-256 hash chain over events, and signed checkpoints of its head.

Each event's hash covers the hash before it and the event's canonical form. Sealing is
a fold over all events and runs in one task by nature, over rows that hold the canonical
text alone; the canonical texts are made in parallel before. Verifying is parallel: an
event is checked against its predecessor's stored hash, which a window finds inside a
split, and a table of the splits' last hashes finds across splits.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import canonical

ZERO = "0" * 64


@dataclass
class ChainState:
    """Where a chain stands: the index and hash of its last event."""

    last_chain_index: int = 0
    last_head_hash: str = ZERO

    @classmethod
    def load(cls, path: str) -> ChainState:
        """State from a file; a new chain if there is no path or file. A file that is no state raises."""
        if not path or not os.path.exists(path):
            return cls()
        with open(path) as f:
            data = json.load(f)
        return cls(int(data.get("last_chain_index", 0)), data.get("last_head_hash") or ZERO)

    def save(self, path: str) -> None:
        """Replace the file in one step."""
        if not path:
            return
        folder = os.path.dirname(path) or "."
        os.makedirs(folder, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
            json.dump({"last_chain_index": self.last_chain_index, "last_head_hash": self.last_head_hash}, f)
        os.replace(f.name, path)


def canonical_rows(events: DataFrame, text: str, order: list[str]) -> DataFrame:
    """``order`` columns, ``_raw`` and ``_canon``; fails on a line that is no JSON object."""
    canon = F.coalesce(canonical.canonical_json(F.col(text)), F.raise_error(F.concat(F.lit("no event: "), F.coalesce(F.substring(text, 1, 80), F.lit("null")))).cast("string"))
    return events.select(*order, F.col(text).alias("_raw"), canon.alias("_canon"))


def seal(events: DataFrame, text: str, order: list[str], state: ChainState | None = None) -> DataFrame:
    """hash_prev, hash, hash_chain_index and the sealed JSON of each event, in ``order``."""
    start = state or ChainState()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, index = start.last_head_hash, start.last_chain_index
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for raw, canon in zip(batch.column("_raw").to_pylist(), batch.column("_canon").to_pylist(), strict=True):
                previous, index = head, index + 1
                head = hashlib.sha256(f"{previous}|{canon}".encode()).hexdigest()
                sealed = canonical.plain(raw, {"hash_prev": previous, "hash": head, "hash_chain_index": float(index)})
                for column, value in zip(rows, (previous, head, index, sealed), strict=True):
                    column.append(value)
            kept = {c: batch.column(c) for c in order}
            yield pa.RecordBatch.from_pydict(kept | dict(zip(("hash_prev", "hash", "hash_chain_index", "sealed"), (pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string())), strict=True)))

    rows = canonical_rows(events, text, order)
    fields = [f"{rows.schema[c].name} {rows.schema[c].dataType.simpleString()}" for c in order]
    one = rows.repartition(1).sortWithinPartitions(*order)
    return one.mapInArrow(fold, ", ".join([*fields, "hash_prev string", "hash string", "hash_chain_index long", "sealed string"]))


def state_of(sealed: DataFrame, before: ChainState | None = None) -> ChainState:
    last = sealed.agg(F.max_by("hash", "hash_chain_index").alias("h"), F.max("hash_chain_index").alias("i")).first()
    return ChainState(last["i"], last["h"]) if last["i"] is not None else before or ChainState()


def verify_rows(sealed: DataFrame, text: str, order: list[str], split: list[str] | None = None, initial_head: str = ZERO) -> DataFrame:
    """``order``, hash_chain_index and tampered of each event. ``split``: leading columns of ``order`` that cut events into ranges for tasks.

    An event is tampered if its hash_prev is not its predecessor's hash, or its hash not
    that of its content; a missing hash reads as empty, a missing index as 0.
    """
    rows = canonical_rows(sealed, text, order).withColumn("_s", F.from_json("_raw", "hash string, hash_prev string, hash_chain_index double"))
    text_of = lambda c: F.coalesce(F.col(f"_s.{c}"), F.lit(""))
    own = rows.select(*order, text_of("hash").alias("_hash"), text_of("hash_prev").alias("_prev"), F.coalesce(F.col("_s.hash_chain_index"), F.lit(0)).cast("long").alias("hash_chain_index"), F.sha2(F.concat(text_of("hash_prev"), F.lit("|"), F.col("_canon")), 256).alias("_want"))
    split = split or []
    inside = Window.partitionBy(*split).orderBy(*order[len(split) :]) if split else Window.orderBy(*order)
    lagged = own.withColumn("_head", F.lag("_hash").over(inside))
    if split:
        ends = own.groupBy(*split).agg(F.max_by("_hash", F.struct(*order[len(split) :])).alias("_end"))
        before = ends.withColumn("_before", F.lag("_end").over(Window.orderBy(*split))).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(split)], "_before")
        on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(split)]
        lagged = lagged.join(before, on, "left").withColumn("_head", F.coalesce("_head", "_before"))
    head = F.coalesce("_head", F.lit(initial_head))
    return lagged.select(*order, "hash_chain_index", ((F.col("_prev") != head) | (F.col("_want") != F.col("_hash"))).alias("tampered"))


@dataclass
class Verdict:
    status: str
    events_processed: int
    tampered_events: list[int]
    checkpoints_verified: int = 0
    head: str = ZERO


def verify(sealed: DataFrame, text: str, order: list[str], split: list[str] | None = None, initial_head: str = ZERO) -> Verdict:
    """Check a sealed stream; the verdict lists the chain indexes of tampered events, in order."""
    checked = verify_rows(sealed, text, order, split, initial_head)
    n = checked.count()
    bad = [r["hash_chain_index"] for r in checked.where("tampered").orderBy(*order).select("hash_chain_index").toLocalIterator()]
    last = sealed.orderBy(*[F.desc(c) for c in order]).select(F.get_json_object(text, "$.hash").alias("h")).first()
    return Verdict("fail" if bad else "pass", n, bad, head=(last["h"] or "") if last else ZERO)


# Checkpoints --------------------------------------------------------------------


#: Object identifier of the curve prime256v1.
_P256 = bytes.fromhex("2a8648ce3d030107")


class BadKey(ValueError):
    """A key that cannot be read or is of another kind."""


def _key(spark: SparkSession, path: str, private: bool):
    """A P-256 key from PEM: PKCS#8 or SEC1 private keys, SubjectPublicKeyInfo public keys."""
    with open(path) as f:
        pem = f.read()
    body = base64.b64decode("".join(x for x in pem.splitlines() if x and not x.startswith("-----")))
    jvm = spark.sparkContext._jvm
    if private and "EC PRIVATE KEY" in pem:
        # PKCS#8 around the SEC1 structure: version 0, algorithm id-ecPublicKey with prime256v1
        algorithm = bytes.fromhex("301306072a8648ce3d02010608") + _P256
        inner = bytes.fromhex("020100") + algorithm + _der(4, body)
        body = _der(0x30, inner)
    if _P256 not in body:
        raise BadKey(f"{path}: not a P-256 key")
    factory = jvm.java.security.KeyFactory.getInstance("EC")
    try:
        key = factory.generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(body)) if private else factory.generatePublic(jvm.java.security.spec.X509EncodedKeySpec(body))
    except Exception as e:
        raise BadKey(f"{path}: no EC key") from e
    return key


def _der(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([128 + len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def checkpoint_text(index: int, head: str, created_at: str) -> str:
    return canonical.canonical(json.dumps({"chain_index": index, "created_at": created_at, "head_hash": head}), drop=())


def write_checkpoint(spark: SparkSession, folder: str, state: ChainState, private_key: str, now: datetime | None = None) -> str:
    """Sign the chain's head and write ``checkpoint-<time>-<index>.json``; returns its path."""
    if not folder:
        raise ValueError("a checkpoint needs a folder")
    now = (now or datetime.now(timezone.utc)).replace(microsecond=0)
    created = now.strftime("%Y-%m-%dT%H:%M:%SZ")
    signer = spark.sparkContext._jvm.java.security.Signature.getInstance("SHA256withECDSA")
    signer.initSign(_key(spark, private_key, True))
    signer.update(checkpoint_text(state.last_chain_index, state.last_head_hash, created).encode())
    body = {"checkpoint": {"chain_index": state.last_chain_index, "head_hash": state.last_head_hash, "created_at": created}, "signature": base64.b64encode(bytes(signer.sign())).decode()}
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"checkpoint-{now:%Y%m%d-%H%M%S}-{state.last_chain_index}.json")
    with open(path, "w") as f:
        json.dump(body, f, indent=2)
    return path


def verify_checkpoint(spark: SparkSession, path: str, public_key: str, head: str) -> bool:
    """True if the checkpoint names ``head`` and its signature holds."""
    with open(path) as f:
        body = json.load(f)
    point = body["checkpoint"]
    if point["head_hash"] != head:
        return False
    checker = spark.sparkContext._jvm.java.security.Signature.getInstance("SHA256withECDSA")
    checker.initVerify(_key(spark, public_key, False))
    checker.update(checkpoint_text(point["chain_index"], point["head_hash"], point["created_at"]).encode())
    return bool(checker.verify(base64.b64decode(body["signature"])))
