"""Token-id sequences as length-delimited binary records with masked checksums and an offset index.

Record: length (u64), masked checksum of those 8 bytes (u32), payload, masked checksum
of the payload (u32); all little-endian. The payload is the document's ids, in the
smallest unsigned type that holds the vocabulary. The checksum is CRC-32, masked by a
rotation and a constant so that a checksum of data that holds checksums stays useful.
Each ``.rec`` file has an ``.idx`` beside it with one fixed-size entry a record, so a
reader can take records in any order with one seek each.

Null text counts as empty (its record holds the end id alone), a null ``doc_id`` is
kept and sorts first, repeated rows give repeated records, an empty table gives no
files, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import attempt_tag, fresh_dir, map_arrow, materialize, open_fs, require
from .tokens import chunks, encoder, tokenizer_path

#: Fixed values of the mask: bits rotated, number added.
MASK_SHIFT, MASK_ADD = 15, 0xA282EAD8
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n_tokens", "<u4")])
HEAD, TAIL = 12, 4


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> MASK_SHIFT) | (crc << (32 - MASK_SHIFT))) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: memoryview, at: int) -> memoryview:
    """The payload of the record that starts at ``at``; raises if it is damaged."""
    length = bytes(data[at : at + 8])
    if len(length) < 8 or masked(length) != int.from_bytes(data[at + 8 : at + HEAD], "little"):
        raise ValueError(f"damaged record length at byte {at}")
    end = at + HEAD + int.from_bytes(length, "little")
    payload = data[at + HEAD : end]
    if end + TAIL > len(data) or masked(payload) != int.from_bytes(data[end : end + TAIL], "little"):
        raise ValueError(f"damaged record at byte {at}")
    return payload


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, dtype: str = "<u2", end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order.

    Returns the manifest, one row a file: shard (files in order), record and index
    path, documents, tokens. A retried task writes new names; only files named here count.
    """
    require(docs, "doc_id", "text")
    tokenizer = tokenizer or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tag, offset, n_docs, n_tokens = encoder(tokenizer, dtype, end_id).encode, attempt_tag(), 0, 0, 0
        width, entries, out = np.dtype(dtype).itemsize, [], None
        fs, base = open_fs(folder)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in chunks(list(zip(ids, texts, strict=True)), [len(t or "") for t in texts]):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{tag}.rec", buffer_size=1 << 20)
                for (doc_id, _), payload in zip(some, encode([t for _, t in some]), strict=True):
                    record = frame(payload)
                    out.write(record)
                    entries.append((doc_id or 0, doc_id is not None, offset, len(payload) // width))
                    offset += len(record)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(payload) // width
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{tag}.idx") as index:
                index.write(np.array(entries, INDEX).tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [int(tag.split("-")[0])], "file": [f"{folder}/{tag}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(map_arrow(ordered, write, "shard long, file string, n_docs long, n_tokens long", keeps="ids"), "manifest")


def read_records(manifest: DataFrame, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """Documents of the files in ``manifest``: doc_id, start (ids in all documents before it), n_tokens, ids_crc32, file, byte_offset; ids on demand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = open_fs(file)
                with fs.open_input_stream(f"{base}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                data_file = fs.open_input_file(f"{base}.rec")
                for lo in range(0, len(index), 512):
                    part = index[lo : lo + 512]
                    first = int(part["offset"][0])
                    upto = int(index["offset"][lo + 512]) if lo + 512 < len(index) else data_file.size()
                    data = memoryview(data_file.read_at(upto - first, first))
                    crcs, ids = [], []
                    for at, n in zip((part["offset"] - first).tolist(), part["n_tokens"].tolist(), strict=True):
                        tokens = np.frombuffer(unframe(data, at), dtype).astype("<u4")
                        if len(tokens) != n:
                            raise ValueError("the index and the record differ")
                        crcs.append(zlib.crc32(tokens))
                        if with_ids:
                            ids.append(tokens)
                    n = part["n_tokens"].astype(np.int64)
                    starts = start + np.cumsum(n) - n
                    start = int(starts[-1] + n[-1])
                    columns = {
                        "doc_id": pa.array(part["doc_id"], mask=part["has_id"] == 0),
                        "start": starts,
                        "n_tokens": n,
                        "ids_crc32": pa.array(crcs, pa.int64()),
                        "file": [file] * len(part),
                        "byte_offset": part["offset"].astype(np.int64),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, byte_offset long" + (", ids array<int>" if with_ids else "")
    return placed.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def token_records(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as record files in the shared folder and read every document back from them."""
    manifest = write_records(docs, fresh_dir(docs.sparkSession, "records"))
    return read_records(manifest)
