"""Text and NDJSON sources that keep the order of their lines, and their sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import ENRICHED_FIELDS, HASH_FIELDS, PARSED_EVENT

#: Columns that order lines: the file's place in the caller's list, the split's start, and the line's place in the split.
ORDER = ("_file_no", "_split", "_line_no")
EVENT_SCHEMA = T.StructType([*PARSED_EVENT.fields, *ENRICHED_FIELDS, *HASH_FIELDS])


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files as ``line``, with the columns of ORDER; lines have no length limit."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = []
    for i, path in enumerate(paths):
        raw = spark.read.text(path)
        frames.append(raw.select(F.col("value").alias("line"), F.lit(i).alias("_file_no"), F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("_split"), F.monotonically_increasing_id().alias("_line_no")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """Paths that Spark can open, and those that are missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there, missing = [], []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        (there if path.getFileSystem(conf).globStatus(path) else missing).append(p)
    return there, missing


def json_kind(raw: Column, name: str) -> Column:
    """JSON type of a top-level field: ``STRING``, ``BOOLEAN``, ``ARRAY<...>`` and so on; null if it is absent or the text is no JSON."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{name}", "variant"))


def parse_events(lines: DataFrame, strict_types: bool = True) -> DataFrame:
    """Known fields of NDJSON ``lines`` beside ``_raw``; ``_bad`` is true where a line is not a JSON object or null.

    With ``strict_types`` a field counts only if it has its exact JSON type, so a bulk of
    "true" or a numeric user is missing. Lines without any text are dropped.
    """
    kept = lines.where(F.col("line") != "")
    # a field of another type leaves that field empty, not the line bad; only text that is no JSON object is bad
    good = F.trim("line").startswith("{") & F.get_json_object("line", "$").isNotNull()
    out = kept.select("*", F.from_json("line", EVENT_SCHEMA).alias("_e"), (~good & (F.trim("line") != "null")).alias("_bad"))
    exact = ("event_id", "timestamp", "db_system", "db_user", "db_name", "client_ip", "query_type", "raw_query", "bulk_type", "risk_level")
    columns = []
    for f in EVENT_SCHEMA.fields:
        value = F.col(f"_e.{f.name}")
        if strict_types and f.name in exact:
            # a quoted value in the text; the parser alone would also take numbers
            value = F.when(F.get_json_object("line", f"$.{f.name}").isNull() | json_kind(F.col("line"), f.name).eqNullSafe("STRING"), value)
        columns.append(value.alias(f.name))
    return out.select(F.col("line").alias("_raw"), "_bad", *ORDER, *columns)


def read_events(spark: SparkSession, paths: str | Sequence[str], strict_types: bool = True) -> DataFrame:
    return parse_events(read_lines(spark, paths), strict_types)


def to_ndjson(df: DataFrame, *names: str) -> DataFrame:
    """One JSON text a row of the named columns (all without names); null fields are left out and < > & escaped."""
    text = F.to_json(F.struct(*(names or df.columns)))
    for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return df.select(text.alias("value"))


def write_ndjson(df: DataFrame, path: str, *names: str, mode: str = "overwrite") -> None:
    to_ndjson(df, *names).write.mode(mode).text(path)


def append_run_log(path: str, entry: dict) -> None:
    """Append one JSON line to a run log on the driver; nothing without a path."""
    if path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "a") as f:
            f.write(json.dumps({k: v for k, v in entry.items() if v is not None}, sort_keys=True) + "\n")
