"""Runs that read and write files: parse, enrich, hash or verify, query; each with its run log."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import asdict
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import canonical
from ..operators import chain, enrich as enriching, parse as parsing, query as querying
from ..sources import catalogue, lines as sources

_ORDER = list(sources.ORDER)


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def utc(spark: SparkSession) -> SparkSession:
    """Event times are UTC; the session must say so."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def run_parse(spark: SparkSession, database: str, inputs: str | Sequence[str], output: str, reject_file: str = "", emit_raw: bool = False, run_log: str = "", event_ids: str = "uuid") -> dict:
    """Lines to event NDJSON; rejects are appended to their own folder."""
    parsed = parsing.parse(sources.read_lines(utc(spark), inputs), database, emit_raw, event_ids).cache()
    try:
        names = [f for f in parsing.PARSED_EVENT.fieldNames()]
        sources.write_ndjson(parsing.events(parsed).orderBy(*_ORDER), output, *names)
        if reject_file:
            sources.write_ndjson(parsing.rejects(parsed), reject_file, *names, mode="append")
        row = parsing.counters(parsed).first().asDict()
    finally:
        parsed.unpersist()
    entry = {"timestamp": _now(), "input": inputs if isinstance(inputs, str) else ",".join(inputs), "output": output, "reject_file": reject_file or None, **row}
    sources.append_run_log(run_log, entry)
    return row


def run_enrich(spark: SparkSession, inputs: str | Sequence[str], output: str, schema: str, dictionary: str, risk: str, emit_unknown: bool = False, debug: bool = False, run_log: str = "") -> dict:
    """Event NDJSON to enriched NDJSON; fields the engine does not know pass through, bad lines become ERROR events."""
    events = sources.read_events(utc(spark), inputs)
    rules, policy = catalogue.Dictionary.load(dictionary), catalogue.RiskPolicy.load(risk)
    columns = catalogue.load_schema(spark, schema)
    good = events.where(~F.col("_bad")).drop("sensitivity", "risk_level", "error")
    all_rows = enriching.enrich(good, columns, rules, policy, emit_unknown=True, debug=debug).cache()
    try:
        kept = all_rows if emit_unknown else all_rows.where(F.size("categories") > 0)
        added = ["sensitivity", "risk_level", *(["debug_info"] if debug else [])]
        errors = enriching.error_events(events.where("_bad")).select(F.to_json(F.struct("event_id", "timestamp", "query_type", "raw_query", "error")).alias("value"))
        text = _merged(kept, added).select("value")
        text.unionByName(errors).write.mode("overwrite").text(output)
        row = enriching.enrich_counters(events, all_rows, emit_unknown).first().asDict()
        row["error_events"] = events.where("_bad").count()
    finally:
        all_rows.unpersist()
    sources.append_run_log(run_log, {"stage": "enrich", "ts": _now(), "counters": row})
    return row


def _merged(rows: DataFrame, added: Sequence[str]) -> DataFrame:
    """The original JSON of each row with the added fields, keys sorted."""

    @F.pandas_udf("string")
    def merge(raw: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([canonical.plain(r, canonical.load(m)) for r, m in zip(raw, more, strict=True)], dtype=object)

    return rows.select(*[c for c in _ORDER if c in rows.columns], merge("_raw", F.to_json(F.struct(*added))).alias("value"))


def run_query(spark: SparkSession, inputs: str | Sequence[str], query: querying.Query, output: str = "", summary: bool = False) -> dict:
    """Matching events as NDJSON, and the summary as a dictionary; missing inputs count as one error each."""
    paths, missing = sources.existing_paths(utc(spark), [inputs] if isinstance(inputs, str) else list(inputs))
    if not paths:
        return {"matched_events": 0, "error_events": len(missing)}
    events = sources.read_events(spark, paths)
    if output:
        hits = query.run(events.where(~F.col("_bad")), _ORDER)
        hits.orderBy(*_ORDER).select(F.col("_raw").alias("value")).write.mode("overwrite").text(output)
    if not summary:
        return {"error_events": len(missing)}
    out = querying.summary(events, query, _ORDER)
    out["error_events"] += len(missing)
    return out


def run_hash(spark: SparkSession, inputs: str | Sequence[str], output: str, settings: catalogue.Settings | None = None, checkpoint: bool = False) -> chain.Verdict:
    """Seal events: read the state, chain, write, sign a checkpoint if asked, and only then save the state."""
    settings = settings or catalogue.Settings()
    if checkpoint and not (settings.private_key_path and os.path.exists(settings.private_key_path)):
        raise ValueError("a checkpoint needs a private key")
    if checkpoint and not settings.checkpoint_path:
        raise ValueError("a checkpoint needs a folder")
    began, state = _now(), chain.ChainState.load(settings.state_file)
    sealed = chain.seal(sources.read_lines(utc(spark), inputs), "line", _ORDER, state)
    sealed.select(F.col("sealed").alias("value")).write.mode("overwrite").text(output)
    last = sources.read_lines(spark, output)
    end = last.select(F.from_json("line", "hash string, hash_chain_index double").alias("s")).agg(F.max_by("s.hash", "s.hash_chain_index").alias("h"), F.max("s.hash_chain_index").alias("i"), F.count(F.lit(1)).alias("n")).first()
    after = chain.ChainState(int(end["i"]), end["h"]) if end["n"] else state
    path = chain.write_checkpoint(spark, settings.checkpoint_path, after, settings.private_key_path) if checkpoint else None
    after.save(settings.state_file)
    verdict = chain.Verdict("sealed", end["n"], [], head=after.last_head_hash)
    sources.append_run_log(settings.run_log, {"phase": "verify", "mode": "hash", "input_file": str(inputs), "output_file": output, "events_processed": end["n"], "checkpoint_path": path, "status": "sealed", "start_time": began, "end_time": _now()})
    return verdict


def run_verify(spark: SparkSession, inputs: str | Sequence[str], settings: catalogue.Settings | None = None, checkpoint: str = "", initial_head: str = chain.ZERO, summary: bool = False) -> chain.Verdict:
    """Check a sealed file; a failed check is a verdict, not an error."""
    settings = settings or catalogue.Settings()
    if checkpoint and not (settings.public_key_path and os.path.exists(settings.public_key_path) and os.path.exists(checkpoint)):
        raise ValueError("a checkpoint needs its file and a public key")
    began = _now()
    verdict = chain.verify(sources.read_lines(utc(spark), inputs), "line", _ORDER, _ORDER[:2], initial_head)
    if checkpoint:
        good = chain.verify_checkpoint(spark, checkpoint, settings.public_key_path, verdict.head)
        verdict.checkpoints_verified = int(good)
        verdict.status = verdict.status if good else "fail"
    logged = asdict(verdict) | {"phase": "verify", "mode": "verify", "input_file": str(inputs), "start_time": began, "end_time": _now()}
    logged.pop("head")
    if summary or not logged["tampered_events"]:
        logged["tampered_events"] = None
    sources.append_run_log(settings.run_log, logged)
    return verdict


def write_lake(events: DataFrame, path: str) -> None:
    """Events as Parquet by day, with lower-cased and derived columns, so that filters reach the scan."""
    moment = querying.event_time()
    lake = events.withColumns({"event_ts": moment, "event_date": F.to_date(moment), "query_type_lc": F.lower("query_type"), "db_user_lc": F.lower("db_user"), "client_ip_lc": F.lower("client_ip")})
    lake.drop("_bad", *_ORDER).write.mode("overwrite").partitionBy("event_date").parquet(path)
