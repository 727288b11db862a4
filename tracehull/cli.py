"""Command line: parse, enrich, verify, query, dict validate, generate load and run, version."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .functions import timestamps
from .operators import query as querying
from .plans import generate, pipeline
from .sources import catalogue

VERSION = "0.1.0"
log = logging.getLogger("tracehull")


def listed(text: str) -> list[str]:
    """Parts of a comma list, trimmed, without empty ones."""
    return [x.strip() for x in text.split(",") if x.strip()]


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracehull")
    top.add_argument("--config", default="")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("parse")
    p.add_argument("--db", required=True)
    p.add_argument("--input", required=True, nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--reject-file", default="")
    p.add_argument("--emit-raw", action="store_true")
    p = sub.add_parser("enrich")
    for name in ("schema", "dict", "risk", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--input", required=True, nargs="+")
    p.add_argument("--emit-unknown", action="store_true")
    p.add_argument("--debug", action="store_true")
    p = sub.add_parser("verify")
    p.add_argument("--input", required=True)
    p.add_argument("--output", default="")
    p.add_argument("--checkpoint", action="store_true")
    for name in ("private-key", "public-key", "checkpoint-path", "initial-head"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--summary", action="store_true")
    p.add_argument("--detailed", action="store_true")
    p = sub.add_parser("query")
    p.add_argument("--input", required=True, nargs="+")
    p.add_argument("--output", default="")
    for name in ("sensitivity", "user", "ip", "type", "bulk-type", "filter", "since", "last"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--bulk", action="store_true")
    p.add_argument("--exclude-errors", action="store_true")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--summary", action="store_true")
    p = sub.add_parser("dict")
    p.add_argument("action", choices=["validate"])
    p.add_argument("--dict", required=True)
    p.add_argument("--risk", required=True)
    p = sub.add_parser("generate")
    p.add_argument("action", choices=["load", "run"])
    p.add_argument("--config-file", default="")
    p.add_argument("--output", required=True)
    sub.add_parser("version")
    return top


def question(a: argparse.Namespace) -> querying.Query:
    if a.since and a.last:
        raise SystemExit("--since and --last exclude each other")
    return querying.Query(
        listed(a.sensitivity), a.user, a.ip, listed(a.type), a.bulk, a.bulk_type, listed(a.filter), timestamps.parse_time(a.since) if a.since else None,
        timestamps.parse_duration(a.last) if a.last else None, a.exclude_errors, a.limit,
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    if a.command == "version":
        print(f"tracehull {VERSION}")
        return 0
    if a.command == "dict":
        rules = catalogue.Dictionary.load(a.dict)
        policy = catalogue.RiskPolicy.load(a.risk).check(rules.categories)
        print(f"valid: {len(rules.categories)} categories, {len(rules.rules)} rules, {len(rules.negatives)} negative rules, {len(policy.base)} base levels")
        for name in policy.unreachable():
            print(f"warning: combination {name} is not in sorted order and cannot match", file=sys.stderr)
        return 0
    spark = spark or SparkSession.builder.appName("tracehull").getOrCreate()
    settings = catalogue.Settings.load(a.config) if a.command in ("parse", "enrich", "verify") else catalogue.Settings()
    logging.basicConfig(level=settings.log_level.upper())
    if a.command == "parse":
        print(pipeline.run_parse(spark, a.db, a.input, a.output, a.reject_file or settings.reject_file, a.emit_raw, settings.run_log))
    elif a.command == "enrich":
        print(pipeline.run_enrich(spark, a.input, a.output, a.schema, a.dict, a.risk, a.emit_unknown, a.debug, settings.run_log))
    elif a.command == "verify":
        settings.private_key_path = a.private_key or settings.private_key_path
        settings.public_key_path = a.public_key or settings.public_key_path
        settings.checkpoint_path = a.checkpoint_path or settings.checkpoint_path
        if a.output:
            v = pipeline.run_hash(spark, a.input, a.output, settings, a.checkpoint)
        else:
            v = pipeline.run_verify(spark, a.input, settings, settings.checkpoint_path if a.checkpoint else "", a.initial_head or "0" * 64, a.summary)
        if a.summary or a.detailed:
            print(f"{v.status}: {v.events_processed} events, {len(v.tampered_events)} tampered" + (f" {v.tampered_events}" if a.detailed else ""))
    elif a.command == "query":
        out = pipeline.run_query(spark, a.input, question(a), a.output, a.summary)
        if a.summary:
            print(querying.summary_text(out), file=sys.stderr, end="")
    elif a.action == "load":
        config = generate.load_config(a.config_file, generate.LoadConfig) if a.config_file else generate.LoadConfig()
        generate.write_seed(spark, a.output, config)
    else:
        config = generate.load_config(a.config_file, generate.RunConfig) if a.config_file else generate.RunConfig()
        generate.audit_lines(generate.workload(spark, config), config.driver).select("line").write.mode("overwrite").text(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
