"""Questions to enriched events: filters, ordered limit, summaries and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import timestamps


def category_of(entry: Column) -> Column:
    """What stands before the first colon of a label; all of it without one."""
    return F.substring_index(entry, ":", 1)


def field_of(entry: Column) -> Column:
    """What follows the first colon of a label; null without one."""
    return F.when(entry.contains(":"), F.substring(entry, F.instr(entry, ":") + 1, F.length(entry)))


def _lowered(values: Sequence[str]) -> list[str]:
    return [v.lower() for v in values]


def _one_of(column: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.lower(column).isin(_lowered(values)), F.lit(False))


def by_sensitivity(categories: Sequence[str]) -> Column:
    return F.coalesce(F.exists("sensitivity", lambda e: F.lower(category_of(e)).isin(_lowered(categories))), F.lit(False))


def by_field(names: Sequence[str]) -> Column:
    return F.coalesce(F.exists("sensitivity", lambda e: F.coalesce(F.lower(field_of(e)).isin(_lowered(names)), F.lit(False))), F.lit(False))


def by_user(user: str) -> Column:
    return _one_of("db_user", [user])


def by_ip(ip: str) -> Column:
    return _one_of("client_ip", [ip])


def by_type(types: Sequence[str]) -> Column:
    return _one_of("query_type", types)


def by_bulk() -> Column:
    return F.coalesce(F.col("bulk"), F.lit(False))


def by_bulk_type(kind: str) -> Column:
    return _one_of("bulk_type", [kind])


def event_time() -> Column:
    return timestamps.event_time(F.col("timestamp"))


def since(moment: datetime) -> Column:
    return F.coalesce(event_time() >= F.lit(moment), F.lit(False))


def without_errors() -> Column:
    return F.coalesce(F.lower("query_type") != "error", F.lit(True))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass
class Query:
    """A question; conditions are joined by AND, empty ones do not filter, ``limit`` of 0 or less means no limit."""

    sensitivity: Sequence[str] = ()
    user: str = ""
    ip: str = ""
    types: Sequence[str] = ()
    bulk: bool = False
    bulk_type: str = ""
    fields: Sequence[str] = ()
    since: datetime | None = None
    last: timedelta | None = None
    exclude_errors: bool = False
    limit: int = 0
    now: datetime | None = None
    extra: Sequence[Column] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.since and self.last:
            raise ValueError("since and last exclude each other")

    def condition(self) -> Column:
        parts = []
        if self.sensitivity:
            parts.append(by_sensitivity(self.sensitivity))
        if self.user:
            parts.append(by_user(self.user))
        if self.ip:
            parts.append(by_ip(self.ip))
        if self.types:
            parts.append(by_type(self.types))
        if self.bulk:
            parts.append(by_bulk())
        if self.bulk_type:
            parts.append(by_bulk_type(self.bulk_type))
        if self.fields:
            parts.append(by_field(self.fields))
        if self.since:
            parts.append(since(self.since))
        elif self.last and self.last > timedelta(0):
            parts.append(since((self.now or datetime.now(timezone.utc)) - self.last))
        if self.exclude_errors:
            parts.append(without_errors())
        return all_of([*parts, *self.extra])

    def run(self, events: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """Matching events; with a limit the first ones by ``order``."""
        out = events.where(self.condition())
        if self.limit > 0:
            out = out.orderBy(*order).limit(self.limit) if order else out.limit(self.limit)
        return out


def consumed(events: DataFrame, query: Query, order: Sequence[str]) -> DataFrame:
    """Events up to the one that fills the query's limit: what a reader that stops early has seen."""
    if query.limit <= 0:
        return events
    last = query.run(events, order).select(F.struct(*order).alias("_o")).agg(F.max("_o").alias("_last"), F.count(F.lit(1)).alias("_n"))
    within = (F.col("_n") < query.limit) | (F.struct(*order) <= F.col("_last"))
    return events.crossJoin(F.broadcast(last)).where(within).drop("_last", "_n")


def totals(events: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row: input_events, matched_events, error_events, bulk_operations, first_timestamp, last_timestamp."""
    hit = F.lit(True) if condition is None else condition
    bad = F.col("_bad") if "_bad" in events.columns else F.lit(False)
    hit = hit & ~bad
    moment = F.when(hit, event_time())
    return events.agg(
        F.count_if(~bad).alias("input_events"), F.count_if(hit).alias("matched_events"), F.count_if(bad).alias("error_events"), F.count_if(hit & by_bulk()).alias("bulk_operations"),
        F.min(moment).alias("first_timestamp"), F.max(moment).alias("last_timestamp"),
    )


def counts(events: DataFrame) -> DataFrame:
    """(dimension, key, n) for sensitivity (entries, not events), query_type and risk_level, in one shuffle."""
    entry = lambda d, k: F.struct(F.lit(d).alias("dimension"), k.alias("key"))
    labels = F.coalesce(F.transform("sensitivity", lambda e: entry("sensitivity", category_of(e))), F.array().cast("array<struct<dimension:string,key:string>>"))
    rows = events.select(F.explode(F.concat(labels, F.array(entry("query_type", F.col("query_type")), entry("risk_level", F.col("risk_level"))))).alias("r"))
    return rows.select("r.*").where("key IS NOT NULL AND (dimension <> 'sensitivity' OR key <> '')").groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n")).orderBy("dimension", F.desc("n"), "key")


def summary(events: DataFrame, query: Query | None = None, order: Sequence[str] = ()) -> dict:
    """Summary as a dictionary; with a limit it covers what was read until the limit was filled."""
    query = query or Query()
    seen = consumed(events, query, order) if query.limit > 0 and order else events
    row = totals(seen, query.condition()).first()
    bad = F.col("_bad") if "_bad" in seen.columns else F.lit(False)
    out = {"total_events_processed": row["input_events"], "matched_events": row["matched_events"], "error_events": row["error_events"], "by_sensitivity": {}, "by_query_type": {}, "by_risk_level": {}, "bulk_operations": row["bulk_operations"]}
    for r in counts(seen.where(query.condition() & ~bad)).collect():
        out[f"by_{r['dimension']}"][r["key"]] = r["n"]
    if row["first_timestamp"]:
        shown = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
        out["time_range"] = {"start": shown(row["first_timestamp"]), "end": shown(row["last_timestamp"])}
    return out


def summary_text(s: dict) -> str:
    """The summary as lines for people; empty sections are left out."""
    lines = ["Summary:", f"  Total events processed: {s['total_events_processed']}"]
    if "time_range" in s:
        lines.append(f"  Time range: {s['time_range']['start']} to {s['time_range']['end']}")
    lines += [f"  Matched: {s['matched_events']}", ""]
    for title, key in (("By sensitivity", "by_sensitivity"), ("By query type", "by_query_type"), ("By risk level", "by_risk_level")):
        if s[key]:
            lines += [f"  {title}:", *[f"    {k}: {n}" for k, n in sorted(s[key].items(), key=lambda x: (-x[1], x[0]))], ""]
    if s["bulk_operations"]:
        lines.append(f"  Bulk operations: {s['bulk_operations']}")
    return "\n".join(lines).rstrip("\n") + "\n"


# Reports ------------------------------------------------------------------------


def _entries(events: DataFrame) -> DataFrame:
    return events.select("*", F.explode("sensitivity").alias("entry"))


def events_by_category(events: DataFrame) -> DataFrame:
    """Events with a label of each category (an event counts once a category)."""
    once = F.array_distinct(F.transform("sensitivity", category_of))
    return events.select(F.explode(once).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def events_by_risk(events: DataFrame) -> DataFrame:
    return events.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def top_columns(events: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` labels that occur most."""
    return _entries(events).groupBy(F.col("entry").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(k)


def users_with_sensitive(events: DataFrame) -> DataFrame:
    return events.where(F.size("sensitivity") > 0).groupBy("db_user").agg(F.count(F.lit(1)).alias("n"))


def bulk_by_type(events: DataFrame) -> DataFrame:
    return events.where(by_bulk()).groupBy("bulk_type").agg(F.count(F.lit(1)).alias("n"))


def risk_timeline(events: DataFrame, levels: Sequence[str] = ("high", "critical")) -> DataFrame:
    """Risky events as CSV fields, in order of time."""
    rows = events.where(F.col("risk_level").isin(list(levels)))
    return rows.select("timestamp", "db_user", "query_type", "risk_level", F.array_join("sensitivity", ",").alias("labels")).orderBy("timestamp", "db_user", "labels")
