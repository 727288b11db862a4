"""Timestamps and durations of log lines and queries. The session time zone must be UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

#: Layouts tried after Spark's own ISO-like parsing, in order.
LAYOUTS = (
    "MMM d, yyyy h:mm:ss a",
    "MMM d, yyyy HH:mm:ss",
    "MMMM d, yyyy h:mm:ss a",
    "MMM d HH:mm:ss yyyy",
    "dd MMM yyyy HH:mm:ss Z",
    "dd/MMM/yyyy:HH:mm:ss Z",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
    "yyyy/M/d HH:mm:ss",
    "yyyy/M/d",
    "yyyyMMddHHmmss",
    "yyyyMMdd",
)
_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})?\z"


def leading_timestamp(line: Column) -> Column:
    """The timestamp text a PostgreSQL line starts with: 19 characters, or up to two words before ``LOG:``, or nothing."""
    prefix = F.substring(line, 1, 19)
    plain = prefix.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z") & F.try_to_timestamp(prefix, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    at = F.instr(line, "LOG:")
    before = F.trim(F.regexp_replace(F.substring(line, F.lit(1), at - 1), r"\s+", " "))
    return F.when(plain, prefix).when(at > 1, F.substring_index(before, " ", 2)).otherwise("")


def tidy(text: Column) -> Column:
    """Text without outer space and a leading name of the day."""
    return F.regexp_replace(F.trim(text), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +", "")


def parse_any(t: Column) -> Column:
    """TIMESTAMP of a tidy() text in any supported layout, null if there is none."""
    epoch = F.when(t.rlike(r"^\d{10}\z"), F.timestamp_seconds(t.cast("long"))).when(t.rlike(r"^\d{13}\z"), F.timestamp_millis(t.cast("long"))).when(t.rlike(r"^\d{16}\z"), F.timestamp_micros(t.cast("long")))
    iso = F.when(t.rlike(r"^\d{4}(-|$)"), F.try_to_timestamp(t))
    return F.coalesce(epoch, iso, *[F.try_to_timestamp(t, F.lit(layout)) for layout in LAYOUTS])


def rfc3339(ts: Column) -> Column:
    """UTC text with the fraction's trailing zeros cut; empty for null."""
    fraction = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z")), F.lit(""))


def with_normal_time(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the timestamp text of a column as RFC 3339 in UTC, null where it is none."""
    df = df.withColumn(f"{name}0", tidy(F.col(text)))
    df = df.withColumn(f"{name}1", parse_any(F.col(f"{name}0")))
    return df.withColumn(name, F.when(F.col(f"{name}1").isNotNull(), rfc3339(F.col(f"{name}1")))).drop(f"{name}0", f"{name}1")


def event_time(text: Column) -> Column:
    """TIMESTAMP of a stored event's timestamp text: RFC 3339 or its forms without a zone (read as UTC); null otherwise."""
    return F.when(text.rlike(_ISO), F.try_to_timestamp(text))


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> timedelta:
    """``7d`` and ``24h`` as whole numbers, else a sequence such as ``1h30m``; raises ValueError.

    Fractions of hours and mixed days are refused, as the command line always has.
    """
    if not text:
        raise ValueError("empty duration")
    if text[-1] in "dh" and re.fullmatch(r"[+-]?\d+", text[:-1]):
        n = int(text[:-1])
        if n >= 0:
            return timedelta(days=n) if text[-1] == "d" else timedelta(hours=n)
        raise ValueError(f"negative duration: {text}")
    if text[-1] == "d" or re.fullmatch(r"[+-]?\d*\.\d*h", text):
        raise ValueError(f"invalid duration: {text}")
    sign, rest = (-1, text[1:]) if text[0] == "-" else (1, text.lstrip("+"))
    parts = _PART.findall(rest)
    if not parts or "".join(n + u for n, u in parts) != rest:
        raise ValueError(f"invalid duration: {text}")
    return sign * timedelta(seconds=sum(float(n) * _UNITS[u] for n, u in parts))


def parse_time(text: str) -> datetime:
    """A query's point in time, in UTC; raises ValueError for other layouts."""
    if not re.match(_ISO.replace(r"\z", r"\Z"), text):
        raise ValueError(f"unsupported timestamp: {text}")
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
