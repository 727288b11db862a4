"""Canonical JSON: one byte sequence for every way to write an event.

Keys in byte order, no white space, numbers as 64-bit floats in their shortest form,
``< > &`` and the line separators escaped, RFC 3339 strings that are values of objects
brought to UTC seconds, and the top-level sealing fields left out. This is a vectorised
Python function because Spark's own writer differs in numbers, escapes and duplicate keys.
"""

from __future__ import annotations

import json
import math
import re
from datetime import datetime, timezone
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEAL_FIELDS = ("hash", "hash_prev", "hash_chain_index")
_TIME = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:[.,]\d+)?(Z|[+-]\d{2}:\d{2})")
_ESCAPED = re.compile('["\\\\\x00-\x1f<>&  \ud800-\udfff]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


class NotJson(ValueError):
    pass


def number(x: float) -> str:
    """Shortest digits; exponents only from 1e21 up and below 1e-6."""
    if not math.isfinite(x):
        raise NotJson("number out of range")
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if 1e-6 <= abs(x) < 1e21:
        text = format(Decimal(repr(x)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    sign, ds, exponent = Decimal(repr(x)).normalize().as_tuple()
    digits = "".join(map(str, ds))
    power = exponent + len(digits) - 1
    return f"{'-' if sign else ''}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if power >= 0 else '-'}{abs(power)}"


def string(text: str) -> str:
    def escape(m: re.Match) -> str:
        c = m.group()
        if c in _SHORT:
            return _SHORT[c]
        return "�" if "\ud800" <= c <= "\udfff" else f"\\u{ord(c):04x}"

    return f'"{_ESCAPED.sub(escape, text)}"'


def utc_seconds(text: str) -> str:
    """An RFC 3339 text in UTC without its fraction; other texts as they are."""
    m = _TIME.fullmatch(text)
    if not m:
        return text
    try:
        t = datetime.fromisoformat(m[1] + m[2].replace("Z", "+00:00"))
        return t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except (ValueError, OverflowError):
        return text


def _write(x: object, times: bool) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return number(float(x))
    if isinstance(x, str):
        return string(utc_seconds(x) if times else x)
    if isinstance(x, list):
        return "[" + ",".join(_write(v, times and isinstance(v, dict)) for v in x) + "]"
    return "{" + ",".join(f"{string(k)}:{_write(x[k], times)}" for k in sorted(x, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"


def _refuse(name: str) -> float:
    raise NotJson(f"{name} is no JSON")


def load(text: str) -> object:
    try:
        return json.loads(text, parse_int=float, parse_constant=_refuse)
    except RecursionError as e:
        raise NotJson("nested too deeply") from e


def canonical(text: str, drop: tuple[str, ...] = SEAL_FIELDS) -> str:
    """Canonical form of one event; raises NotJson or JSONDecodeError for anything but an object or null."""
    data = load(text)
    if data is None:
        data = {}
    if not isinstance(data, dict):
        raise NotJson("not an object")
    return _write({k: v for k, v in data.items() if k not in drop}, True)


def plain(text: str, add: dict[str, object] | None = None) -> str:
    """The event with ``add``, keys sorted and escapes as above, times and sealing fields as they are."""
    data = load(text) or {}
    return _write({**data, **(add or {})}, False)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Column form of canonical(); null where the text is no event."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(t)
        except ValueError:
            return None

    return text.map(one)
