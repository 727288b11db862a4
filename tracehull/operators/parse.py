"""Raw audit-log lines to events: pgAudit text, PostgreSQL JSON, Percona JSON and XML.

A parser adds one struct column to a table of lines: ``outcome`` (OK, SKIP or
PARSE_ERROR), ``reason`` and the fields of an event; parsers are registered by name. It
works in a few projections, so that what several fields need is worked out once; all of
them run in one stage, without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sqltext, timestamps
from ..schemas import PARSED_EVENT

#: (lines, emit_raw) -> lines with the struct ``_event``; names that start with ``_p`` are the parser's own.
Parser = Callable[[DataFrame, bool], DataFrame]
PARSERS: dict[str, Parser] = {}


def register(*names: str):
    """Register a parser under exact names."""

    def add(parser: Parser) -> Parser:
        PARSERS.update(dict.fromkeys(names, parser))
        return parser

    return add


def parser(name: str) -> Parser:
    if name not in PARSERS:
        raise ValueError(f"unsupported database: {name}")
    return PARSERS[name]


def _finish(df: DataFrame, outcome: Column, reason: Column, **fields: Column) -> DataFrame:
    columns = [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PARSED_EVENT.fields if f.name != "event_id"]
    event = F.struct(outcome.alias("outcome"), reason.cast("string").alias("reason"), *columns)
    return df.withColumn("_event", event).drop(*[c for c in df.columns if c.startswith("_p")])


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("long"))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r'^"+|"+$', "")


# PostgreSQL ---------------------------------------------------------------------

_CSV_NAMES = ("audit_class", "session_id", "command_id", "action", "statement_type", "object_type", "object_name", "query", "parameters")


def _word_after(line: Column, *marks: str) -> Column:
    """The word after the first of ``marks`` that has one, without quotes and separators; the marks' order decides, not their place."""
    words = []
    for mark in marks:
        found = F.regexp_extract(line, rf"(?is)^.*?{mark}[ \"']*\s*(\S+)", 1)
        words.append(_some(F.regexp_replace(found, r"^[\",;]+|[\",;]+$", "")))
    return F.coalesce(*words)


def line_user(line: Column) -> Column:
    return _word_after(line, "user=", "user:", 'user "')


def line_database(line: Column) -> Column:
    return _word_after(line, "db=", "database=", 'db "')


def with_audit_fields(df: DataFrame, line: str, name: str) -> DataFrame:
    """``df`` with the STRUCT of the fields after ``AUDIT:``, trimmed; null unless there are at least five."""
    at = F.instr(line, "AUDIT:")
    tail = F.when(at > 0, F.trim(F.substring(F.col(line), at + len("AUDIT:"), F.length(line))))
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "nullValue": "\x00", "emptyValue": "", "maxCharsPerColumn": "-1", "unescapedQuoteHandling": "STOP_AT_DELIMITER"}
    df = df.withColumn(f"{name}0", F.from_csv(tail, F.lit(", ".join(f"{n} string" for n in _CSV_NAMES)), options))
    fields = F.struct(*[F.trim(F.col(f"{name}0.{n}")).alias(n) for n in _CSV_NAMES])
    return df.withColumn(name, F.when(F.col(f"{name}0.statement_type").isNotNull(), fields)).drop(f"{name}0")


def statement_texts(line: Column, query: Column) -> Column:
    """Texts that may hold the statement, best first: quoted ones from the right, the query field, what follows ``statement:``."""
    quoted = F.reverse(F.regexp_extract_all(line, F.lit(r'"((?s:.*?))"(?:,|\z)'), F.lit(1)))
    after = F.regexp_extract(line, r"(?is)^.*?statement:(.*)\z", 1)
    return F.filter(F.transform(F.concat(quoted, F.array(query, after)), _unquoted), lambda x: x != "")


@register("postgres", "pg", "postgresql")
def parse_postgres(lines: DataFrame, emit_raw: bool = False) -> DataFrame:
    df = lines.withColumn("_pt", F.trim("line"))
    df = with_audit_fields(df, "_pt", "_pcsv")
    df = df.withColumns({"_plow": F.lower("_pt"), "_pstamp": timestamps.leading_timestamp(F.col("_pt")), "_puser": line_user(F.col("_pt")), "_pdb": line_database(F.col("_pt"))})
    df = timestamps.with_normal_time(df.withColumn("_ptexts", statement_texts(F.col("_pt"), F.col("_pcsv.query"))), "_pstamp", "_ptime")
    low = F.col("_plow")
    login = F.when(low.contains("connection authorized"), "LOGIN_SUCCESS").when(low.contains("connection failed"), "LOGIN_FAILURE").when(low.contains("disconnection"), "LOGOUT")
    df = df.withColumn("_plogin", login)
    df = df.withColumn("_psql", F.when(F.col("_plogin").isNull(), F.get(F.filter("_ptexts", sqltext.looks_like_sql), F.lit(0))))
    df = sqltext.with_classes(df, "_psql", "_p")
    signed_in, found = F.col("_plogin").isNotNull(), F.col("_psql").isNotNull()
    csv = lambda name: F.when(found, _some(F.col(f"_pcsv.{name}")))
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), csv(n).alias("v")) for n in ("object_type", "object_name")]), lambda p: p["v"].isNotNull())
    return _finish(
        df, F.when(signed_in | found, "OK").otherwise("SKIP"), F.when(~(signed_in | found), F.when(F.coalesce("_pt", F.lit("")) == "", "empty line").otherwise("no statement")),
        timestamp=F.col("_ptime"), db_system=F.lit("postgres"), db_user=F.col("_puser"), db_name=F.when(F.coalesce(F.col("_plogin") != "LOGIN_FAILURE", F.lit(True)), F.col("_pdb")),
        query_type=F.when(signed_in, F.col("_plogin")).otherwise(F.col("_ptype")), raw_query=F.when(signed_in, F.col("_pt")).otherwise(F.col("_psql")) if emit_raw else F.lit(None),
        bulk=F.col("_pbulk.bulk"), bulk_type=F.col("_pbulk.bulk_type"), full_table_read=F.col("_pbulk.full_table_read"),
        audit_class=csv("audit_class"), session_id=_number(csv("session_id")), command_id=_number(csv("command_id")), action=csv("action"), statement_type=csv("statement_type"),
        meta=F.when(F.size(pairs) > 0, F.map_from_entries(pairs)),
    )


def statement_mismatch() -> Column:
    """True where an event's own statement type disagrees with its query type."""
    return F.coalesce(F.col("statement_type").isNotNull() & (sqltext.statement_type(F.col("statement_type")) != F.upper("query_type")), F.lit(False))


@register("postgres_json")
def parse_postgres_json(lines: DataFrame, emit_raw: bool = False) -> DataFrame:
    """JSON log lines; each field may stand under any of its names."""
    df = lines.withColumn("_pt", F.trim("line"))
    first = lambda *names: F.coalesce(*[_some(F.get_json_object("_pt", f"$.{n}")) for n in names])
    df = df.withColumns({"_psql": first("query", "statement", "sql", "statement_text", "query_text"), "_pstamp": first("timestamp", "time", "ts", "log_time", "datetime")})
    df = sqltext.with_classes(df.withColumn("_pok", F.col("_psql").isNotNull() & sqltext.looks_like_sql(F.col("_psql"))), "_psql", "_p")
    df = timestamps.with_normal_time(df, "_pstamp", "_ptime")
    return _finish(
        df, F.when(F.col("_pok"), "OK").otherwise("SKIP"), F.when(~F.col("_pok"), "no statement"),
        timestamp=F.col("_ptime"), db_system=F.lit("postgres"), db_user=first("user", "username", "db_user"), db_name=first("db", "database", "db_name"),
        client_ip=first("host", "client_ip", "remote_host"), query_type=F.col("_ptype"), raw_query=F.col("_psql") if emit_raw else F.lit(None),
        bulk=F.col("_pbulk.bulk"), bulk_type=F.col("_pbulk.bulk_type"), full_table_read=F.col("_pbulk.full_table_read"),
    )


# MySQL --------------------------------------------------------------------------

#: FIXED VALUES. Query types by the log's command class.
COMMAND_TYPES = {
    "select": "SELECT", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE",
    "create": "CREATE", "create_db": "CREATE", "create_table": "CREATE", "create_index": "CREATE",
    "alter": "ALTER", "alter_table": "ALTER", "drop": "DROP", "drop_db": "DROP", "drop_table": "DROP",
    "grant": "GRANT", "revoke": "REVOKE", "load_data": "LOAD_DATA", "show": "SHOW", "prepare": "EXEC", "deallocate": "EXEC", "quit": "LOGOUT",
}


def command_type(cmd: Column, name: Column, up: Column, raised: Column, detected: Column, status: Column) -> Column:
    """Query type of a MySQL record: command class first, then record name (both trimmed, in lower case), then the statement."""
    out = F.when(cmd.isin("create", "create_db", "create_table", "create_index") & up.startswith("CREATE USER") & raised, "CREATE_USER_ESCALATION")
    out = out.when(cmd.isin("alter", "alter_table") & up.startswith("ALTER USER") & raised, "ALTER_USER_ESCALATION")
    out = out.when((cmd == "grant") & raised, "GRANT_ESCALATION").when((cmd == "revoke") & raised, "REVOKE_ESCALATION")
    for kind in dict.fromkeys(COMMAND_TYPES.values()):
        out = out.when(cmd.isin([c for c, k in COMMAND_TYPES.items() if k == kind]), kind)
    out = out.when(cmd == "connect", F.when(status != 0, "LOGIN_FAILURE").otherwise("LOGIN_SUCCESS")).when(cmd == "error", detected)
    return out.when(name == "query", detected).when(name == "connect", "LOGIN_SUCCESS").when(name == "quit", "LOGOUT").otherwise(detected)


def account_name(user: Column) -> Column:
    """``root`` of ``root[root] @ localhost []``; else the first word."""
    return F.when(F.instr(user, "[") > 1, F.trim(F.substring_index(user, "[", 1))).otherwise(F.regexp_extract(user, r"^\s*(\S+)", 1))


_RECORD = ("name", "record", "timestamp", "command_class", "connection_id", "status", "sqltext", "user", "host", "os_user", "ip", "db")


@register("mysql", "percona")
def parse_mysql(lines: DataFrame, emit_raw: bool = False) -> DataFrame:
    """Percona records: a JSON object with ``audit_record``, or one AUDIT_RECORD element on a line."""
    df = lines.withColumn("_pt", F.trim("line"))
    tag = F.col("_pt").rlike(r"^<AUDIT_RECORD[\s/>]")
    df = df.withColumns(
        {
            "_pnested": F.when(F.col("_pt").startswith("{"), F.get_json_object("_pt", "$.audit_record")),
            "_pjson": F.from_json("_pt", "audit_record struct<" + ",".join(f"{n}:string" for n in _RECORD) + ">"),
            "_pxml": F.from_xml(F.when(tag, F.col("_pt")), ", ".join(f"_{n.upper()} string" for n in _RECORD if n != "os_user")),
        }
    )
    blank = lambda c: F.coalesce(c, F.lit(""))
    json_row = F.struct(*[F.trim(blank(F.col(f"_pjson.audit_record.{n}"))).alias(n) for n in _RECORD])
    xml_row = F.struct(*[(F.lit("") if n == "os_user" else blank(F.col(f"_pxml._{n.upper()}"))).alias(n) for n in _RECORD])
    df = df.withColumn("_prow", F.when(F.col("_pnested").startswith("{"), json_row).when(tag & F.col("_pxml").isNotNull(), xml_row))
    row = lambda n: F.col(f"_prow.{n}")
    df = df.withColumns({"_psql": row("sqltext"), "_pstatus": _number(row("status")), "_pstamp": row("timestamp"), "_pcmd": F.lower(F.trim(row("command_class"))), "_pname": F.lower(F.trim(row("name")))})
    df = timestamps.with_normal_time(sqltext.with_classes(df, "_psql", "_p", "mysql"), "_pstamp", "_ptime").withColumnRenamed("_ptype", "_pdetected")
    df = df.withColumn("_praised", sqltext.escalates(F.col("_praw")))
    df = df.withColumn("_ptype", command_type(*[F.col(f"_p{n}") for n in ("cmd", "name", "raw", "raised", "detected", "status")]))
    found, broken = F.col("_prow").isNotNull(), F.col("_pnested").isNotNull()
    return _finish(
        df, F.when(found, "OK").when(broken, "PARSE_ERROR").otherwise("SKIP"), F.when(found, None).when(broken, "audit_record is no object").otherwise("no audit record"),
        timestamp=F.col("_ptime"), db_system=F.lit("mysql"), db_user=_some(account_name(row("user"))), db_name=_some(row("db")), client_ip=F.coalesce(_some(row("ip")), _some(row("host"))),
        query_type=F.col("_ptype"), raw_query=_some(F.col("_psql")) if emit_raw else F.lit(None), bulk=F.col("_pbulk.bulk"), bulk_type=F.col("_pbulk.bulk_type"), full_table_read=F.col("_pbulk.full_table_read"),
        connection_id=_number(row("connection_id")), status=F.col("_pstatus"),
        meta=F.when(found, F.create_map(F.lit("record"), row("record"), F.lit("name"), row("name"), F.lit("os_user"), row("os_user"))),
    )


# Runs ---------------------------------------------------------------------------


def parse(lines: DataFrame, database: str, emit_raw: bool = False, event_ids: str = "uuid") -> DataFrame:
    """``lines`` (with a ``line`` column) and their outcome, reason and event fields.

    event_ids: "uuid" for random ids, "hash" for ids that a rerun repeats (from all other columns and the line).
    """
    parsed = parser(database)(lines, emit_raw).select("*", "_event.*").drop("_event")
    own = [F.to_json(F.struct(F.col(c))) for c in lines.columns]
    made = F.uuid() if event_ids == "uuid" else F.sha2(F.concat_ws("|", *own), 256)
    ok = F.count_if(F.col("outcome") == "OK")
    # Observed counters cost nothing extra, and keep filters on the results from being copied into every step before.
    return parsed.withColumn("event_id", made).observe(f"parse-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("raw_count"), ok.alias("parsed_count"))


def events(parsed: DataFrame) -> DataFrame:
    """Parsed events in the order of PARSED_EVENT, beside the columns that order lines."""
    return parsed.where("outcome = 'OK'").select(*[f.name for f in PARSED_EVENT.fields], *[c for c in parsed.columns if c.startswith("_")])


def rejects(parsed: DataFrame, now: Column | None = None) -> DataFrame:
    """Lines that gave no event, as SKIP or PARSE_ERROR events that carry the line."""
    own = {"event_id": F.col("event_id"), "timestamp": timestamps.rfc3339(F.current_timestamp() if now is None else now), "query_type": F.col("outcome"), "raw_query": F.col("line")}
    fields = [own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in PARSED_EVENT.fields]
    return parsed.where("outcome <> 'OK'").select(*fields, *[c for c in parsed.columns if c.startswith("_")])


def counters(parsed: DataFrame) -> DataFrame:
    """One row: raw_count, parsed_count, rejected_count."""
    return parsed.agg(F.count(F.lit(1)).alias("raw_count"), F.count_if(F.col("outcome") == "OK").alias("parsed_count"), F.count_if(F.col("outcome") != "OK").alias("rejected_count"))
