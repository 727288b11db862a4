"""SQL text as Column expressions: classification, bulk operations, table and column references.

The lists and patterns under FIXED VALUES decide results and are kept as they are
specified; how they are combined is a plain expression that Catalyst can compile.
Every function takes a string Column and returns a Column; null in gives the result of
an empty text unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# FIXED VALUES -----------------------------------------------------------------

SQL_STARTS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REPLACE", "MERGE", "CREATE", "ALTER", "DROP", "RENAME",
    "BEGIN", "START TRANSACTION", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE SAVEPOINT", "GRANT", "REVOKE", "COPY",
    "LOAD DATA", "SET", "RESET", "SHOW", "VACUUM", "ANALYZE", "COMMENT", "CALL", "DO", "PREPARE", "DEALLOCATE", "EXEC", "EXECUTE",
)
SQL_PARTS = (" FROM ", " INTO ", " VALUES ")

RESERVED = (
    "SELECT FROM WHERE INSERT UPDATE DELETE JOIN INNER LEFT RIGHT FULL ON SET VALUES INTO AS AND OR ORDER BY GROUP HAVING LIMIT OFFSET "
    "UNION ALL DISTINCT COUNT SUM AVG MAX MIN NULL NOT IN EXISTS BETWEEN LIKE IS CASE WHEN THEN ELSE END"
).split()

#: Query types by the start of the statement, in order; a second name is used if the statement escalates privileges.
TYPES_BY_START = (
    (("BEGIN", "START TRANSACTION"), "TX_BEGIN", None),
    (("COMMIT",), "TX_COMMIT", None),
    (("ROLLBACK",), "TX_ROLLBACK", None),
    (("SAVEPOINT", "RELEASE SAVEPOINT"), "TX_SAVEPOINT", None),
    ((), "SELECT_INTO_OUTFILE", None),
    (("SELECT",), "SELECT", None),
    (("INSERT",), "INSERT", None),
    (("UPDATE",), "UPDATE", None),
    (("DELETE",), "DELETE", None),
    (("TRUNCATE",), "DELETE", None),
    (("REPLACE",), "INSERT", None),
    (("MERGE",), "MERGE", None),
    (("CREATE USER",), "CREATE", "CREATE_USER_ESCALATION"),
    (("ALTER USER",), "ALTER", "ALTER_USER_ESCALATION"),
    (("ALTER ROLE",), "ALTER", "ALTER_ROLE_ESCALATION"),
    (("CREATE",), "CREATE", None),
    (("ALTER",), "ALTER", None),
    (("DROP",), "DROP", None),
    (("RENAME TABLE",), "ALTER", None),
    (("GRANT",), "GRANT", "GRANT_ESCALATION"),
    (("REVOKE",), "REVOKE", "REVOKE_ESCALATION"),
    (("COPY",), "COPY", None),
    (("LOAD DATA",), "LOAD_DATA", None),
    (("SET", "RESET"), "SET", None),
    (("SHOW",), "SHOW", None),
    (("ANALYZE", "VACUUM", "COMMENT"), "UTILITY", None),
    (("CALL", "EXEC", "EXECUTE", "DO", "PREPARE", "DEALLOCATE"), "EXEC", None),
)
FILE_TARGETS = ("INTO OUTFILE", "INTO DUMPFILE")
#: Escalation: a start of the statement (or none) and texts of which groups must occur; each inner tuple offers alternatives.
ESCALATIONS = (
    ("", (("GRANT",), ("ROLE",), (" TO ",))),
    ("", (("REVOKE",), ("ROLE",), (" FROM ",))),
    ("", (("WITH ADMIN OPTION",),)),
    ("", (("WITH GRANT OPTION",),)),
    ("", (("GRANT",), ("ALL PRIVILEGES",))),
    ("ALTER USER", (("WITH SUPER", "WITH ALL PRIVILEGES", "WITH GRANT OPTION"),)),
    ("CREATE USER", (("WITH SUPER", "WITH GRANT OPTION"),)),
    ("ALTER ROLE", (("WITH SUPER", "WITH CREATEDB", "WITH CREATEROLE"),)),
)
#: Heads of a select list that read no table data.
FUNCTION_HEAD = r"(?i)^(COUNT|SUM|AVG|MIN|MAX|NOW|VERSION|USER|DATABASE|1|'[^']*')\s*\(?"
IDENT, DOTTED = r"[a-zA-Z_][a-zA-Z0-9_]*", r"[a-zA-Z_][a-zA-Z0-9_.]*"
JOIN_WORD = r"\b(?:INNER\s+|LEFT\s+|RIGHT\s+|FULL\s+)?JOIN\s+"

# Classification ----------------------------------------------------------------


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_leading_comments(sql: Column) -> Column:
    """Text after leading white space and comments; an unterminated comment leaves nothing."""
    rest = F.regexp_replace(_text(sql), r"^(?:\s++|/\*(?s:.*?)\*/|--[^\n]*+\n)++", "")
    return F.when(rest.startswith("/*") | rest.startswith("--"), F.lit("")).otherwise(F.trim(rest))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once. Where a projection of its own is at hand, use that; this runs uncompiled."""
    return F.transform(F.array(value), body)[0]


def looks_like_sql(sql: Column) -> Column:
    """True for text that starts with, or holds, what SQL does; prefixes have no word end."""
    return F.upper(strip_leading_comments(sql)).rlike("^(?:" + "|".join(SQL_STARTS) + ")|" + "|".join(SQL_PARTS))


def escalates(up: Column) -> Column:
    """Whether an upper-case statement raises privileges."""
    rules = []
    for start, groups in ESCALATIONS:
        parts = [_any([up.contains(x) for x in group]) for group in groups]
        rules.append(_all(([up.startswith(start)] if start else []) + parts))
    return _any(rules)


def is_privilege_escalation(sql: Column) -> Column:
    return let(F.upper(_text(sql)), escalates)


def type_of(up: Column, raised: Column) -> Column:
    """Type of an upper-case statement without leading comments; the first rule that holds decides, ANON if none does."""
    out = None
    for starts, name, escalated in TYPES_BY_START:
        hit = _any([up.startswith(s) for s in starts]) if starts else _any([up.contains(t) for t in FILE_TARGETS])
        value = F.when(raised, escalated).otherwise(name) if escalated else F.lit(name)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise("ANON")


def query_type(sql: Column) -> Column:
    """Canonical type of a statement."""
    return let(F.upper(strip_leading_comments(sql)), lambda up: type_of(up, escalates(up)))


def bulk_of(up: Column, dialect: str = "postgres") -> Column:
    """STRUCT<bulk, bulk_type, full_table_read> of an upper-case statement; all null where it is no bulk operation.

    postgres knows COPY, mysql LOAD DATA INFILE; the tests see the text as it is, comments included.
    """
    kind = lambda name, whole: F.struct(F.lit(True).alias("bulk"), F.lit(name).alias("bulk_type"), (F.lit(True) if whole else F.lit(None).cast("boolean")).alias("full_table_read"))
    none = F.struct(F.lit(None).cast("boolean").alias("bulk"), F.lit(None).cast("string").alias("bulk_type"), F.lit(None).cast("boolean").alias("full_table_read"))
    many = up.startswith("INSERT") & up.rlike(r"(?s)VALUES") & up.rlike(r"(?s)\),\(|\), \(|VALUES.*VALUES")
    columns = F.trim(F.regexp_extract(up, r"SELECT\s+([^\n]+?)\s+FROM", 1))
    data = up.contains("SELECT *") | (up.rlike(r"SELECT\s+[^\n]+?\s+FROM") & ~columns.rlike(FUNCTION_HEAD))
    whole = up.startswith("SELECT") & ~up.contains("WHERE") & data
    if dialect == "postgres":
        first = F.when(up.contains("COPY") & up.contains("TO"), kind("export", True)).when(up.contains("COPY") & up.contains("FROM"), kind("import", False))
    else:
        first = F.when(up.contains("LOAD DATA INFILE"), kind("import", False))
    return first.when(_any([up.contains(t) for t in FILE_TARGETS]), kind("export", True)).when(many, kind("insert", False)).when(whole, kind("export", True)).otherwise(none)


def bulk_operation(sql: Column, dialect: str = "postgres") -> Column:
    return let(F.upper(_text(sql)), lambda up: bulk_of(up, dialect))


def with_classes(df: DataFrame, sql: str, prefix: str = "_", dialect: str = "postgres") -> DataFrame:
    """``df`` with type, escalation and bulk of the statement column ``sql`` under ``prefix``; compiled, each step once."""
    df = df.withColumns({f"{prefix}bare": strip_leading_comments(F.col(sql)), f"{prefix}raw": F.upper(_text(F.col(sql)))})
    df = df.withColumn(f"{prefix}up", F.upper(f"{prefix}bare"))
    df = df.withColumn(f"{prefix}escalates", escalates(F.col(f"{prefix}up")))
    return df.withColumns({f"{prefix}type": type_of(F.col(f"{prefix}up"), F.col(f"{prefix}escalates")), f"{prefix}bulk": bulk_of(F.col(f"{prefix}raw"), dialect)}).drop(f"{prefix}bare")


# References --------------------------------------------------------------------


def clean_comments(sql: Column) -> Column:
    """Text without comments on one line, white space collapsed and trimmed."""
    c = F.regexp_replace(_text(sql), r"/\*[^\n]*?\*/", " ")
    c = F.regexp_replace(c, r"--[^\n]*(?:\n|\z)", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_reserved(word: Column) -> Column:
    return F.upper(word).isin(RESERVED)


def _table_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _pair(alias: Column, table: Column) -> Column:
    return F.struct(alias.alias("alias"), table.alias("table"))


def _aliased(q: Column, rx: str) -> Column:
    """(alias, table) of every match of a pattern with a table and an alias that is not reserved."""
    pairs = F.arrays_zip(F.regexp_extract_all(q, F.lit(rx), F.lit(2)).alias("a"), F.regexp_extract_all(q, F.lit(rx), F.lit(1)).alias("t"))
    good = F.filter(pairs, lambda p: ~is_reserved(p["a"]))
    return F.flatten(F.transform(good, lambda p: F.array(_pair(p["a"], _table_name(p["t"])), _pair(_table_name(p["t"]), _table_name(p["t"])))))


def _named(q: Column, rx: str) -> Column:
    return F.transform(F.regexp_extract_all(q, F.lit(rx), F.lit(1)), lambda t: _pair(_table_name(t), _table_name(t)))


def _one(name: Column) -> Column:
    """The single reference ``name``, or none if it is empty."""
    return F.transform(F.filter(F.array(name), lambda x: x != ""), lambda x: _pair(_table_name(x), _table_name(x)))


def table_references(q: Column) -> Column:
    """MAP<alias, table> of comment-free SQL; a table also stands under its own name, later references win."""
    empty = F.array().cast("array<struct<alias:string,table:string>>")
    insert = _one(F.regexp_extract(q, rf"(?i)\bINSERT\s+INTO\s+({DOTTED})\b", 1))
    with_alias = rf"(?i)\bUPDATE\s+({DOTTED})\s+({IDENT})\s+SET\b"

    def update(p: Column) -> Column:
        alias, table = p["alias"], p["table"]
        return (
            F.when((alias != "") & ~is_reserved(alias), F.array(_pair(alias, _table_name(table)), _pair(_table_name(table), _table_name(table))))
            .when(alias != "", empty)
            .otherwise(_one(F.regexp_extract(q, rf"(?i)\bUPDATE\s+({DOTTED})\s+SET\b", 1)))
        )

    updated = let(_pair(F.regexp_extract(q, with_alias, 2), F.regexp_extract(q, with_alias, 1)), update)
    delete = _one(F.regexp_extract(q, rf"(?i)\bDELETE\s+FROM\s+({DOTTED})\b", 1))

    def froms(found: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(_named(q, rf"(?i)\bFROM\s+({DOTTED})\b"))

    def joins(found: Column) -> Column:
        others = F.filter(_named(q, rf"(?i){JOIN_WORD}({DOTTED})\b"), lambda p: ~F.exists(found, lambda x: x["table"] == p["table"]))
        return F.concat(found, others)

    from_part = let(_aliased(q, rf"(?i)\bFROM\s+({DOTTED})\s+({IDENT})\b"), froms)
    join_part = let(_aliased(q, rf"(?i){JOIN_WORD}({DOTTED})\s+({IDENT})\b"), joins)
    return let(F.reverse(F.concat(from_part, join_part, insert, updated, delete)), last_wins)


def last_wins(from_end: Column) -> Column:
    """Map of (alias, table) pairs, given from the last one on, in which the last value of a key stays."""
    keys = F.array_distinct(F.transform(from_end, lambda p: p["alias"]))
    values = lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.element_at(F.filter(from_end, lambda p: p["alias"] == k), 1)["table"]))
    return let(keys, values)


def _listed(text: Column) -> Column:
    """Column references of a comma list: a dotted item's first token as it is, else an item's first token if it is a plain name."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "*"))
    heads = F.transform(items, lambda x: F.struct(F.element_at(F.split(x, r"\s+"), 1).alias("h"), x.contains(".").alias("d")))
    good = F.filter(heads, lambda p: p["d"] | (~is_reserved(p["h"]) & p["h"].rlike(rf"^{IDENT}\z")))
    return F.transform(good, lambda p: p["h"])


def column_references(q: Column) -> Column:
    """ARRAY<column> of comment-free SQL: select list, insert list, assignments, dotted names of the where clause; "*" alone for SELECT *."""
    up = F.upper(q)
    none = F.array().cast("array<string>")
    selected = F.regexp_extract(q, r"(?i)\bSELECT\s+(.*?)\s+FROM\b", 1)
    inserted = F.regexp_extract(q, rf"(?i)\bINSERT\s+INTO\s+{DOTTED}\s*\(\s*(.*?)\s*\)", 1)
    assigned = F.regexp_extract(q, r"(?i)\bSET\s+(.*?)(?:\s+WHERE|\s*\z)", 1)
    where = F.regexp_extract(q, r"(?i)\bWHERE\s+(.*?)(?:\s+ORDER\s+BY|\s+GROUP\s+BY|\s+HAVING|\s+LIMIT|\s*\z)", 1)
    targets = F.filter(F.transform(F.split(assigned, ","), lambda x: F.trim(F.element_at(F.split(x, "="), 1))), lambda x: x != "")
    dotted = F.filter(F.regexp_extract_all(where, F.lit(rf"\b({IDENT}\.{IDENT})\b"), F.lit(1)), lambda x: ~is_reserved(x))
    parts = F.concat(_listed(selected), _listed(inserted), F.when(up.contains("UPDATE") & up.contains("SET"), targets).otherwise(none), dotted)
    return F.when(up.contains("SELECT *"), F.array(F.lit("*"))).otherwise(parts)


def query_bulk(q: Column) -> Column:
    """STRUCT<is_bulk, bulk_type> as the reference analysis sees comment-free SQL."""
    up = F.upper(q)
    kind = lambda name: F.struct(F.lit(True).alias("is_bulk"), F.lit(name).alias("bulk_type"))
    rows = (F.length(up) - F.length(F.replace(up, F.lit("VALUES"), F.lit("")))) / len("VALUES")
    copies = up.contains("COPY ")
    return (
        F.when(copies & up.contains(" TO "), kind("export"))
        .when(copies & up.contains(" FROM "), kind("import"))
        .when(copies, kind("copy"))
        .when(up.contains("LOAD DATA"), kind("import"))
        .when(up.contains("SELECT ") & up.contains(" INTO OUTFILE"), kind("export"))
        .when(up.contains("INSERT ") & (up.contains(" SELECT ") | (rows > 1)), kind("insert"))
        .when(up.contains("SELECT *") & ~up.contains(" WHERE "), kind("select"))
        .otherwise(F.struct(F.lit(False).alias("is_bulk"), F.lit("").alias("bulk_type")))
    )


def query_refs(sql: Column) -> Column:
    """STRUCT<tables, columns, is_bulk, bulk_type> of a statement; empty text has no references."""
    return clean_refs(clean_comments(sql))


def clean_refs(q: Column) -> Column:
    """query_refs() of text that clean_comments() has been over."""
    bulk = query_bulk(q)
    return F.struct(table_references(q).alias("tables"), column_references(q).alias("columns"), bulk["is_bulk"].alias("is_bulk"), bulk["bulk_type"].alias("bulk_type"))


def statement_type(text: Column) -> Column:
    """A log's own statement type in the terms of query_type(), for comparison."""
    up = F.upper(F.trim(_text(text)))
    named = F.when(up.startswith("CREATE"), "CREATE").when(up.startswith("ALTER"), "ALTER").when(up.startswith("DROP"), "DROP")
    return named.when(up.startswith("TRUNCATE"), "DELETE").otherwise(up)


#: Type names as catalogues print them, and what they count as.
TYPE_ALIASES = {
    "CHARACTER VARYING": "VARCHAR",
    "CHARACTER": "CHAR",
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
    "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
    "DOUBLE PRECISION": "DOUBLE",
    "USER-DEFINED": "TEXT",
    "ENUM": "VARCHAR",
    "INTEGER": "INT",
}


def column_type(text: Column) -> Column:
    """A database column type in upper case, without sizes, by its common name."""
    bare = F.regexp_replace(F.upper(F.trim(_text(text))), r"\([^)]*\)", "")
    out = None
    for alias, name in TYPE_ALIASES.items():
        out = F.when(bare == alias, name) if out is None else out.when(bare == alias, name)
    return out.otherwise(bare)


def sql_escape(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit("''"))
