"""More registered queries: every statement type, sources and sinks as text, risk combinations, chain continuation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sqltext, timestamps
from ..operators import chain, enrich, parse, query as q
from ..sources import catalogue, lines
from . import generate, registry
from .registry import query

# Every type, escalation and bulk form ---------------------------------------------

#: Statements by order key; {k} is the key.
KINDS = (
    "begin work", "START TRANSACTION READ ONLY", "COMMIT", "rollback to here", "SAVEPOINT s{k}", "RELEASE SAVEPOINT s{k}", "SELECT a FROM t INTO OUTFILE '/tmp/{k}'", "SELECT a INTO DUMPFILE '/tmp/{k}' FROM t",
    "select a from t where b = {k}", "INSERT INTO t (a) VALUES ({k}), ({k})", "INSERT INTO t SELECT * FROM u", "update t set a = {k}", "DELETE FROM t WHERE a = {k}", "TRUNCATE TABLE t{k}", "REPLACE INTO t VALUES ({k})",
    "MERGE INTO t USING u ON t.a = u.a", "CREATE USER bo{k}", "CREATE USER bo{k} WITH SUPER", "ALTER USER bo{k} PASSWORD 'x'", "ALTER USER bo{k} WITH ALL PRIVILEGES", "ALTER ROLE ro{k} NOLOGIN", "ALTER ROLE ro{k} WITH CREATEROLE",
    "CREATE TABLE t{k} (a int)", "ALTER TABLE t ADD COLUMN c{k} int", "DROP TABLE t{k}", "RENAME TABLE t TO t{k}", "GRANT SELECT ON t TO bo{k}", "GRANT ALL PRIVILEGES ON t TO bo{k}", "GRANT ROLE ro TO bo{k}", "GRANT ro TO bo WITH ADMIN OPTION",
    "REVOKE SELECT ON t FROM bo{k}", "REVOKE ROLE ro FROM bo{k}", "COPY t FROM '/tmp/{k}'", "COPY t TO '/tmp/{k}'", "LOAD DATA INFILE '/tmp/{k}' INTO TABLE t", "SET a = {k}", "RESET a", "SHOW TABLES", "ANALYZE t", "VACUUM t", "COMMENT ON TABLE t IS 'n{k}'",
    "CALL p({k})", "EXEC p", "EXECUTE s{k}", "DO 1", "PREPARE s AS SELECT 1", "DEALLOCATE s", "EXPLAIN SELECT {k}", "-- note {k}\nSELECT * FROM t", "/* a\nb */ DELETE FROM t", "/* never ends {k}", "SELECT COUNT(a) FROM t", "SELECT now() FROM t", "",
)


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sql."""
    o = registry.spread(registry._table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))
    text = F.element_at(F.array(*[F.lit(s) for s in KINDS]), (F.pmod("id", F.lit(len(KINDS))) + 1).cast("int"))
    return o.select("id", F.replace(text, F.lit("{k}"), F.col("id").cast("string")).alias("sql"))


_KINDS = ", ".join("'" + s.replace("'", "''") + "'" for s in KINDS)
_STARTS = (
    (("BEGIN", "START TRANSACTION"), "'TX_BEGIN'"), (("COMMIT",), "'TX_COMMIT'"), (("ROLLBACK",), "'TX_ROLLBACK'"), (("SAVEPOINT", "RELEASE SAVEPOINT"), "'TX_SAVEPOINT'"), ((), "'SELECT_INTO_OUTFILE'"), (("SELECT",), "'SELECT'"), (("INSERT",), "'INSERT'"),
    (("UPDATE",), "'UPDATE'"), (("DELETE", "TRUNCATE"), "'DELETE'"), (("REPLACE",), "'INSERT'"), (("MERGE",), "'MERGE'"), (("CREATE USER",), "if(esc, 'CREATE_USER_ESCALATION', 'CREATE')"), (("ALTER USER",), "if(esc, 'ALTER_USER_ESCALATION', 'ALTER')"),
    (("ALTER ROLE",), "if(esc, 'ALTER_ROLE_ESCALATION', 'ALTER')"), (("CREATE",), "'CREATE'"), (("ALTER", "RENAME TABLE"), "'ALTER'"), (("DROP",), "'DROP'"), (("GRANT",), "if(esc, 'GRANT_ESCALATION', 'GRANT')"), (("REVOKE",), "if(esc, 'REVOKE_ESCALATION', 'REVOKE')"),
    (("COPY",), "'COPY'"), (("LOAD DATA",), "'LOAD_DATA'"), (("SET", "RESET"), "'SET'"), (("SHOW",), "'SHOW'"), (("ANALYZE", "VACUUM", "COMMENT"), "'UTILITY'"), (("CALL", "EXEC", "DO", "PREPARE", "DEALLOCATE"), "'EXEC'"),
)
_OUTFILE = "(contains({0}, 'INTO OUTFILE') OR contains({0}, 'INTO DUMPFILE'))"
_CASES = " ".join(f"WHEN {' OR '.join(f'starts_with(u, {s!r})' for s in starts) or _OUTFILE.format('u')} THEN {kind}" for starts, kind in _STARTS)
KINDS_SQL = f"""s AS (SELECT o_orderkey AS id, replace(list_extract([{_KINDS}], CAST(o_orderkey % {len(KINDS)} AS INT) + 1), '{{k}}', CAST(o_orderkey AS VARCHAR)) AS sql FROM orders),
b AS (SELECT *, upper(trim(regexp_replace(sql, '^(\\s+|/\\*(.|\\n)*?\\*/|--[^\\n]*\\n)+', ''))) AS u0, upper(sql) AS w FROM s), b1 AS (SELECT *, if(starts_with(u0, '/*') OR starts_with(u0, '--'), '', u0) AS u FROM b),
x AS (SELECT *, (contains(u, 'GRANT') AND contains(u, 'ROLE') AND contains(u, ' TO ')) OR (contains(u, 'REVOKE') AND contains(u, 'ROLE') AND contains(u, ' FROM ')) OR contains(u, 'WITH ADMIN OPTION') OR contains(u, 'WITH GRANT OPTION')
  OR (contains(u, 'GRANT') AND contains(u, 'ALL PRIVILEGES')) OR (starts_with(u, 'ALTER USER') AND (contains(u, 'WITH SUPER') OR contains(u, 'WITH ALL PRIVILEGES')))
  OR (starts_with(u, 'CREATE USER') AND contains(u, 'WITH SUPER')) OR (starts_with(u, 'ALTER ROLE') AND (contains(u, 'WITH SUPER') OR contains(u, 'WITH CREATEDB') OR contains(u, 'WITH CREATEROLE'))) AS esc FROM b1),
t AS (SELECT *, CASE {_CASES} ELSE 'ANON' END AS query_type FROM x),
k AS (SELECT *, CASE WHEN {_OUTFILE.format("w")} THEN 'export' WHEN starts_with(w, 'INSERT') AND contains(w, 'VALUES') AND (contains(w, '),(') OR contains(w, '), (')) THEN 'insert'
  WHEN starts_with(w, 'SELECT') AND NOT contains(w, 'WHERE') AND regexp_matches(w, 'SELECT\\s+.+?\\s+FROM') AND NOT regexp_matches(w, 'SELECT\\s+(COUNT|SUM|AVG|MIN|MAX|NOW|VERSION|USER|DATABASE|1)') THEN 'export' END AS other FROM t)"""


@query("q_every_type", f"WITH {KINDS_SQL} SELECT id, query_type, esc AS escalates FROM t")
def every_type(spark, sf):
    return sqltext.with_classes(kinds(spark, sf), "sql").select("id", F.col("_type").alias("query_type"), F.col("_escalates").alias("escalates"))


@query("q_every_bulk", f"WITH {KINDS_SQL} SELECT id, CASE WHEN contains(w, 'COPY') AND contains(w, 'TO') THEN 'export' WHEN contains(w, 'COPY') AND contains(w, 'FROM') THEN 'import' ELSE other END AS postgres, CASE WHEN contains(w, 'LOAD DATA INFILE') THEN 'import' ELSE other END AS mysql FROM k")
def every_bulk(spark, sf):
    return kinds(spark, sf).select("id", *[sqltext.bulk_operation(F.col("sql"), d)["bulk_type"].alias(d) for d in ("postgres", "mysql")])


@query(
    "q_reference_bulk",
    f"""WITH {KINDS_SQL}, c AS (SELECT id, upper(trim(regexp_replace(regexp_replace(regexp_replace(sql, '/\\*[^\\n]*?\\*/', ' ', 'g'), '--[^\\n]*(\\n|$)', ' ', 'g'), '\\s+', ' ', 'g'))) AS u FROM s)
SELECT id, CASE WHEN contains(u, 'COPY ') AND contains(u, ' TO ') THEN 'export' WHEN contains(u, 'COPY ') AND contains(u, ' FROM ') THEN 'import' WHEN contains(u, 'COPY ') THEN 'copy' WHEN contains(u, 'LOAD DATA') THEN 'import'
  WHEN contains(u, 'SELECT ') AND contains(u, ' INTO OUTFILE') THEN 'export' WHEN contains(u, 'INSERT ') AND contains(u, ' SELECT ') THEN 'insert' WHEN contains(u, 'SELECT *') AND NOT contains(u, ' WHERE ') THEN 'select' ELSE '' END AS bulk_type FROM c""",
)
def reference_bulk(spark, sf):
    return kinds(spark, sf).select("id", sqltext.query_bulk(sqltext.clean_comments(F.col("sql")))["bulk_type"].alias("bulk_type"))


# Sources and sinks ----------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry._table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("nation"))


@query(
    "q_event_ndjson",
    """SELECT c_custkey AS id, '{"event_id":"e' || CAST(c_custkey AS VARCHAR) || '"' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"db_user":"' || c_name || '"' END || ',"raw_query":"SELECT \\"a\\" \\u0026 b \\u003c c \\u003e d","status":' || CAST(c_nationkey AS VARCHAR) || '}' AS value FROM customer""",
)
def event_ndjson(spark, sf):
    rows = _customers(spark, sf).select("id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), F.when(F.pmod("id", F.lit(3)) != 0, F.col("name")).alias("db_user"), F.lit('SELECT "a" & b < c > d').alias("raw_query"), F.col("nation").alias("status"))
    out = lines.to_ndjson(rows, "event_id", "db_user", "raw_query", "status")
    return out.select(F.regexp_extract("value", r'"event_id":"e(-?[0-9]+)"', 1).cast("long").alias("id"), "value")


@query(
    "q_ndjson_fields",
    """SELECT id, id % 7 IN (2, 4) AS bad, CASE WHEN id % 7 < 2 OR id % 7 = 6 THEN 'e' || CAST(id AS VARCHAR) END AS event_id, CASE WHEN id % 7 = 0 THEN 'u' END AS db_user, CASE WHEN id % 7 = 0 THEN true END AS bulk, CASE WHEN id % 7 = 6 THEN 2 END AS labels
FROM (SELECT c_custkey AS id FROM customer) WHERE id % 7 <> 5""",
)
def ndjson_fields(spark, sf):
    """Typed fields of lines, some of them of another type, broken, no object, or empty."""
    key = F.col("id").cast("string")
    made = (
        F.concat(F.lit('{"event_id":"e'), key, F.lit('","db_user":"u","bulk":true}')), F.concat(F.lit('{"event_id":"e'), key, F.lit('","db_user":7,"bulk":"true"}')), F.lit("{broken"), F.lit("null"), F.lit("[1]"), F.lit(""),
        F.concat(F.lit('{"sensitivity":["PII:a","PHI:b"],"event_id":"e'), key, F.lit('"}')),
    )
    text = F.element_at(F.array(*made), (F.pmod("id", F.lit(len(made))) + 1).cast("int"))
    rows = _customers(spark, sf).select(text.alias("line"), F.lit(0).alias("_file_no"), F.lit(0).alias("_split"), F.col("id").alias("_line_no"))
    e = lines.parse_events(rows)
    return e.select(F.col("_line_no").alias("id"), F.col("_bad").alias("bad"), "event_id", "db_user", "bulk", F.when(F.col("sensitivity").isNotNull(), F.size("sensitivity")).alias("labels"))


@query("q_sql_escape", "SELECT c_custkey AS id, replace('it''s ' || c_name || '''', '''', '''''') AS escaped FROM customer")
def sql_escape(spark, sf):
    return _customers(spark, sf).select("id", sqltext.sql_escape(F.concat(F.lit("it's "), F.col("name"), F.lit("'"))).alias("escaped"))


@query("q_insert_statements", "SELECT c_custkey AS id, 'INSERT INTO healthcare_patient (name, nation, note) VALUES (''' || c_name || ''', ' || CAST(c_nationkey AS VARCHAR) || ', NULL);' AS value FROM customer")
def insert_statements(spark, sf):
    made = generate.inserts("healthcare.patient", _customers(spark, sf).select("name", "nation", F.lit(None).cast("string").alias("note")), "mysql")
    return made.select(F.regexp_extract("value", "Customer#0*([0-9]+)", 1).cast("long").alias("id"), "value")


@query(
    "q_pg_json",
    "SELECT c_custkey AS id, 'u' || CAST(c_nationkey AS VARCHAR) AS db_user, CASE WHEN c_custkey % 2 = 0 THEN 'shop' ELSE 'till' END AS db_name, CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.9' END AS client_ip, 'SELECT' AS query_type, 'SELECT a FROM t WHERE b = ' || CAST(c_custkey AS VARCHAR) AS raw_query, '2025-01-01T00:00:00Z' AS \"timestamp\" FROM customer WHERE c_custkey % 3 <> 0",
)
def pg_json(spark, sf):
    key, user = F.col("id").cast("string"), F.concat(F.lit("u"), F.col("nation").cast("string"))
    one = F.to_json(F.struct(F.lit("2025-01-01T00:00:00Z").alias("timestamp"), user.alias("user"), F.lit("shop").alias("db"), F.lit("10.0.0.9").alias("host"), F.concat(F.lit("SELECT a FROM t WHERE b = "), key).alias("statement")))
    two = F.to_json(F.struct(F.lit("2025-01-01 00:00:00").alias("log_time"), user.alias("username"), F.lit("till").alias("database"), F.concat(F.lit("SELECT a FROM t WHERE b = "), key).alias("sql")))
    rows = _customers(spark, sf).select(F.col("id").alias("_id"), F.when(F.pmod("id", F.lit(3)) == 0, F.lit('{"note":"x"}')).when(F.pmod("id", F.lit(2)) == 0, one).otherwise(two).alias("line"))
    e = parse.events(parse.parse(rows, "postgres_json", True, "hash"))
    return e.select(F.col("_id").alias("id"), "db_user", "db_name", "client_ip", "query_type", "raw_query", "timestamp")


@query("q_event_ids", """SELECT c_custkey AS id, sha256('{"_id":' || CAST(c_custkey AS VARCHAR) || '}|{"line":"connection authorized: user=u' || CAST(c_nationkey AS VARCHAR) || '"}') AS event_id FROM customer""")
def event_ids(spark, sf):
    rows = _customers(spark, sf).select(F.col("id").alias("_id"), F.concat(F.lit("connection authorized: user=u"), F.col("nation").cast("string")).alias("line"))
    return parse.events(parse.parse(rows, "postgres", False, "hash")).select(F.col("_id").alias("id"), "event_id")


@query("q_error_events", "SELECT '{broken ' || CAST(c_custkey AS VARCHAR) AS raw_query, 'ERROR' AS query_type, '2025-01-01T00:00:00Z' AS \"timestamp\", 'enrich' AS phase, 'invalid JSON' AS message FROM customer")
def error_events(spark, sf):
    bad = _customers(spark, sf).select(F.concat(F.lit("{broken "), F.col("id").cast("string")).alias("_raw"))
    return enrich.error_events(bad, now=F.timestamp_seconds(F.lit(1_735_689_600))).select("raw_query", "query_type", "timestamp", F.col("error.phase").alias("phase"), F.col("error.message").alias("message"))


@query(
    "q_event_times",
    "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 1735689600 + c_custkey % 60 WHEN 1 THEN 1735689600 + c_custkey % 60 - 7200 WHEN 2 THEN 1735689600 + c_custkey % 60 END AS seconds FROM customer",
)
def event_times(spark, sf):
    second = F.lpad(F.pmod("id", F.lit(60)).cast("string"), 2, "0")
    made = (F.concat(F.lit("2025-01-01T00:00:"), second, F.lit("Z")), F.concat(F.lit("2025-01-01T00:00:"), second, F.lit("+02:00")), F.concat(F.lit("2025-01-01 00:00:"), second), F.lit("yesterday"), F.lit(""))
    text = F.element_at(F.array(*made), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    return _customers(spark, sf).select("id", F.unix_seconds(timestamps.event_time(text)).alias("seconds"))


# Enrichment -----------------------------------------------------------------------


@query("q_events_by_risk", f"WITH {registry.ENRICHED_SQL} SELECT risk_level, count(*) AS n FROM e GROUP BY ALL")
def events_by_risk(spark, sf):
    return q.events_by_risk(registry.enriched(spark, sf))


@query(
    "q_risk_combinations",
    f"WITH {registry.ENRICHED_SQL} SELECT id, CASE WHEN cats = ['Financial', 'PII'] THEN 'critical' WHEN len(cats) = 0 THEN 'low' WHEN cats = ['PII'] THEN 'medium' ELSE 'high' END AS risk_level FROM e",
)
def risk_combinations(spark, sf):
    """Levels by a policy whose combinations are put in sorted order, so that they match."""
    s = registry.statements(spark, sf).withColumn("raw_query", F.col("sql"))
    out = enrich.enrich(s, registry.schema_frame(spark), catalogue.starter_dictionary(), catalogue.starter_policy().normalized(), True)
    return out.select("id", "risk_level")


@query(
    "q_schema_status",
    f"WITH {registry.RESOLVED_SQL} SELECT s.id, CASE WHEN s.id IN (SELECT id FROM res) THEN 'matched' WHEN s.id IN (SELECT id FROM colr) THEN 'unresolved' ELSE 'no_columns' END AS schema_status FROM s",
)
def schema_status(spark, sf):
    s = registry.statements(spark, sf).withColumn("raw_query", F.col("sql"))
    out = enrich.enrich(s, registry.schema_frame(spark), catalogue.starter_dictionary(), catalogue.starter_policy(), True, debug=True)
    return out.select("id", F.col("debug_info.schema_status").alias("schema_status"))


@query("q_first_schema", "SELECT n_name AS table_name, 'c' || CAST(n_regionkey AS VARCHAR) AS column_name FROM nation UNION ALL SELECT 'only_b', 'x'")
def first_schema(spark, sf):
    """Of tables that stand in two schemas, the columns of the first."""
    n = registry._table(spark, sf, "nation")
    column = lambda schema, name: n.select(F.lit(schema).alias("schema_name"), F.col("n_name").alias("table_name"), name.alias("column_name"), F.lit("TEXT").alias("column_type"))
    known = column("a", F.concat(F.lit("c"), F.col("n_regionkey").cast("string"))).unionByName(column("b", F.lit("hidden"))).unionByName(spark.createDataFrame([("b", "only_b", "x", "TEXT")], catalogue.SCHEMA_CATALOGUE))
    return enrich.first_schema(known.withColumn("categories", F.array().cast("array<string>"))).select("table_name", F.col("column.column_name").alias("column_name"))


@query("q_filter_own", f"WITH {registry.ENRICHED_SQL} SELECT id FROM e WHERE query_type = 'SELECT' AND id % 2 = 0")
def filter_own(spark, sf):
    """A caller's own condition beside the built-in ones."""
    return q.Query(types=["select"], extra=[F.pmod("id", F.lit(2)) == 0]).run(registry.enriched(spark, sf)).select("id")


# Chain ----------------------------------------------------------------------------


@query("q_chain_continued", f"{registry._CHAIN} SELECT id, n AS hash_chain_index, prev AS hash_prev, hash FROM ch WHERE n > 0")
def chain_continued(spark, sf):
    """Two runs, the second from the state that the first leaves, give one chain."""
    events = registry.chain_events(spark, sf)
    middle = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY id)").alias("m")).first()["m"]
    first = chain.seal(events.where(F.col("id") <= middle), "line", ["id"])
    second = chain.seal(events.where(F.col("id") > middle), "line", ["id"], chain.state_of(first))
    return first.unionByName(second).select("id", "hash_chain_index", "hash_prev", "hash")


@query("q_chain_state", f"{registry._CHAIN} SELECT n AS last_chain_index, hash AS last_head_hash FROM ch ORDER BY n DESC LIMIT 1")
def chain_state(spark, sf):
    state = chain.state_of(chain.seal(registry.chain_events(spark, sf), "line", ["id"]))
    return spark.createDataFrame([(state.last_chain_index, state.last_head_hash)], "last_chain_index long, last_head_hash string")
