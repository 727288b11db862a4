"""Registered queries of the audit-log engine, on audit inputs derived from the driver's tables.

Each query has its SQL beside it. Inputs are made by expressions that both engines
share: SQL texts, log lines and events that follow from ``orders`` and ``customer``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sqltext
from ..operators import chain, enrich, parse, query as q
from ..sources import catalogue
from . import generate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Statements by order key; {k} is the key, {c} the customer key.
STATEMENTS = (
    "SELECT ssn, email FROM patient WHERE patient_id = {k}",
    "SELECT p.ssn, e.diagnosis FROM healthcare.patient p JOIN healthcare.encounter e ON p.patient_id = e.patient_id WHERE p.patient_id = {k} LIMIT 5",
    "SELECT * FROM payment_method",
    "SELECT drug_id, name, price FROM pharmacy.drug WHERE drug_id = {k}",
    "UPDATE healthcare.patient SET phone_number='{c}' WHERE patient_id={k}",
    "INSERT INTO drug (drug_id, name) VALUES ({k}, 'a'), ({c}, 'b')",
    "DELETE FROM encounter WHERE encounter_id = {k}",
    "GRANT SELECT ON patient TO user{c} WITH GRANT OPTION",
    "/* op={k} */ SELECT e.notes, e.treatment FROM encounter e WHERE e.encounter_id = {k}",
    "COPY payment_method TO '/tmp/{k}.csv'",
    "ALTER ROLE role{c} WITH CREATEDB",
    "nonsense {k}",
    "BEGIN",
    "SELECT card_last4, p.email FROM payment_method m JOIN patient p ON m.patient_id = p.patient_id",
)
CATALOGUE = (
    ("healthcare", "patient", "patient_id", "uuid"), ("healthcare", "patient", "ssn", "varchar(11)"), ("healthcare", "patient", "email", "character varying(80)"), ("healthcare", "patient", "phone_number", "text"),
    ("healthcare", "patient", "dob", "date"), ("healthcare", "encounter", "encounter_id", "uuid"), ("healthcare", "encounter", "diagnosis", "text"), ("healthcare", "encounter", "treatment", "text"),
    ("healthcare", "encounter", "notes", "text"), ("payments", "payment_method", "patient_id", "uuid"), ("payments", "payment_method", "card_last4", "char(4)"), ("payments", "payment_method", "card_network", "text"),
    ("payments", "payment_method", "payment_token", "uuid"), ("pharmacy", "drug", "drug_id", "uuid"), ("pharmacy", "drug", "name", "text"), ("pharmacy", "drug", "price", "decimal(12,2)"),
    ("ops", "ledger", "contract_address", "text"), ("ops", "ledger", "system_state", "text"), ("ops", "ledger", "home_address", "varchar(20)"),
)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Inputs -------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores dealt to all cores, as the work a row is heavy; larger ones as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sql."""
    o = spread(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c")))
    text = F.element_at(F.array(*[F.lit(s) for s in STATEMENTS]), (F.pmod("id", F.lit(len(STATEMENTS))) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{k}"), F.col("id").cast("string")), F.lit("{c}"), F.col("c").cast("string"))
    return o.select("id", text.alias("sql"))


_LIST = ", ".join("'" + s.replace("'", "''") + "'" for s in STATEMENTS)
STATEMENTS_SQL = f"s AS (SELECT o_orderkey AS id, o_custkey AS c, replace(replace(list_extract([{_LIST}], CAST(o_orderkey % {len(STATEMENTS)} AS INT) + 1), '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{c}}', CAST(o_custkey AS VARCHAR)) AS sql FROM orders)"


def pg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statements(spark, sf_dir)
    day = F.date_format(F.timestamp_seconds(F.lit(1_735_689_600) + F.col("id") * 61), "yyyy-MM-dd HH:mm:ss")
    audit = F.concat(day, F.lit(".123 UTC [77] LOG:  AUDIT: SESSION,"), F.col("id").cast("string"), F.lit(',1,READ,X,TABLE,t'), F.pmod("id", F.lit(7)).cast("string"), F.lit(',"'), F.col("sql"), F.lit('",<none>'))
    login = F.concat(day, F.lit(" UTC [77] LOG:  connection authorized: user=u"), F.pmod("id", F.lit(9)).cast("string"), F.lit(" database=db"), F.pmod("id", F.lit(3)).cast("string"))
    failed = F.concat(day, F.lit(" UTC [77] LOG:  connection failed for user=u"), F.pmod("id", F.lit(9)).cast("string"))
    kind = F.pmod("id", F.lit(10))
    return s.select("id", F.when(kind == 0, login).when(kind == 1, failed).when(kind == 2, F.concat(F.lit("noise "), F.col("id").cast("string"))).otherwise(audit).alias("line"))


_DAY = "strftime(make_timestamp((1735689600 + id * 61) * 1000000), '%Y-%m-%d %H:%M:%S')"
PG_SQL = f"""{STATEMENTS_SQL}, l AS (SELECT id, CASE id % 10
  WHEN 0 THEN {_DAY} || ' UTC [77] LOG:  connection authorized: user=u' || CAST(id % 9 AS VARCHAR) || ' database=db' || CAST(id % 3 AS VARCHAR)
  WHEN 1 THEN {_DAY} || ' UTC [77] LOG:  connection failed for user=u' || CAST(id % 9 AS VARCHAR)
  WHEN 2 THEN 'noise ' || CAST(id AS VARCHAR)
  ELSE {_DAY} || '.123 UTC [77] LOG:  AUDIT: SESSION,' || CAST(id AS VARCHAR) || ',1,READ,X,TABLE,t' || CAST(id % 7 AS VARCHAR) || ',"' || sql || '",<none>' END AS line FROM s)"""


def mysql_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statements(spark, sf_dir)
    command = F.element_at(F.array(*[F.lit(x) for x in ("select", "connect", "quit", "error", "grant", "", "create_table")]), (F.pmod("id", F.lit(7)) + 1).cast("int"))
    record = F.struct(
        F.lit("Query").alias("name"), F.col("id").cast("string").alias("record"), F.lit("2025-01-01T00:00:00Z").alias("timestamp"), command.alias("command_class"), F.col("id").cast("string").alias("connection_id"),
        F.pmod("id", F.lit(2)).alias("status"), F.col("sql").alias("sqltext"), F.concat(F.lit("u"), F.pmod("id", F.lit(9)).cast("string"), F.lit("[x] @ h []")).alias("user"), F.lit("h").alias("host"),
        F.when(F.pmod("id", F.lit(3)) == 0, "").otherwise("10.0.0.1").alias("ip"), F.lit("shop").alias("db"),
    )
    xml = F.concat(F.lit('<AUDIT_RECORD NAME="Query" COMMAND_CLASS="update" CONNECTION_ID="'), F.col("id").cast("string"), F.lit('" STATUS="0" SQLTEXT="UPDATE t SET a=&apos;x&apos;" USER="root" HOST="" IP="" DB="d"/>'))
    kind = F.pmod("id", F.lit(5))
    return s.select("id", F.when(kind == 0, xml).when(kind == 1, F.lit("garbage")).otherwise(F.to_json(F.struct(record.alias("audit_record")))).alias("line"))


def schema_frame(spark: SparkSession) -> DataFrame:
    return catalogue.schema_frame(spark, CATALOGUE)


def enriched(spark: SparkSession, sf_dir: str, emit_unknown: bool = True) -> DataFrame:
    """Enriched events of all statements, with the fields that filters ask for."""
    s = statements(spark, sf_dir).withColumn("raw_query", F.col("sql"))
    out = enrich.enrich(s, schema_frame(spark), catalogue.starter_dictionary(), catalogue.starter_policy(), emit_unknown)
    out = sqltext.with_classes(out, "sql", "_c").select("id", "sql", "sensitivity", "risk_level", F.col("_ctype").alias("query_type"), F.col("_cbulk.bulk").alias("bulk"), F.col("_cbulk.bulk_type").alias("bulk_type"))
    return out.withColumns({"db_user": F.concat(F.lit("User"), F.pmod("id", F.lit(9)).cast("string")), "client_ip": F.concat(F.lit("10.0.0."), F.pmod("id", F.lit(5)).cast("string")), "timestamp": F.date_format(F.timestamp_seconds(F.lit(1_735_689_600) + F.col("id") * 61), "yyyy-MM-dd'T'HH:mm:ss'Z'")})


# SQL of the building blocks -------------------------------------------------------

_BARE = r"trim(regexp_replace(sql, '^(\s+|/\*(.|\n)*?\*/|--[^\n]*\n)+', ''))"
_ESCALATES = "(contains(u, 'WITH ADMIN OPTION') OR contains(u, 'WITH GRANT OPTION') OR (contains(u, 'GRANT') AND contains(u, 'ALL PRIVILEGES')) OR (contains(u, 'GRANT') AND contains(u, 'ROLE') AND contains(u, ' TO ')) OR (contains(u, 'REVOKE') AND contains(u, 'ROLE') AND contains(u, ' FROM ')) OR (u LIKE 'ALTER ROLE%' AND (contains(u, 'WITH SUPER') OR contains(u, 'WITH CREATEDB') OR contains(u, 'WITH CREATEROLE'))))"
TYPED_SQL = f"""{STATEMENTS_SQL}, b AS (SELECT *, upper({_BARE}) AS u FROM s), t AS (SELECT *, {_ESCALATES} AS escalates,
  CASE WHEN u LIKE 'BEGIN%' THEN 'TX_BEGIN' WHEN u LIKE 'SELECT%' THEN 'SELECT' WHEN u LIKE 'INSERT%' THEN 'INSERT' WHEN u LIKE 'UPDATE%' THEN 'UPDATE' WHEN u LIKE 'DELETE%' THEN 'DELETE'
       WHEN u LIKE 'ALTER ROLE%' THEN CASE WHEN {_ESCALATES} THEN 'ALTER_ROLE_ESCALATION' ELSE 'ALTER' END WHEN u LIKE 'GRANT%' THEN CASE WHEN {_ESCALATES} THEN 'GRANT_ESCALATION' ELSE 'GRANT' END
       WHEN u LIKE 'COPY%' THEN 'COPY' ELSE 'ANON' END AS query_type FROM b)"""
BULK_SQL = f"""{TYPED_SQL}, k AS (SELECT *, upper(sql) AS w FROM t), bk AS (SELECT *,
  CASE WHEN contains(w, 'COPY') AND contains(w, 'TO') THEN 'export' WHEN w LIKE 'INSERT%' AND (contains(w, '),(') OR contains(w, '), (')) THEN 'insert'
       WHEN w LIKE 'SELECT%' AND NOT contains(w, 'WHERE') AND (contains(w, 'SELECT *') OR regexp_matches(w, 'SELECT\\s+.+?\\s+FROM')) THEN 'export' END AS bulk_type FROM k)"""
_CAT = ", ".join(f"('{s}', '{t}', '{c}', '{k}')" for s, t, c, k in CATALOGUE)
_RULES = ", ".join("('{}', '{}', [{}])".format(c, r, ", ".join(f"'{t}'" for t in ts)) for c, r, ts in catalogue.STARTER_RULES)
SCHEMA_SQL = f"""raw_schema(schema_name, table_name, column_name, raw_type) AS (VALUES {_CAT}), sch AS (SELECT schema_name, table_name, column_name,
  CASE regexp_replace(upper(trim(raw_type)), '\\([^)]*\\)', '', 'g') WHEN 'CHARACTER VARYING' THEN 'VARCHAR' WHEN 'INTEGER' THEN 'INT' ELSE regexp_replace(upper(trim(raw_type)), '\\([^)]*\\)', '', 'g') END AS column_type FROM raw_schema),
rules(category, regex, types) AS (VALUES {_RULES}),
cls AS (SELECT DISTINCT sch.*, category FROM sch JOIN rules ON regexp_matches(column_name, regex) AND list_contains(types, column_type)
        WHERE NOT regexp_matches(column_name, '(?i)^system_state$') AND NOT regexp_matches(column_name, '(?i)^contract_address$'))"""
#: References of the statements: alias, table and column, as the analysis finds them.
_QID, _ID = "[a-zA-Z_][a-zA-Z0-9_.]*", "[a-zA-Z_][a-zA-Z0-9_]*"
_RESERVED = ", ".join(f"'{w}'" for w in sqltext.RESERVED)
REFS_SQL = f"""{STATEMENTS_SQL}, cl AS (SELECT id, trim(regexp_replace(regexp_replace(sql, '/\\*.*?\\*/', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM s),
fa AS (SELECT id, q, unnest(list_zip(regexp_extract_all(q, '(?i)\\bFROM\\s+({_QID})\\s+({_ID})\\b', 1), regexp_extract_all(q, '(?i)\\bFROM\\s+({_QID})\\s+({_ID})\\b', 2))) AS p FROM cl),
fav AS (SELECT id, p[1] AS t, p[2] AS a FROM fa WHERE upper(p[2]) NOT IN ({_RESERVED})),
fp AS (SELECT id, unnest(regexp_extract_all(q, '(?i)\\bFROM\\s+({_QID})\\b', 1)) AS t FROM cl WHERE id NOT IN (SELECT id FROM fav)),
ja AS (SELECT id, unnest(list_zip(regexp_extract_all(q, '(?i)\\bJOIN\\s+({_QID})\\s+({_ID})\\b', 1), regexp_extract_all(q, '(?i)\\bJOIN\\s+({_QID})\\s+({_ID})\\b', 2))) AS p FROM cl),
jav AS (SELECT id, p[1] AS t, p[2] AS a FROM ja WHERE upper(p[2]) NOT IN ({_RESERVED})),
one AS (SELECT id, regexp_extract(q, '(?i)\\bINSERT\\s+INTO\\s+({_QID})\\b', 1) AS t FROM cl UNION ALL SELECT id, regexp_extract(q, '(?i)\\bUPDATE\\s+({_QID})\\s+SET\\b', 1) FROM cl UNION ALL SELECT id, regexp_extract(q, '(?i)\\bDELETE\\s+FROM\\s+({_QID})\\b', 1) FROM cl),
tab AS (SELECT DISTINCT id, alias, table_name FROM (
  SELECT id, a AS alias, list_extract(string_split(t, '.'), -1) AS table_name FROM fav UNION ALL SELECT id, list_extract(string_split(t, '.'), -1), list_extract(string_split(t, '.'), -1) FROM fav
  UNION ALL SELECT id, list_extract(string_split(t, '.'), -1), list_extract(string_split(t, '.'), -1) FROM fp
  UNION ALL SELECT id, a, list_extract(string_split(t, '.'), -1) FROM jav UNION ALL SELECT id, list_extract(string_split(t, '.'), -1), list_extract(string_split(t, '.'), -1) FROM jav
  UNION ALL SELECT id, list_extract(string_split(t, '.'), -1), list_extract(string_split(t, '.'), -1) FROM one WHERE t <> '')),
items AS (SELECT id, trim(unnest(string_split(regexp_extract(q, '(?i)\\bSELECT\\s+(.*?)\\s+FROM\\b', 1), ','))) AS x FROM cl WHERE NOT contains(upper(q), 'SELECT *')
  UNION ALL SELECT id, trim(unnest(string_split(regexp_extract(q, '(?i)\\bINSERT\\s+INTO\\s+{_QID}\\s*\\(\\s*(.*?)\\s*\\)', 1), ','))) FROM cl WHERE NOT contains(upper(q), 'SELECT *')),
colr AS (SELECT id, x AS c FROM items WHERE x <> '' AND x <> '*' AND (contains(x, '.') OR (upper(x) NOT IN ({_RESERVED}) AND regexp_matches(x, '^{_ID}$')))
  UNION ALL SELECT id, '*' FROM cl WHERE contains(upper(q), 'SELECT *')
  UNION ALL SELECT id, trim(string_split(x, '=')[1]) FROM (SELECT id, unnest(string_split(regexp_extract(q, '(?i)\\bSET\\s+(.*?)(?:\\s+WHERE|\\s*$)', 1), ',')) AS x FROM cl WHERE contains(upper(q), 'UPDATE') AND contains(upper(q), 'SET')) WHERE trim(string_split(x, '=')[1]) <> ''
  UNION ALL SELECT id, unnest(regexp_extract_all(regexp_extract(q, '(?i)\\bWHERE\\s+(.*?)(?:\\s+ORDER\\s+BY|\\s+GROUP\\s+BY|\\s+HAVING|\\s+LIMIT|\\s*$)', 1), '\\b({_ID}\\.{_ID})\\b', 1)) FROM cl WHERE NOT contains(upper(q), 'SELECT *'))"""
RESOLVED_SQL = f"""{REFS_SQL}, {SCHEMA_SQL}, res AS (
  SELECT DISTINCT t.id, t.alias || '.' || k.column_name AS name, k.column_name, k.table_name FROM colr r JOIN tab t ON r.id = t.id JOIN sch k ON k.table_name = t.table_name WHERE r.c = '*'
  UNION SELECT DISTINCT r.id, r.c, k.column_name, k.table_name FROM colr r JOIN tab t ON r.id = t.id AND t.alias = split_part(r.c, '.', 1) JOIN sch k ON k.table_name = t.table_name AND k.column_name = split_part(r.c, '.', 2) WHERE contains(r.c, '.')
  UNION SELECT id, alias || '.' || c, c, table_name FROM (SELECT r.id, r.c, t.alias, k.table_name, row_number() OVER (PARTITION BY r.id, r.c ORDER BY t.alias) AS rn FROM colr r JOIN tab t ON r.id = t.id JOIN sch k ON k.table_name = t.table_name AND k.column_name = r.c WHERE NOT contains(r.c, '.') AND r.c <> '*') WHERE rn = 1)"""
ENRICHED_SQL = f"""{BULK_SQL.replace('s AS (', 's AS (', 1)}, {RESOLVED_SQL.replace(STATEMENTS_SQL + ', ', '', 1)},
lab AS (SELECT res.id, cls.category, cls.category || ':' || res.column_name AS label FROM res JOIN cls ON cls.table_name = res.table_name AND cls.column_name = res.column_name),
agg AS (SELECT id, list_sort(list(label)) AS sensitivity, list_sort(list(DISTINCT category)) AS cats FROM lab GROUP BY id),
e AS (SELECT bk.id, bk.sql, coalesce(agg.sensitivity, []) AS sensitivity, coalesce(agg.cats, []) AS cats,
  CASE WHEN agg.cats IS NULL THEN 'low' WHEN len(cats) = 1 AND cats[1] = 'PII' THEN 'medium' ELSE 'high' END AS risk_level,
  bk.query_type, CASE WHEN bulk_type IS NOT NULL THEN true END AS bulk, bulk_type, 'User' || CAST(bk.id % 9 AS VARCHAR) AS db_user, '10.0.0.' || CAST(bk.id % 5 AS VARCHAR) AS client_ip,
  make_timestamp((1735689600 + bk.id * 61) * 1000000) AS ts FROM bk LEFT JOIN agg ON agg.id = bk.id)"""


def _labels(df: DataFrame) -> DataFrame:
    return df.withColumn("sensitivity", F.array_join("sensitivity", ","))


# Queries ------------------------------------------------------------------------


@query("q_classify_sql", f"WITH {TYPED_SQL} SELECT id, query_type FROM t")
def classify_sql(spark, sf):
    return sqltext.with_classes(statements(spark, sf), "sql").select("id", F.col("_type").alias("query_type"))


@query("q_escalation", f"WITH {TYPED_SQL} SELECT id, escalates FROM t")
def escalation(spark, sf):
    return statements(spark, sf).withColumn("up", F.upper("sql")).select("id", sqltext.escalates(F.col("up")).alias("escalates"))


@query("q_looks_like_sql", f"WITH {TYPED_SQL} SELECT id, query_type <> 'ANON' AS good FROM t")
def looks(spark, sf):
    return statements(spark, sf).select("id", sqltext.looks_like_sql(F.col("sql")).alias("good"))


@query("q_bulk_pg", f"WITH {BULK_SQL} SELECT id, bulk_type IS NOT NULL AS bulk, bulk_type, bulk_type = 'export' AS full_table_read FROM bk")
def bulk_pg(spark, sf):
    b = statements(spark, sf).withColumn("b", sqltext.bulk_operation(F.col("sql")))
    return b.select("id", F.coalesce("b.bulk", F.lit(False)).alias("bulk"), "b.bulk_type", F.when(F.col("b.bulk_type").isNotNull(), F.coalesce("b.full_table_read", F.lit(False))).alias("full_table_read"))


@query("q_bulk_mysql", f"WITH {BULK_SQL} SELECT id, CASE WHEN query_type <> 'COPY' THEN bulk_type END AS bulk_type FROM bk")
def bulk_mysql(spark, sf):
    return statements(spark, sf).select("id", sqltext.bulk_operation(F.col("sql"), "mysql")["bulk_type"].alias("bulk_type"))


_PG_TYPE = "CASE id % 10 WHEN 0 THEN 'LOGIN_SUCCESS' WHEN 1 THEN 'LOGIN_FAILURE' ELSE query_type END"
_PG_OK = "(id % 10 < 2 OR (id % 10 > 2 AND query_type <> 'ANON'))"


@query("q_pg_parse", f"WITH {PG_SQL}, {TYPED_SQL.replace(STATEMENTS_SQL + ', ', '', 1)} SELECT t.id, {_PG_TYPE.replace('id %', 't.id %')} AS query_type, CASE WHEN t.id % 10 > 2 THEN sql ELSE line END AS raw_query FROM t JOIN l ON l.id = t.id WHERE {_PG_OK.replace('id %', 't.id %')}")
def pg_parse(spark, sf):
    return parse.events(parse.parse(pg_lines(spark, sf).withColumn("_id", F.col("id")), "postgres", True, "hash")).select(F.col("_id").alias("id"), "query_type", "raw_query")


@query(
    "q_pg_fields",
    f"WITH {TYPED_SQL} SELECT id, CASE WHEN id % 10 > 2 THEN 'SESSION' END AS audit_class, CASE WHEN id % 10 > 2 THEN id END AS session_id, CASE WHEN id % 10 > 2 THEN 't' || CAST(id % 7 AS VARCHAR) END AS object_name, "
    f"CASE WHEN id % 10 < 2 THEN 'u' || CAST(id % 9 AS VARCHAR) END AS db_user, CASE WHEN id % 10 = 0 THEN 'db' || CAST(id % 3 AS VARCHAR) END AS db_name, strftime(make_timestamp((1735689600 + id * 61) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS \"timestamp\" FROM t WHERE {_PG_OK}",
)
def pg_fields(spark, sf):
    e = parse.events(parse.parse(pg_lines(spark, sf).withColumn("_id", F.col("id")), "postgres", True, "hash"))
    return e.select(F.col("_id").alias("id"), "audit_class", "session_id", F.col("meta")["object_name"].alias("object_name"), "db_user", "db_name", "timestamp")


@query("q_pg_auth", "SELECT CASE o_orderkey % 10 WHEN 0 THEN 'LOGIN_SUCCESS' ELSE 'LOGIN_FAILURE' END AS query_type, 'u' || CAST(o_orderkey % 9 AS VARCHAR) AS db_user, count(*) AS n FROM orders WHERE o_orderkey % 10 < 2 GROUP BY ALL")
def pg_auth(spark, sf):
    e = parse.events(parse.parse(pg_lines(spark, sf), "postgres", False, "hash"))
    return e.where(F.col("query_type").isin("LOGIN_SUCCESS", "LOGIN_FAILURE")).groupBy("query_type", "db_user").agg(F.count(F.lit(1)).alias("n"))


@query("q_rejects", f"WITH {PG_SQL}, {TYPED_SQL.replace(STATEMENTS_SQL + ', ', '', 1)} SELECT t.id, 'SKIP' AS query_type, line AS raw_query FROM t JOIN l ON l.id = t.id WHERE NOT {_PG_OK.replace('id %', 't.id %')}")
def rejected(spark, sf):
    return parse.rejects(parse.parse(pg_lines(spark, sf).withColumn("_id", F.col("id")), "postgres", False, "hash")).select(F.col("_id").alias("id"), "query_type", "raw_query")


@query("q_parse_counters", f"WITH {TYPED_SQL} SELECT count(*) AS raw_count, count_if({_PG_OK}) AS parsed_count, count_if(NOT {_PG_OK}) AS rejected_count FROM t")
def parse_counters(spark, sf):
    return parse.counters(parse.parse(pg_lines(spark, sf), "postgres", False, "hash"))


_MYSQL = f"""WITH {TYPED_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'root' ELSE 'u' || CAST(id % 9 AS VARCHAR) END AS db_user, CASE WHEN id % 5 = 0 THEN 'd' ELSE 'shop' END AS db_name,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 'h' ELSE '10.0.0.1' END AS client_ip, id AS connection_id, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 2 END AS status,
  CASE WHEN id % 5 = 0 THEN 'UPDATE t SET a=''x''' ELSE sql END AS raw_query,
  CASE WHEN id % 5 = 0 THEN 'UPDATE' ELSE CASE id % 7 WHEN 0 THEN 'SELECT' WHEN 1 THEN CASE WHEN id % 2 = 1 THEN 'LOGIN_FAILURE' ELSE 'LOGIN_SUCCESS' END WHEN 2 THEN 'LOGOUT'
    WHEN 4 THEN CASE WHEN escalates THEN 'GRANT_ESCALATION' ELSE 'GRANT' END WHEN 6 THEN 'CREATE' ELSE query_type END END AS query_type FROM t WHERE id % 5 <> 1"""


@query("q_mysql_parse", _MYSQL)
def mysql_parse(spark, sf):
    e = parse.events(parse.parse(mysql_lines(spark, sf).withColumn("_id", F.col("id")), "mysql", True, "hash"))
    return e.select(F.col("_id").alias("id"), "db_user", "db_name", "client_ip", "connection_id", "status", "raw_query", "query_type")


@query("q_schema_types", f"WITH {SCHEMA_SQL} SELECT schema_name, table_name, column_name, column_type FROM sch")
def schema_types(spark, sf):
    return schema_frame(spark)


@query("q_dict_match", f"WITH {SCHEMA_SQL} SELECT table_name, column_name, category FROM cls")
def dict_match(spark, sf):
    return enrich.classify(schema_frame(spark), catalogue.starter_dictionary()).select("table_name", "column_name", F.explode("categories").alias("category"))


@query("q_tables", f"WITH {REFS_SQL} SELECT id, alias, table_name FROM tab")
def tables(spark, sf):
    s = statements(spark, sf).withColumn("q", sqltext.clean_comments(F.col("sql")))
    return s.select("id", F.explode(sqltext.table_references(F.col("q"))).alias("alias", "table_name"))


@query("q_columns", f"WITH {REFS_SQL} SELECT id, c AS column_name FROM colr")
def columns(spark, sf):
    s = statements(spark, sf).withColumn("q", sqltext.clean_comments(F.col("sql")))
    return s.select("id", F.explode(sqltext.column_references(F.col("q"))).alias("column_name"))


@query("q_resolve", f"WITH {RESOLVED_SQL} SELECT id, name FROM res")
def resolved(spark, sf):
    classified = enrich.classify(schema_frame(spark), catalogue.starter_dictionary())
    return enrich._with_resolved(statements(spark, sf), classified, "sql").select("id", F.explode("_resolved.name").alias("name"))


@query("q_sensitivity", f"WITH {ENRICHED_SQL} SELECT id, array_to_string(sensitivity, ',') AS sensitivity FROM e WHERE len(cats) > 0")
def sensitivity(spark, sf):
    return _labels(enriched(spark, sf, False)).select("id", "sensitivity")


@query("q_risk", f"WITH {ENRICHED_SQL} SELECT id, risk_level FROM e")
def risk(spark, sf):
    return enriched(spark, sf).select("id", "risk_level")


@query("q_enrich_counters", f"WITH {ENRICHED_SQL} SELECT count(*) AS input_events, count_if(len(cats) > 0) AS enriched_events, count_if(len(cats) = 0) AS unknown_events, count_if(len(cats) = 0) AS dropped_events, CAST(0 AS BIGINT) AS error_events FROM e")
def enrich_counters(spark, sf):
    s = statements(spark, sf).withColumn("raw_query", F.col("sql"))
    full = enrich.enrich(s, schema_frame(spark), catalogue.starter_dictionary(), catalogue.starter_policy(), True)
    return enrich.enrich_counters(s, full)


_MOMENT = "TIMESTAMP '2025-01-05 00:00:00'"


def _filters() -> dict[str, tuple[q.Query, str]]:
    from datetime import datetime, timedelta, timezone

    day = datetime(2025, 1, 5, tzinfo=timezone.utc)
    has = lambda x: f"len(list_filter(sensitivity, lambda x: {x})) > 0"
    return {
        "sensitivity": (q.Query(sensitivity=["phi", "Financial"]), has("lower(split_part(x, ':', 1)) IN ('phi', 'financial')")),
        "user": (q.Query(user="USER3"), "lower(db_user) = 'user3'"),
        "ip": (q.Query(ip="10.0.0.2"), "client_ip = '10.0.0.2'"),
        "type": (q.Query(types=["update", "GRANT_escalation"]), "query_type IN ('UPDATE', 'GRANT_ESCALATION')"),
        "bulk": (q.Query(bulk=True), "bulk"),
        "bulktype": (q.Query(bulk_type="INSERT"), "bulk_type = 'insert'"),
        "fields": (q.Query(fields=["EMAIL"]), has("lower(split_part(x, ':', 2)) = 'email'")),
        "since": (q.Query(since=day), f"ts >= {_MOMENT}"),
        "last": (q.Query(last=timedelta(days=2), now=datetime(2025, 1, 7, tzinfo=timezone.utc)), f"ts >= {_MOMENT}"),
        "errors": (q.Query(exclude_errors=True), "query_type <> 'ERROR'"),
        "and": (q.Query(sensitivity=["pii"], types=["select"], since=day, exclude_errors=True), has("split_part(x, ':', 1) = 'PII'") + f" AND query_type = 'SELECT' AND ts >= {_MOMENT}"),
    }


def _add_filter(name: str) -> None:
    sql = f"WITH {ENRICHED_SQL} SELECT id FROM e WHERE {_filters()[name][1]}"

    @query(f"q_filter_{name}", sql)
    def run(spark, sf):
        return _filters()[name][0].run(enriched(spark, sf)).select("id")


for _name in _filters():
    _add_filter(_name)


@query("q_limit", f"WITH {ENRICHED_SQL} SELECT id FROM e WHERE bulk ORDER BY id LIMIT 25")
def limited(spark, sf):
    return q.Query(bulk=True, limit=25).run(enriched(spark, sf), ["id"]).select("id")


@query("q_limit_summary", f"WITH {ENRICHED_SQL}, m AS (SELECT max(id) AS top FROM (SELECT id FROM e WHERE bulk ORDER BY id LIMIT 25)) SELECT count(*) AS input_events, count_if(bulk) AS matched_events FROM e, m WHERE id <= top")
def limit_summary(spark, sf):
    question = q.Query(bulk=True, limit=25)
    seen = q.consumed(enriched(spark, sf), question, ["id"])
    return q.totals(seen, question.condition()).select("input_events", "matched_events")


@query("q_summary_totals", f"WITH {ENRICHED_SQL} SELECT count(*) AS input_events, count_if(query_type = 'SELECT') AS matched_events, count_if(bulk AND query_type = 'SELECT') AS bulk_operations FROM e")
def summary_totals(spark, sf):
    return q.totals(enriched(spark, sf), q.by_type(["select"])).select("input_events", "matched_events", "bulk_operations")


@query("q_summary_counts", f"WITH {ENRICHED_SQL} SELECT 'query_type' AS dimension, query_type AS key, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'risk_level', risk_level, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'sensitivity', split_part(x, ':', 1), count(*) FROM (SELECT unnest(sensitivity) AS x FROM e) GROUP BY ALL")
def summary_counts(spark, sf):
    return q.counts(enriched(spark, sf))


@query("q_time_range", f"WITH {ENRICHED_SQL} SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_timestamp, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_timestamp FROM e")
def time_range(spark, sf):
    t = q.totals(enriched(spark, sf))
    return t.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) for c in ("first_timestamp", "last_timestamp")])


@query("q_events_by_category", f"WITH {ENRICHED_SQL} SELECT category, count(*) AS n FROM (SELECT unnest(cats) AS category FROM e) GROUP BY ALL")
def by_category(spark, sf):
    return q.events_by_category(enriched(spark, sf))


@query("q_top_columns", f"WITH {ENRICHED_SQL} SELECT label, count(*) AS n FROM (SELECT unnest(sensitivity) AS label FROM e) GROUP BY ALL ORDER BY n DESC, label LIMIT 10")
def top_columns(spark, sf):
    return q.top_columns(enriched(spark, sf))


@query("q_users_sensitive", f"WITH {ENRICHED_SQL} SELECT db_user, count(*) AS n FROM e WHERE len(sensitivity) > 0 GROUP BY ALL")
def users_sensitive(spark, sf):
    return q.users_with_sensitive(enriched(spark, sf))


@query("q_bulk_by_type", f"WITH {ENRICHED_SQL} SELECT bulk_type, count(*) AS n FROM e WHERE bulk GROUP BY ALL")
def bulk_by_type(spark, sf):
    return q.bulk_by_type(enriched(spark, sf))


@query("q_risk_timeline", f"WITH {ENRICHED_SQL} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS \"timestamp\", db_user, query_type, risk_level, array_to_string(sensitivity, ',') AS labels FROM e WHERE risk_level IN ('high', 'critical')")
def timeline(spark, sf):
    return q.risk_timeline(enriched(spark, sf))


# Chain --------------------------------------------------------------------------

_EVENTS = "CAST('{\"id\":' || CAST(c_custkey AS VARCHAR) || ',\"name\":\"' || c_name || '\"}' AS VARCHAR)"


def chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('","id":'), F.col("c_custkey").cast("string"), F.lit("}")).alias("line"))


_CHAIN = f"""WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_custkey AS id, {_EVENTS} AS canon FROM customer),
ch AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, repeat('0', 64) AS prev, repeat('0', 64) AS hash UNION ALL
       SELECT o.n, o.id, ch.hash, sha256(ch.hash || '|' || o.canon) FROM ch JOIN o ON o.n = ch.n + 1)"""


@query("q_canonical_json", f"SELECT c_custkey AS id, {_EVENTS} AS canon FROM customer")
def canonical_rows(spark, sf):
    return chain.canonical_rows(chain_events(spark, sf), "line", ["id"]).select("id", F.col("_canon").alias("canon"))


@query("q_chain_compute", f"{_CHAIN} SELECT id, n AS hash_chain_index, prev AS hash_prev, hash FROM ch WHERE n > 0")
def chain_compute(spark, sf):
    return chain.seal(chain_events(spark, sf), "line", ["id"]).select("id", "hash_chain_index", "hash_prev", "hash")


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.seal(chain_events(spark, sf_dir), "line", ["id"]).select("id", F.floor(F.col("id") / 500).alias("part"), "sealed")


@query("q_chain_verify", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS hash_chain_index, false AS tampered FROM customer")
def chain_verify(spark, sf):
    return chain.verify_rows(_sealed(spark, sf), "sealed", ["part", "id"], ["part"]).select("id", "hash_chain_index", "tampered")


@query("q_chain_tamper", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 97 = 5 AND c_custkey > 0")
def chain_tamper(spark, sf):
    edited = F.when(F.pmod("id", F.lit(97)) == 5, F.replace("sealed", F.lit('"name":"'), F.lit('"name":"x'))).otherwise(F.col("sealed"))
    return chain.verify_rows(_sealed(spark, sf).withColumn("sealed", edited), "sealed", ["part", "id"], ["part"]).where("tampered").select("id")


# Generator ----------------------------------------------------------------------


@query("q_gen_counts")
def gen_counts(spark, sf):
    return generate.table_counts(generate.tables(spark))


@query("q_gen_workload")
def gen_workload(spark, sf):
    return generate.workload_stats(generate.workload(spark, generate.RunConfig(total_ops=2000)))


@query("q_gen_patients")
def gen_patients(spark, sf):
    return generate.patients(spark, generate.LoadConfig())


@query("q_seed_joins")
def seed_joins(spark, sf):
    made = generate.tables(spark)
    joined = made["pharmacy.pharmacy_order"].join(made["payments.payment_method"].select("payment_method_id", "card_network"), "payment_method_id").join(made["pharmacy.pharmacy_order_item"], "order_id")
    return joined.groupBy("status", "card_network").agg(F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("quantity"))


@query("q_workload_end_to_end")
def end_to_end(spark, sf):
    """Generated statements as log lines, parsed, enriched and counted."""
    lines = generate.audit_lines(generate.workload(spark, generate.RunConfig(total_ops=2000)))
    events = parse.events(parse.parse(lines, "postgres", True, "hash"))
    out = enrich.enrich(events, schema_frame(spark), catalogue.starter_dictionary(), catalogue.starter_policy(), True)
    return q.counts(out)


@query("q_statement_mismatch", f"WITH {TYPED_SQL} SELECT count(*) AS n FROM t WHERE id % 10 > 2 AND query_type <> 'ANON'")
def mismatch(spark, sf):
    e = parse.events(parse.parse(pg_lines(spark, sf), "postgres", True, "hash"))
    return e.where(parse.statement_mismatch()).agg(F.count(F.lit(1)).alias("n"))


@query("q_lines_by_minute", "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS query_type, count(*) AS n FROM events GROUP BY ALL")
def windows(spark, sf):
    from ..streaming import follow

    e = _table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("event_type").alias("query_type"))
    return follow.counts_by_window(e).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive events by category, type and risk: parse, enrich, filter and summarise."""
    lines = pg_lines(spark, sf_dir)
    events = parse.events(parse.parse(lines, "postgres", True, "hash"))
    out = enrich.enrich(events, schema_frame(spark), catalogue.starter_dictionary(), catalogue.starter_policy())
    return q.counts(q.Query(exclude_errors=True).run(out))

