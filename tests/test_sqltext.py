import pytest
from pyspark.sql import functions as F

from tracehull.functions import sqltext

CLASSES = [
    ("BEGIN;", "TX_BEGIN"), ("START TRANSACTION;", "TX_BEGIN"), ("COMMIT;", "TX_COMMIT"), ("ROLLBACK;", "TX_ROLLBACK"), ("SAVEPOINT a;", "TX_SAVEPOINT"), ("RELEASE SAVEPOINT a;", "TX_SAVEPOINT"),
    ("SELECT * FROM t;", "SELECT"), ("INSERT INTO t VALUES (1);", "INSERT"), ("UPDATE t SET a=1 WHERE b=2;", "UPDATE"), ("DELETE FROM t WHERE a=1;", "DELETE"), ("TRUNCATE TABLE t;", "DELETE"),
    ("REPLACE INTO t (a) VALUES (1);", "INSERT"), ("MERGE INTO t USING s ON t.id = s.id;", "MERGE"), ("CREATE TABLE t (a int);", "CREATE"), ("ALTER TABLE t ADD COLUMN b text;", "ALTER"), ("DROP TABLE t;", "DROP"),
    ("RENAME TABLE a TO b;", "ALTER"), ("GRANT SELECT ON t TO bob;", "GRANT"), ("REVOKE SELECT ON t FROM bob;", "REVOKE"), ("GRANT ROLE admin TO u;", "GRANT_ESCALATION"), ("REVOKE ROLE admin FROM u;", "REVOKE_ESCALATION"),
    ("GRANT SELECT ON t TO u WITH ADMIN OPTION;", "GRANT_ESCALATION"), ("GRANT SELECT ON t TO u WITH GRANT OPTION;", "GRANT_ESCALATION"), ("ALTER ROLE a WITH SUPER;", "ALTER_ROLE_ESCALATION"),
    ("ALTER ROLE a WITH CREATEDB;", "ALTER_ROLE_ESCALATION"), ("GRANT ALL PRIVILEGES ON *.* TO u;", "GRANT_ESCALATION"), ("ALTER USER r WITH SUPER;", "ALTER_USER_ESCALATION"), ("CREATE USER a WITH SUPER;", "CREATE_USER_ESCALATION"),
    ("ALTER USER u PASSWORD 'x';", "ALTER"), ("CREATE USER u IDENTIFIED BY 'x';", "CREATE"), ("COPY t TO '/tmp/t.csv';", "COPY"), ("LOAD DATA INFILE '/tmp/f' INTO TABLE t;", "LOAD_DATA"),
    ("SELECT * FROM t INTO OUTFILE '/tmp/f';", "SELECT_INTO_OUTFILE"), ("SELECT 'x' INTO DUMPFILE '/tmp/f';", "SELECT_INTO_OUTFILE"), ("SET a TO b;", "SET"), ("RESET a;", "SET"), ("SHOW DATABASES;", "SHOW"),
    ("VACUUM FULL;", "UTILITY"), ("ANALYZE t;", "UTILITY"), ("COMMENT ON TABLE t IS 'x';", "UTILITY"), ("CALL f();", "EXEC"), ("DO $$ BEGIN END $$;", "EXEC"), ("PREPARE s FROM 'SELECT 1';", "EXEC"),
    ("DEALLOCATE PREPARE s;", "EXEC"), ("nonsense text here", "ANON"), ("/* c */ SELECT * FROM t;", "SELECT"), ("-- n\nINSERT INTO t VALUES (1);", "INSERT"), ("/* open", "ANON"), ("", "ANON"), (None, "ANON"), ("DOCUMENT", "EXEC"),
]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, q string")
    return [r["r"] for r in df.select("i", expression(F.col("q")).alias("r")).orderBy("i").collect()]


def test_query_types(spark):
    assert column(spark, [q for q, _ in CLASSES], sqltext.query_type) == [t for _, t in CLASSES]


def test_looks_like_sql(spark):
    got = column(spark, [q for q, t in CLASSES if t != "ANON"] + ["hello", ""], sqltext.looks_like_sql)
    assert all(got[:-2]) and not any(got[-2:])


@pytest.mark.parametrize("dialect", ["postgres", "mysql"])
def test_bulk(spark, dialect):
    cases = {
        "COPY t TO '/x'": ("export", True) if dialect == "postgres" else None,
        "COPY sales FROM '/x'": ("import", None) if dialect == "postgres" else None,
        "COPY customers FROM '/x'": ("export", True) if dialect == "postgres" else None,  # cusTOmers
        "LOAD DATA INFILE '/x' INTO TABLE t": ("import", None) if dialect == "mysql" else None,
        "LOAD DATA LOCAL INFILE '/x' INTO TABLE t": None,
        "SELECT a FROM t INTO OUTFILE '/x'": ("export", True),
        "INSERT INTO t VALUES (1),(2)": ("insert", None),
        "INSERT INTO t (a, b, c) VALUES (1, 2, 3)": None,
        "SELECT * FROM t": ("export", True),
        "SELECT a, b FROM t": ("export", True),
        "SELECT COUNT(*) FROM t": None,
        "SELECT country FROM t": None,  # read as COUNT
        "SELECT * FROM t WHERE a = 1": None,
        "/* c */ SELECT * FROM t": None,
    }
    got = column(spark, list(cases), lambda q: sqltext.bulk_operation(q, dialect))
    assert [(r["bulk_type"], r["full_table_read"]) if r["bulk"] else None for r in got] == list(cases.values())


REFS = [
    ("SELECT ssn, email FROM patient WHERE patient_id = 1", {"patient": "patient"}, ["ssn", "email"]),
    ("SELECT p.ssn, e.diagnosis AS d FROM hc.patient p JOIN hc.encounter e ON p.id = e.id WHERE p.dob > 1 ORDER BY e.x", {"p": "patient", "patient": "patient", "e": "encounter", "encounter": "encounter"}, ["p.ssn", "e.diagnosis", "p.dob"]),
    ("SELECT * FROM patient p", {"p": "patient", "patient": "patient"}, ["*"]),
    ("INSERT INTO hc.patient (ssn, email) VALUES ('a', 'b')", {"patient": "patient"}, ["ssn", "email"]),
    ("UPDATE patient SET email = 'x', phone = 'y' WHERE patient.id = 3", {"patient": "patient"}, ["email", "phone", "patient.id"]),
    ("UPDATE patient AS p SET email = 'x'", {}, ["email"]),
    ("DELETE FROM hc.patient WHERE id = 3", {"patient": "patient"}, []),
    ("SELECT DISTINCT ssn FROM patient", {"patient": "patient"}, []),
    ("SELECT COUNT(*), 1, name FROM t -- x", {"t": "t"}, ["name"]),
    ("", {}, []),
    (None, {}, []),
]


def test_references(spark):
    got = column(spark, [q for q, _, _ in REFS], sqltext.query_refs)
    assert [(r["tables"], r["columns"]) for r in got] == [(t, c) for _, t, c in REFS]


def test_column_types(spark):
    cases = {"varchar(255)": "VARCHAR", "character varying(10)": "VARCHAR", "timestamp with time zone": "TIMESTAMPTZ", "double precision": "DOUBLE", "USER-DEFINED": "TEXT", "enum('a','b')": "VARCHAR", "integer": "INT", "decimal(12,2)": "DECIMAL", "uuid": "UUID", " citext ": "CITEXT"}
    assert column(spark, list(cases), sqltext.column_type) == list(cases.values())
