from tracehull.functions import timestamps
from tracehull.operators import parse

AUDIT = "2024-02-29 07:13:05.250 UTC [52] LOG:  AUDIT: SESSION,"


def rows(spark, lines, database, emit_raw=True):
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    return parse.parse(df, database, emit_raw, "hash").orderBy("n").collect()


def test_postgres_lines(spark):
    got = rows(
        spark,
        [
            AUDIT + """31,1,WRITE,INSERT,,, "INSERT INTO lockers (num, owner) VALUES (12, 'Mina');",<not logged>""",
            "2024-02-29 07:10:00 UTC [52] LOG:  connection authorized: user=mina database=gym",
            "2024-02-29 07:11:00 UTC [52] LOG:  connection failed for user=otto",
            "2024-02-29 07:12:00 UTC [52] LOG:  disconnection: session time: 0:00:09. user=pia database=pool",
            "checkpointer woke up",
            AUDIT + '32,3,WRITE,ALTER,TABLE,lockers, "ALTER TABLE lockers ADD COLUMN colour text;",<not logged>',
            AUDIT + '33,1,READ,SELECT,,, "/* run_id=z9 op=select user=member2 ts=x */ SELECT l.num FROM gym.lockers l WHERE l.num = $1 LIMIT 5",<not logged>',
            AUDIT + "34,1,DDL,CREATE TABLE,TABLE,towels,CREATE TABLE towels (n int),<not logged>",
            '2024-02-29 07:13:06 UTC LOG:  statement: SELECT 1 FROM lockers',
            "",
            None,
            AUDIT + "1,2,3",
        ],
        "pg",
    )
    assert [(r.outcome, r.query_type if r.outcome == "OK" else None) for r in got] == [
        ("OK", "INSERT"), ("OK", "LOGIN_SUCCESS"), ("OK", "LOGIN_FAILURE"), ("OK", "LOGOUT"), ("SKIP", None), ("OK", "ALTER"), ("OK", "SELECT"), ("OK", "CREATE"), ("OK", "SELECT"), ("SKIP", None), ("SKIP", None), ("SKIP", None),
    ]
    assert (got[0].audit_class, got[0].session_id, got[0].command_id, got[0].action, got[0].statement_type) == ("SESSION", 31, 1, "WRITE", "INSERT")
    assert got[0].timestamp == "2024-02-29T07:13:05Z" and got[0].raw_query == "INSERT INTO lockers (num, owner) VALUES (12, 'Mina');"
    assert [(r.db_user, r.db_name) for r in got[1:4]] == [("mina", "gym"), ("otto", None), ("pia", "pool")]
    assert got[5].meta == {"object_type": "TABLE", "object_name": "lockers"}
    assert (got[6].db_user, got[6].bulk) == ("member2", None)


def test_raw_only_on_request(spark):
    line = AUDIT + '1,1,READ,SELECT,,,"SELECT * FROM t",x'
    assert rows(spark, [line], "postgres", False)[0].raw_query is None
    r = rows(spark, [line], "postgres")[0]
    assert (r.raw_query, r.bulk, r.bulk_type, r.full_table_read) == ("SELECT * FROM t", True, "export", True)


def test_mysql_records(spark):
    record = '{"audit_record":{"name":"%s","record":"1_2","timestamp":"2025-09-13T14:00:00Z","command_class":"%s","connection_id":"12345","status":%d,"sqltext":"%s","user":"root[root] @ localhost []","host":"localhost","os_user":"","ip":"","db":"shop"}}'
    got = rows(
        spark,
        [
            record % ("Query", "select", 0, "SELECT * FROM users"),
            record % ("Connect", "connect", 1045, ""),
            record % ("Quit", "quit", 0, ""),
            record % ("Query", "error", 1064, "INSERT INTO t VALUES (1)"),
            record % ("Query", "grant", 0, "GRANT ALL PRIVILEGES ON *.* TO bob"),
            record % ("Query", "", 0, "DROP TABLE t"),
            '<AUDIT_RECORD NAME="Query" TIMESTAMP="2025-09-13T14:00:00 UTC" COMMAND_CLASS="update" CONNECTION_ID="54321" STATUS="0" SQLTEXT="UPDATE t SET a=&apos;x&apos;" USER="bob" HOST="h" IP="10.0.0.1" DB="d" RECORD="7"/>',
            '{"foo":"bar"}',
            "garbage",
            '{"audit_record": 5}',
            "<OTHER NAME='x'/>",
        ],
        "mysql",
    )
    assert [(r.outcome, r.query_type if r.outcome == "OK" else None) for r in got] == [
        ("OK", "SELECT"), ("OK", "LOGIN_FAILURE"), ("OK", "LOGOUT"), ("OK", "INSERT"), ("OK", "GRANT_ESCALATION"), ("OK", "DROP"), ("OK", "UPDATE"), ("SKIP", None), ("SKIP", None), ("PARSE_ERROR", None), ("SKIP", None),
    ]
    r, x = got[0], got[6]
    assert (r.db_user, r.db_name, r.client_ip, r.connection_id, r.status, r.bulk_type) == ("root", "shop", "localhost", 12345, 0, "export")
    assert r.meta == {"record": "1_2", "name": "Query", "os_user": ""}
    assert (x.raw_query, x.client_ip, x.connection_id, x.timestamp) == ("UPDATE t SET a='x'", "10.0.0.1", 54321, "2025-09-13T14:00:00Z")


def test_postgres_json(spark):
    r = rows(spark, ['{"timestamp":"2025-09-19T12:00:00Z","user":"alice","db":"sales","host":"h","statement":"SELECT * FROM c"}'], "postgres_json")[0]
    assert (r.outcome, r.db_user, r.db_name, r.client_ip, r.query_type) == ("OK", "alice", "sales", "h", "SELECT")


def test_unknown_database(spark):
    try:
        parse.parser("oracle")
    except ValueError as e:
        assert "oracle" in str(e)
    else:
        raise AssertionError


def test_counters_and_rejects(spark):
    df = spark.createDataFrame([(1, "noise"), (2, AUDIT + '1,1,READ,SELECT,,,"SELECT 1",x')], "n int, line string")
    parsed = parse.parse(df, "postgres", event_ids="hash")
    assert parse.counters(parsed).first().asDict() == {"raw_count": 2, "parsed_count": 1, "rejected_count": 1}
    r = parse.rejects(parsed).first()
    assert (r.query_type, r.raw_query) == ("SKIP", "noise")


def test_timestamps(spark):
    cases = {
        "2025-09-13 14:38:06 UTC": "2025-09-13T14:38:06Z", "2025-09-13 14:38:06.767 UTC": "2025-09-13T14:38:06.767Z", "2025-09-13 14:38:06+05:30": "2025-09-13T09:08:06Z", "2025-09-13 14:38:06.123+05:30": "2025-09-13T09:08:06.123Z",
        "2025-09-13T14:38:06Z": "2025-09-13T14:38:06Z", "May 8, 2009 5:57:51 PM": "2009-05-08T17:57:51Z", "1384216367": "2013-11-12T00:32:47Z", "rubbish": None, "": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.r for r in timestamps.with_normal_time(df, "t", "r").orderBy("i").collect()] == list(cases.values())


def test_durations():
    assert timestamps.parse_duration("7d").days == 7 and timestamps.parse_duration("1h30m").seconds == 5400 and timestamps.parse_duration("24h").days == 1
    for bad in ("", "1.5h", "2d12h", "x", "-3d"):
        try:
            timestamps.parse_duration(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
