import json
import subprocess
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracehull import cli
from tracehull.functions import canonical
from tracehull.operators import chain, query
from tracehull.plans import generate, pipeline
from tracehull.sources import catalogue, lines
from tracehull.streaming import follow

EVENTS = [
    {"event_id": "1", "timestamp": "2025-01-15T10:00:00Z", "db_user": "alice", "query_type": "SELECT", "sensitivity": ["PII:email", "PII:name"], "risk_level": "high", "bulk": True},
    {"event_id": "2", "timestamp": "2025-01-15T11:00:00Z", "db_user": "bob", "query_type": "UPDATE", "sensitivity": ["Financial:card"], "risk_level": "medium", "bulk": False},
    {"event_id": "3", "timestamp": "2025-01-15T12:00:00Z", "db_user": "Alice", "query_type": "SELECT", "sensitivity": [], "risk_level": "low", "client_ip": "10.0.0.1"},
    {"event_id": "4", "timestamp": "bad", "db_user": "alice", "query_type": "ERROR", "bulk": "true"},
    {"event_id": "5", "timestamp": "2025-01-15 13:00:00", "db_user": 7, "query_type": "INSERT", "sensitivity": ["PHI:x:y"], "risk_level": "high", "bulk": True, "bulk_type": "insert", "own": {"b": 1, "a": "<"}},
]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    (folder / "a.jsonl").write_text("\n".join(json.dumps(e) for e in EVENTS[:3]) + "\n\n{broken\n")
    (folder / "b.jsonl").write_text("\n".join(json.dumps(e) for e in EVENTS[3:]) + "\nnull\n")
    return [str(folder / "a.jsonl"), str(folder / "b.jsonl")]


def hits(events, q):
    return [r.event_id for r in q.run(events.where(~F.col("_bad")), lines.ORDER).orderBy(*lines.ORDER).collect() if r.event_id]


def test_filters(spark, files):
    e = lines.read_events(spark, files)
    Q = query.Query
    assert e.where("_bad").count() == 1 and e.count() == 7
    for q, want in [
        (Q(user="ALICE"), "134"), (Q(sensitivity=["pii"]), "1"), (Q(sensitivity=["pii", "phi"]), "15"), (Q(fields=["email"]), "1"), (Q(fields=["x:y"]), "5"), (Q(types=["select"]), "13"), (Q(bulk=True), "15"), (Q(bulk_type="INSERT"), "5"),
        (Q(exclude_errors=True), "1235"), (Q(since=datetime(2025, 1, 15, 12, tzinfo=timezone.utc)), "35"), (Q(last=timedelta(hours=2), now=datetime(2025, 1, 15, 13, tzinfo=timezone.utc)), "235"), (Q(ip="10.0.0.1"), "3"), (Q(user="alice", exclude_errors=True), "13"), (Q(limit=2), "12"),
    ]:
        assert "".join(hits(e, q)) == want, q


def test_summary(spark, files):
    e = lines.read_events(spark, files)
    s = query.summary(e)
    assert (s["total_events_processed"], s["matched_events"], s["error_events"], s["bulk_operations"]) == (6, 6, 1, 2)
    assert s["by_sensitivity"] == {"PII": 2, "Financial": 1, "PHI": 1} and s["by_risk_level"] == {"high": 2, "medium": 1, "low": 1}
    assert s["time_range"] == {"start": "2025-01-15T10:00:00Z", "end": "2025-01-15T13:00:00Z"}
    cut = query.summary(e, query.Query(types=["SELECT", "UPDATE"], limit=2), lines.ORDER)
    assert cut["matched_events"] == 2 and cut["total_events_processed"] == 2
    text = query.summary_text(s)
    assert text.startswith("Summary:\n  Total events processed: 6\n  Time range: 2025") and "    PII: 2\n" in text


def test_canonical():
    cases = {
        '{"b":1,"a":"<x>"}': '{"a":"\\u003cx\\u003e","b":1}', '{"t":"2025-01-01T10:00:00.5+02:00","l":["2025-01-01T10:00:00.5Z"],"hash":"x"}': '{"l":["2025-01-01T10:00:00.5Z"],"t":"2025-01-01T08:00:00Z"}',
        '{"n":[1.0,1e21,1e-7,123456789012345680000,-0.0,0.1,1e20]}': '{"n":[1,1e+21,1e-7,123456789012345680000,-0,0.1,100000000000000000000]}', '{"a":1,"a":2}': '{"a":2}', "null": "{}", '{"s":"\\u2028\\n\\u0001é"}': '{"s":"\\u2028\\n\\u0001é"}',
    }
    for text, want in cases.items():
        assert canonical.canonical(text) == want
    for bad in ("[1]", "{", '{"a":NaN}', '{"a":1e999}'):
        with pytest.raises(ValueError):
            canonical.canonical(bad)


@pytest.mark.parametrize("parts", [1, 5])
def test_chain(spark, parts):
    rows = [(i, json.dumps({"id": i, "t": f"2025-01-01T00:00:{i % 60:02d}Z", "v": "x" * (i % 7)})) for i in range(200)]
    df = spark.createDataFrame(rows, "n int, line string").repartition(parts)
    sealed = chain.seal(df, "line", ["n"]).cache()
    head = chain.ZERO
    import hashlib

    for r in sealed.orderBy("n").collect():
        assert r.hash_prev == head
        head = hashlib.sha256(f"{head}|{canonical.canonical(rows[r.n][1])}".encode()).hexdigest()
        assert r.hash == head
    out = sealed.select("n", F.floor(F.col("n") / 40).alias("part"), "sealed")
    good = chain.verify(out, "sealed", ["part", "n"], ["part"])
    assert (good.status, good.events_processed, good.tampered_events, good.head) == ("pass", 200, [], head)
    edited = out.withColumn("sealed", F.when(F.col("n") == 57, F.regexp_replace("sealed", '"id":57', '"id":58')).otherwise(F.col("sealed")))
    assert chain.verify(edited, "sealed", ["part", "n"], ["part"]).tampered_events == [58]
    assert chain.verify(edited, "sealed", ["n"]).tampered_events == [58]
    removed = out.where("n <> 80")
    assert chain.verify(removed, "sealed", ["part", "n"], ["part"]).tampered_events == [82]
    assert chain.state_of(sealed).last_chain_index == 200
    more = chain.seal(spark.createDataFrame([(0, "{}")], "n int, line string"), "line", ["n"], chain.state_of(sealed)).first()
    assert (more.hash_prev, more.hash_chain_index) == (head, 201)


def test_fixed_chain_value(spark):
    r = chain.seal(spark.createDataFrame([(0, "{}")], "n int, line string"), "line", ["n"]).first()
    assert r.hash == "86f3be0d3f7230fa71629fd19978dd80dbfdcc9d4be8bfd6d643ea6cc7e568f3"


def test_files_state_and_checkpoint(spark, files, tmp_path):
    private, public = str(tmp_path / "k.pem"), str(tmp_path / "p.pem")
    try:
        subprocess.run(["openssl", "ecparam", "-name", "prime256v1", "-genkey", "-noout", "-out", private], check=True, capture_output=True)
        subprocess.run(["openssl", "ec", "-in", private, "-pubout", "-out", public], check=True, capture_output=True)
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("openssl is not there")
    source = tmp_path / "in.jsonl"
    source.write_text("\n".join(json.dumps(e) for e in EVENTS) + "\n")
    s = catalogue.Settings(private_key_path=private, public_key_path=public, state_file=str(tmp_path / "state.json"), checkpoint_path=str(tmp_path / "points"), run_log=str(tmp_path / "log.jsonl"))
    v = pipeline.run_hash(spark, str(source), str(tmp_path / "out"), s, checkpoint=True)
    point = next((tmp_path / "points").iterdir())
    checked = pipeline.run_verify(spark, str(tmp_path / "out"), s, str(point))
    assert (v.status, checked.status, checked.events_processed, checked.checkpoints_verified) == ("sealed", "pass", 5, 1)
    assert chain.ChainState.load(s.state_file) == chain.ChainState(5, v.head)
    body = json.loads(point.read_text())
    body["checkpoint"]["chain_index"] = 4
    point.write_text(json.dumps(body))
    assert pipeline.run_verify(spark, str(tmp_path / "out"), s, str(point)).status == "fail"
    assert len((tmp_path / "log.jsonl").read_text().splitlines()) == 3


def test_line_order_over_files(spark, tmp_path):
    big, small = tmp_path / "z.txt", tmp_path / "a.txt"
    big.write_text("\n".join(f"z{i}" for i in range(20_000)))
    small.write_text("\n".join(f"a{i}" for i in range(100)))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        got = [r.line for r in lines.read_lines(spark, [str(big), str(small)]).orderBy(*lines.ORDER).collect()]
    finally:
        spark.conf.set(key, old)
    assert got == [f"z{i}" for i in range(20_000)] + [f"a{i}" for i in range(100)]


def test_generator_to_summary(spark, tmp_path):
    ops = generate.workload(spark, generate.RunConfig(total_ops=300))
    assert {r.op for r in ops.collect()} == {"SELECT", "UPDATE"} and generate.workload_stats(ops).agg(F.sum("n")).first()[0] == 300
    for driver in ("postgres", "mysql"):
        made = generate.audit_lines(generate.workload(spark, generate.RunConfig(driver=driver, total_ops=300)), driver)
        made.select("line").coalesce(1).write.text(str(tmp_path / driver))
        row = pipeline.run_parse(spark, driver, str(tmp_path / driver), str(tmp_path / f"{driver}-events"), emit_raw=True, event_ids="hash")
        assert row == {"raw_count": 300, "parsed_count": 300, "rejected_count": 0}
    config = generate.LoadConfig(patients=50, encounters=60, drugs=20, orders=40)
    made = generate.tables(spark, config)
    counted = {r.table_name: r.n for r in generate.table_counts(made).collect()}
    assert counted["healthcare.patient"] == 50 and counted["payments.payment_method"] == 50 and 40 <= counted["pharmacy.pharmacy_order_item"] <= 120
    assert made["pharmacy.pharmacy_order"].join(made["healthcare.patient"], "patient_id").count() == 40
    (tmp_path / "schema.csv").write_text("db_name,schema_name,table_name,column_name,column_type\n" + "".join(f"d,{n.split('.')[0]},{n.split('.')[1]},{f.name},{'DATE' if f.name == 'dob' else 'TEXT' if f.name != 'card_last4' else 'CHAR'}\n" for n, df in made.items() for f in df.schema))
    (tmp_path / "dict.json").write_text(json.dumps({c: [{"regex": r.regex, "expected_types": list(r.expected_types)} for r in catalogue.starter_dictionary().rules if r.category == c] for c in ("PII", "PHI", "Financial")}))
    (tmp_path / "risk.json").write_text(json.dumps({"base": {"PII": "medium", "PHI": "high", "Financial": "high"}, "default": "low"}))
    done = pipeline.run_enrich(spark, str(tmp_path / "postgres-events"), str(tmp_path / "enriched"), str(tmp_path / "schema.csv"), str(tmp_path / "dict.json"), str(tmp_path / "risk.json"))
    assert done["input_events"] == 300 and 150 < done["enriched_events"] < 300 and done["error_events"] == 0
    assert cli.main(["query", "--input", str(tmp_path / "enriched"), "--sensitivity", "PHI", "--output", str(tmp_path / "hits"), "--summary"], spark) == 0
    found = lines.read_events(spark, str(tmp_path / "hits"))
    assert found.count() > 0 and found.where(~query.by_sensitivity(["PHI"])).count() == 0
    generate.write_seed(spark, str(tmp_path / "seed"), config)
    assert spark.read.text(str(tmp_path / "seed" / "01-healthcare.patient")).first()[0].startswith("INSERT INTO healthcare.patient (patient_id")


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0 and "tracehull" in capsys.readouterr().out
    assert cli.listed(" a, ,b ") == ["a", "b"]
    with pytest.raises(SystemExit):
        cli.question(cli.arguments().parse_args(["query", "--input", "x", "--since", "2025-01-01T00:00:00Z", "--last", "7d"]))


def test_streams(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    ops = generate.audit_lines(generate.workload(spark, generate.RunConfig(total_ops=20)))
    rows = [r.line for r in ops.orderBy("op_no").collect()]
    (folder / "a.log").write_text("\n".join(rows[:10] + ["noise"]))
    (folder / "b.log").write_text("\n".join(rows[10:]))
    q = follow.write_parsed(follow.follow_lines(spark, str(folder), 1), "postgres", str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.text(f"{tmp_path}/out/*").count() == 20 and spark.read.text(f"{tmp_path}/bad/*").count() == 1
    sealed = tmp_path / "jsonl"
    sealed.mkdir()
    (sealed / "1.jsonl").write_text('{"a":1}\n{"a":2}\n')
    for _ in range(2):
        follow.seal_stream(follow.follow_lines(spark, str(sealed), 1), str(tmp_path / "sealed"), str(tmp_path / "states"), str(tmp_path / "cp2")).awaitTermination()
        (sealed / "2.jsonl").write_text('{"a":3}\n')
    text = [r.value for b in (0, 1) for r in spark.read.text(f"{tmp_path}/sealed/batch={b}").collect()]
    df = spark.createDataFrame(list(enumerate(text)), "n int, line string")
    assert chain.verify(df, "line", ["n"]).status == "pass" and len(text) == 3
