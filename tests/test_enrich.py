import json

import pytest

from tracehull.operators import enrich
from tracehull.sources import catalogue

SCHEMA = [
    ("healthcare", "patient", "patient_id", "uuid"), ("healthcare", "patient", "ssn", "varchar(11)"), ("healthcare", "patient", "email", "character varying(50)"), ("healthcare", "patient", "first_name", "text"),
    ("healthcare", "encounter", "diagnosis", "text"), ("healthcare", "encounter", "treatment", "text"), ("payments", "payment_method", "card_last4", "char(4)"), ("ops", "ledger", "contract_address", "text"), ("aaa", "drug", "name", "text"), ("zzz", "drug", "email", "text"),
]
CASES = [
    ("SELECT ssn, email FROM patient WHERE patient_id = 1", ["PII:email", "PII:ssn"], "medium"),
    ("SELECT diagnosis, treatment FROM encounter", ["PHI:diagnosis", "PHI:treatment"], "high"),
    ("SELECT p.ssn, e.diagnosis FROM healthcare.patient p JOIN healthcare.encounter e ON p.patient_id = e.patient_id", ["PHI:diagnosis", "PII:ssn"], "high"),
    ("SELECT * FROM patient p", ["PII:email", "PII:email", "PII:first_name", "PII:first_name", "PII:ssn", "PII:ssn"], "medium"),
    ("SELECT card_last4 FROM payments.payment_method", ["Financial:card_last4"], "high"),
    ("COPY (SELECT ssn, email FROM patient) TO '/tmp/x'", ["PII:ssn", "PII:email"], "medium"),
    ("SELECT contract_address FROM ledger", [], "low"),
    ("SELECT email FROM drug", [], "low"),
    ("SELECT x FROM nowhere", [], "low"),
    ("", [], "low"),
    (None, [], "low"),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(CASES)], "i int, raw_query string")


@pytest.mark.parametrize("joined", [False, True])
def test_labels_and_risk(spark, events, joined, monkeypatch):
    if joined:
        monkeypatch.setattr(enrich, "MAP_COLUMNS", 0)
    schema = catalogue.schema_frame(spark, SCHEMA)
    out = enrich.enrich(events, schema, catalogue.starter_dictionary(), catalogue.starter_policy(), emit_unknown=True)
    got = {r.i: (list(r.sensitivity), r.risk_level) for r in out.collect()}
    assert got == {i: (sorted(labels), level) for i, (_, labels, level) in enumerate(CASES)}


def test_emit_and_debug(spark, events):
    schema = catalogue.schema_frame(spark, SCHEMA)
    args = (schema, catalogue.starter_dictionary(), catalogue.starter_policy())
    assert enrich.enrich(events, *args).count() == 6
    rows = {r.i: r.debug_info for r in enrich.enrich(events, *args, emit_unknown=True, debug=True).collect()}
    assert rows[0].schema_status == "matched" and rows[0].category_matches == {"PII": ["patient.email", "patient.ssn"]}
    assert rows[8].schema_status == "unresolved" and rows[8].unresolved_tables == ["nowhere"] and rows[9].schema_status == "no_columns"
    distinct = enrich.enrich(events.where("i = 3"), *args, distinct_labels=True).first()
    assert list(distinct.sensitivity) == ["PII:email", "PII:first_name", "PII:ssn"]


def test_risk_combinations(spark):
    from pyspark.sql import functions as F

    policy = catalogue.starter_policy()
    assert policy.unreachable() == ["PII+PHI", "PII+Financial", "PHI+Financial", "PII+PHI+Financial"]
    df = spark.createDataFrame([(0, []), (1, ["PII"]), (2, ["Financial", "PII"]), (3, ["Other"]), (4, ["Other", "PII"])], "i int, c array<string>")
    level = lambda p: [r.r for r in df.select("i", enrich.risk_level(F.col("c"), p).alias("r")).orderBy("i").collect()]
    assert level(policy) == ["low", "medium", "high", "low", "medium"]
    assert level(policy.normalized()) == ["low", "medium", "critical", "low", "medium"]


def test_dictionary_checks(tmp_path):
    good = {"PII": [{"regex": "^a$", "expected_types": ["text"]}], "Negative": [{"regex": "x", "reason": "y"}]}
    d = catalogue.Dictionary.parse(good)
    assert d.rules[0].expected_types == ("TEXT",) and d.negatives == (("x", "y"),)
    for bad in ([], {}, {"PII": []}, {"PII": [{"regex": "a"}]}, {"PII": [{"regex": "(", "expected_types": ["t"]}]}, {"PII": [{"regex": "(?=a)", "expected_types": ["t"]}]}, {"Negative": [{"regex": "a", "reason": "b"}]}, {"negative": [{"regex": "a", "reason": "b"}]}):
        with pytest.raises(catalogue.ConfigError):
            catalogue.Dictionary.parse(bad)
    path = tmp_path / "risk.json"
    path.write_text(json.dumps({"base": {"PII": "odd"}, "default": "low"}))
    with pytest.raises(catalogue.ConfigError):
        catalogue.RiskPolicy.load(str(path))
    with pytest.raises(catalogue.ConfigError):
        catalogue.RiskPolicy({"PII": "low"}).check(["PHI"])
    assert catalogue.java_regex("^a$") == "(?d)^a\\z" and catalogue.java_regex("a\\$b") == "(?d)a\\$b"


def test_schema_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("db_name,schema_name,table_name,column_name,column_type\nd,s,t,a,varchar(10)\nd,s,t,b,\nshort,row\nd,s,t,c,decimal(12,2)\nd,s,t,a,integer\n")
    assert sorted(tuple(r) for r in catalogue.load_schema(spark, str(path)).collect()) == [("s", "t", "a", "INT"), ("s", "t", "c", "DECIMAL")]
    path.write_text("a,b\n")
    with pytest.raises(catalogue.ConfigError):
        catalogue.load_schema(spark, str(path))
