"""Synthetic source tables and workload, made by hashing row numbers, so any size is made in parallel and alike in every run."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.sqltext import sql_escape

FIRST = ("Ada", "Ben", "Chloe", "Dev", "Elif", "Femi", "Grace", "Hugo", "Ines", "Jun", "Kofi", "Lena", "Mateo", "Noor", "Olga", "Priya", "Quinn", "Rosa", "Sven", "Tara")
LAST = ("Abbott", "Bauer", "Chen", "Diaz", "Eriksen", "Fontaine", "Garcia", "Haddad", "Ito", "Jensen", "Khan", "Lopez", "Mbeki", "Novak", "Okafor", "Patel", "Rossi", "Silva", "Tanaka", "Weber")
STREETS = ("Oak Street", "Mill Road", "Lake Avenue", "Hill Lane", "Station Road", "Park Way", "River Street", "Church Lane")
CITIES = (("Austin", "TX"), ("Boston", "MA"), ("Chicago", "IL"), ("Denver", "CO"), ("Fresno", "CA"), ("Miami", "FL"), ("Omaha", "NE"), ("Seattle", "WA"))
#: Invented names, made of parts so that any number of rows has many.
DRUG_HEADS, DRUG_TAILS = ("Alv", "Bren", "Cor", "Dex", "Elu", "Fen", "Gal", "Hyp", "Ion", "Jul", "Kel", "Lum"), ("adine", "ocor", "ivex", "umab", "ospan", "erol", "azine", "imox", "ytol", "enta")
FORMS, STRENGTHS = ("drops", "pills", "powder", "spray", "patches"), ("5 units", "20 units", "75 units", "150 units", "300 units")
MAKERS = ("Northwind Labs", "Bluebank Remedies", "Fernhill Works", "Okra Street Co", "Lantern Health")
FINDINGS, PLACES = ("Strain of the", "Swelling of the", "Rash on the", "Pain in the", "Stiffness of the", "Numbness in the"), ("left knee", "right knee", "lower back", "neck", "left wrist", "right ankle", "shoulder", "jaw")
STATUSES = ("PENDING", "SHIPPED", "DELIVERED", "CANCELLED")
NOTE_WORDS = ("patient", "reports", "mild", "pain", "stable", "review", "dose", "rest", "daily", "follow", "improved", "noted")
#: All times lie in the year before this one.
EPOCH = "2025-09-01 00:00:00"


@dataclass(frozen=True)
class LoadConfig:
    driver: str = "postgres"
    seed: int = 42
    patients: int = 1000
    encounters: int = 2000
    drugs: int = 200
    orders: int = 1500
    users: int = 5
    database: str = "practicumdb"


@dataclass(frozen=True)
class RunConfig:
    driver: str = "postgres"
    seed: int = 42
    run_id: str = "demo001"
    concurrency: int = 5
    total_ops: int = 200
    mix: dict[str, float] = field(default_factory=lambda: {"select": 0.7, "update": 0.3})
    sensitivity: dict[str, float] = field(default_factory=lambda: {"sensitive_only": 0.4, "mixed": 0.4, "non_sensitive_only": 0.2})
    users: tuple[str, ...] = ("appuser1", "appuser2", "appuser3", "appuser4", "appuser5")


def load_config(path: str, kind: type):
    """LoadConfig or RunConfig from YAML (or JSON); keys may be written in camel case."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        data = json.loads(text)
    else:
        data = yaml.safe_load(text)
    names = {"dbUsers": "users", "runId": "run_id", "totalOps": "total_ops"}
    data = {names.get(k, k): v for k, v in data.items()}
    if kind is RunConfig and "users" in data:
        data["users"] = tuple(u["username"] if isinstance(u, dict) else u for u in data["users"])
    return kind(**{k: v for k, v in data.items() if k in kind.__dataclass_fields__})


def shares(mix: dict[str, float], default: dict[str, float]) -> dict[str, float]:
    """A mix as shares of 1; a mix of nothing is the default."""
    total = sum(mix.values())
    return {k: v / total for k, v in mix.items()} if total > 0 else default


class _Dice:
    """Hash-based choices of a row, apart by name."""

    def __init__(self, seed: int, table: str):
        self.seed, self.table = seed, table

    def number(self, what: str, most: int | Column) -> Column:
        """0 .. most-1."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(f"{self.table}.{what}"), F.col("id")), most if isinstance(most, Column) else F.lit(most))

    def pick(self, what: str, options) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), (self.number(what, len(options)) + 1).cast("int"))

    def money(self, what: str, low: int, high: int) -> Column:
        return ((self.number(what, (high - low) * 100) + low * 100) / 100).cast("decimal(12,2)")

    def time(self, what: str) -> Column:
        return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) - self.number(what, 365 * 86400))


def key(table: str, seed: int, number: Column) -> Column:
    """The id of a row in the form of a UUID."""
    h = F.md5(F.concat_ws(":", F.lit(table), F.lit(str(seed)), number.cast("string")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def patients(spark: SparkSession, c: LoadConfig) -> DataFrame:
    d = _Dice(c.seed, "patient")
    first, last = d.pick("first", FIRST), d.pick("last", LAST)
    made = d.time("created")
    # a step that shares no factor with 10 ** 9 deals all numbers out before one returns
    number = F.pmod(F.col("id") * 387_420_489 + c.seed, F.lit(10**9))
    return spark.range(c.patients).select(
        key("patient", c.seed, F.col("id")).alias("patient_id"), F.format_string("%03d-%02d-%04d", F.floor(number / 1_000_000), F.pmod(F.floor(number / 10_000), F.lit(100)), F.pmod(number, F.lit(10_000))).alias("ssn"),
        first.alias("first_name"), last.alias("last_name"), F.date_sub(F.lit("2005-01-01").cast("date"), d.number("dob", 25_000).cast("int")).alias("dob"),
        F.format_string("%s.%s%d@example.org", F.lower(first), F.lower(last), F.col("id")).alias("email"), F.format_string("+1-%03d-%03d-%04d", d.number("p1", 900) + 100, d.number("p2", 900), d.number("p3", 10_000)).alias("phone_number"),
        F.format_string("%d %s", d.number("house", 9_999) + 1, d.pick("street", STREETS)).alias("address_line1"), F.lit("").alias("address_line2"), d.pick("city", [x for x, _ in CITIES]).alias("city"),
        d.pick("city", [x for _, x in CITIES]).alias("state"), F.format_string("%05d", d.number("zip", 99_999) + 1).alias("postal_code"), F.lit("US").alias("country"), made.alias("created_at"), made.alias("updated_at"),
    )


def drugs(spark: SparkSession, c: LoadConfig) -> DataFrame:
    d = _Dice(c.seed, "drug")
    return spark.range(c.drugs).select(
        key("drug", c.seed, F.col("id")).alias("drug_id"), F.concat(d.pick("head", DRUG_HEADS), d.pick("tail", DRUG_TAILS)).alias("name"), d.pick("form", FORMS).alias("dosage_form"), d.pick("strength", STRENGTHS).alias("strength"),
        d.pick("maker", MAKERS).alias("manufacturer"), d.money("price", 5, 500).alias("price"), d.number("stock", 501).cast("int").alias("stock_qty"), F.lit(True).alias("active"),
    )


def payment_methods(spark: SparkSession, c: LoadConfig) -> DataFrame:
    """One a patient."""
    d = _Dice(c.seed, "payment")
    return spark.range(c.patients).select(
        key("payment", c.seed, F.col("id")).alias("payment_method_id"), key("patient", c.seed, F.col("id")).alias("patient_id"), F.lit("VISA").alias("card_network"),
        (d.number("last4", 9000) + 1000).cast("string").alias("card_last4"), key("token", c.seed, F.col("id")).alias("payment_token"), d.time("created").alias("created_at"),
    )


def orders(spark: SparkSession, c: LoadConfig) -> DataFrame:
    """Patient and payment method are drawn apart, so they need not belong together."""
    d = _Dice(c.seed, "order")
    return spark.range(c.orders).select(
        key("order", c.seed, F.col("id")).alias("order_id"), key("patient", c.seed, d.number("patient", c.patients)).alias("patient_id"), d.time("ts").alias("order_ts"), d.pick("status", STATUSES).alias("status"),
        d.money("total", 10, 1000).alias("total_price"), key("payment", c.seed, d.number("method", c.patients)).alias("payment_method_id"),
        F.format_string("%d %s", d.number("house", 9_999) + 1, d.pick("street", STREETS)).alias("shipping_address"), F.concat_ws(" ", d.pick("f", FIRST), d.pick("l", LAST)).alias("fulfilled_by"),
    )


def order_items(spark: SparkSession, c: LoadConfig) -> DataFrame:
    """One to three different drugs an order."""
    d = _Dice(c.seed, "item")
    lines = spark.range(c.orders).select("id", F.explode(F.sequence(F.lit(0), d.number("n", 3).cast("int"))).alias("line"))
    first = F.pmod(F.xxhash64(F.lit(c.seed), F.lit("item.drug"), F.col("id")) + F.col("line") * 7919, F.lit(c.drugs))
    each = lambda what, n: F.pmod(F.xxhash64(F.lit(c.seed), F.lit(what), F.col("id"), F.col("line")), F.lit(n))
    return lines.select(
        key("order", c.seed, F.col("id")).alias("order_id"), key("drug", c.seed, first).alias("drug_id"), (each("quantity", 5) + 1).cast("int").alias("quantity"), ((each("price", 19_900) + 100) / 100).cast("decimal(12,2)").alias("unit_price")
    ).dropDuplicates(["order_id", "drug_id"])


def encounters(spark: SparkSession, c: LoadConfig) -> DataFrame:
    d = _Dice(c.seed, "encounter")
    note = F.concat_ws(" ", *[d.pick(f"w{i}", NOTE_WORDS) for i in range(10)])
    return spark.range(c.encounters).select(
        key("encounter", c.seed, F.col("id")).alias("encounter_id"), key("patient", c.seed, d.number("patient", c.patients)).alias("patient_id"), d.time("ts").alias("encounter_ts"), F.concat_ws(" ", d.pick("finding", FINDINGS), d.pick("place", PLACES)).alias("diagnosis"),
        F.format_string("Treatment plan %d", d.number("plan", 100) + 1).alias("treatment"), F.concat(F.lit("Dr. "), d.pick("doctor", LAST)).alias("provider_name"), note.alias("notes"),
    )


def tables(spark: SparkSession, c: LoadConfig | None = None) -> dict[str, DataFrame]:
    """All generated tables by their qualified names, in the order they are loaded."""
    c = c or LoadConfig()
    return {
        "healthcare.patient": patients(spark, c), "pharmacy.drug": drugs(spark, c), "payments.payment_method": payment_methods(spark, c),
        "pharmacy.pharmacy_order": orders(spark, c), "pharmacy.pharmacy_order_item": order_items(spark, c), "healthcare.encounter": encounters(spark, c),
    }


def table_counts(generated: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in generated.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def database_table(name: str, driver: str) -> str:
    """A table's name in a database: MySQL has no schemas but for the order table, which goes without its prefix."""
    return name if driver == "postgres" else "pharmacy_order" if name == "pharmacy.pharmacy_order" else name.replace(".", "_")


_SQL_TYPES = {"string": "TEXT", "date": "DATE", "timestamp": "TIMESTAMP", "int": "INT", "boolean": "BOOLEAN", "decimal(12,2)": "NUMERIC(12,2)"}


#: Keys of the generated tables: primary key, unique columns, and what other columns refer to.
KEYS = {
    "healthcare.patient": (("patient_id",), ("ssn", "email"), {}),
    "pharmacy.drug": (("drug_id",), (), {}),
    "payments.payment_method": (("payment_method_id",), ("payment_token",), {"patient_id": "healthcare.patient"}),
    "pharmacy.pharmacy_order": (("order_id",), (), {"patient_id": "healthcare.patient", "payment_method_id": "payments.payment_method"}),
    "pharmacy.pharmacy_order_item": (("order_id", "drug_id"), (), {"order_id": "pharmacy.pharmacy_order", "drug_id": "pharmacy.drug"}),
    "healthcare.encounter": (("encounter_id",), (), {"patient_id": "healthcare.patient"}),
}


def constraints(name: str, driver: str) -> list[str]:
    primary, unique, others = KEYS[name]
    out = [f"PRIMARY KEY ({', '.join(primary)})", *[f"UNIQUE ({c})" for c in unique]]
    return out + [f"FOREIGN KEY ({c}) REFERENCES {database_table(t, driver)} ({c})" for c, t in others.items()]


def ddl(generated: dict[str, DataFrame], driver: str = "postgres") -> list[str]:
    out = [f"CREATE SCHEMA IF NOT EXISTS {s};" for s in dict.fromkeys(n.split(".")[0] for n in generated)] if driver == "postgres" else []
    for name, df in generated.items():
        keyed = {c for part in KEYS[name] for c in part}
        columns = [f"{f.name} {'VARCHAR(64)' if f.name in keyed and f.dataType.simpleString() == 'string' else _SQL_TYPES[f.dataType.simpleString()]}" for f in df.schema]
        out.append(f"CREATE TABLE IF NOT EXISTS {database_table(name, driver)} ({', '.join([*columns, *constraints(name, driver)])});")
    return out


def user_grants(c: LoadConfig) -> list[str]:
    out = []
    for i in range(1, c.users + 1):
        if c.driver == "postgres":
            out += [f"CREATE USER appuser{i} WITH PASSWORD 'password{i}';", f"GRANT CONNECT ON DATABASE {c.database} TO appuser{i};"]
        else:
            out += [f"CREATE USER IF NOT EXISTS 'appuser{i}'@'%' IDENTIFIED BY 'password{i}';", f"GRANT SELECT, INSERT, UPDATE, DELETE ON {c.database}.* TO 'appuser{i}'@'%';"]
    return out


def inserts(name: str, df: DataFrame, driver: str = "postgres") -> DataFrame:
    """One INSERT statement a row, as ``value``."""
    shown = []
    for f in df.schema:
        c = F.col(f.name).cast("string")
        shown.append(F.coalesce(c if f.dataType.simpleString() in ("int", "boolean", "decimal(12,2)") else F.concat(F.lit("'"), sql_escape(c), F.lit("'")), F.lit("NULL")))
    return df.select(F.concat(F.lit(f"INSERT INTO {database_table(name, driver)} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *shown), F.lit(");")).alias("value"))


def indexes(driver: str = "postgres") -> list[str]:
    wanted = (("healthcare.encounter", "patient_id"), ("pharmacy.pharmacy_order", "patient_id"), ("payments.payment_method", "patient_id"), ("pharmacy.pharmacy_order_item", "drug_id"))
    return [f"CREATE INDEX idx_{n.split('.')[1]}_{c} ON {database_table(n, driver)} ({c});" for n, c in wanted]


def write_seed(spark: SparkSession, folder: str, c: LoadConfig | None = None) -> None:
    """The seed as SQL text: definitions and users first, one folder a table, indexes last."""
    c = c or LoadConfig()
    generated = tables(spark, c)
    spark.createDataFrame([(x,) for x in [*ddl(generated, c.driver), *user_grants(c)]], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/00-definitions")
    for i, (name, df) in enumerate(generated.items(), 1):
        inserts(name, df, c.driver).write.mode("overwrite").text(f"{folder}/{i:02d}-{name}")
    spark.createDataFrame([(x,) for x in indexes(c.driver)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/99-indexes")


# Workload -----------------------------------------------------------------------

#: FIXED VALUES. Statements by operation and sensitivity; ? is a parameter, tables stand by their qualified names.
TEMPLATES = {
    ("SELECT", "sensitive_only"): "SELECT p.patient_id, p.ssn, p.first_name, p.last_name, p.dob, p.email, p.phone_number, p.address_line1, p.city, p.state, pm.card_last4, pm.card_network "
    "FROM healthcare.patient p JOIN payments.payment_method pm ON p.patient_id = pm.patient_id WHERE p.patient_id = ? LIMIT 5",
    ("SELECT", "mixed"): "SELECT p.email, p.phone_number, p.first_name, p.last_name, e.diagnosis, e.treatment, e.notes, o.shipping_address, pm.card_last4, pm.payment_token "
    "FROM healthcare.patient p JOIN healthcare.encounter e ON p.patient_id = e.patient_id JOIN pharmacy.pharmacy_order o ON p.patient_id = o.patient_id "
    "JOIN payments.payment_method pm ON p.patient_id = pm.patient_id WHERE p.patient_id = ? LIMIT 5",
    ("SELECT", "non_sensitive_only"): "SELECT drug_id, name, price, stock_qty FROM pharmacy.drug WHERE drug_id = ?",
    ("UPDATE", "sensitive_only"): "UPDATE healthcare.patient SET phone_number=? WHERE patient_id=?",
    ("UPDATE", "mixed"): "UPDATE pharmacy.pharmacy_order SET shipping_address=? WHERE order_id=?",
    ("UPDATE", "mixed_treatment"): "UPDATE healthcare.encounter SET treatment=? WHERE encounter_id=?",
    ("UPDATE", "non_sensitive_only"): "UPDATE pharmacy.drug SET stock_qty=? WHERE drug_id=?",
}


def template(op: str, sensitivity: str, driver: str) -> str:
    text = TEMPLATES[op, sensitivity]
    for name in ("healthcare.patient", "healthcare.encounter", "pharmacy.pharmacy_order", "payments.payment_method", "pharmacy.drug"):
        text = text.replace(name, database_table(name, driver))
    if driver == "postgres":
        for i in range(1, text.count("?") + 1):
            text = text.replace("?", f"${i}", 1)
    return text


def workload(spark: SparkSession, c: RunConfig | None = None) -> DataFrame:
    """op_no, op, sensitivity, db_user, ts, sql: annotated statements by the configured mix; a worker keeps one user."""
    c = c or RunConfig()
    d = _Dice(c.seed, "run")
    ops = shares(c.mix, {"select": 0.7, "update": 0.3})
    kinds = shares(c.sensitivity, {"sensitive_only": 0.4, "mixed": 0.4, "non_sensitive_only": 0.2})
    op = F.when(d.number("op", 1_000_000) < int(ops.get("select", 0) * 1_000_000), "SELECT").otherwise("UPDATE")
    roll, below, kind = d.number("kind", 1_000_000), 0.0, None
    for name in ("sensitive_only", "mixed"):
        below += kinds.get(name, 0)
        kind = F.when(roll < int(below * 1_000_000), name) if kind is None else kind.when(roll < int(below * 1_000_000), name)
    worker = F.pmod(F.col("id"), F.lit(c.concurrency))
    user = F.element_at(F.array(*[F.lit(u) for u in c.users]), (F.pmod(F.xxhash64(F.lit(c.seed), worker), F.lit(len(c.users))) + 1).cast("int"))
    rows = spark.range(c.total_ops).select("id", op.alias("op"), kind.otherwise("non_sensitive_only").alias("sensitivity"), user.alias("db_user"), F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.col("id")).alias("ts"), (d.number("half", 2) == 0).alias("half"))
    text = None
    for o, s in TEMPLATES:
        hit = (F.col("op") == o) & (F.col("sensitivity") == s.replace("_treatment", "")) & (~F.col("half") if s.endswith("_treatment") else F.lit(True) if (o, s) != ("UPDATE", "mixed") else F.col("half"))
        text = F.when(hit, template(o, s, c.driver)) if text is None else text.when(hit, template(o, s, c.driver))
    note = F.format_string(f"/* run_id={c.run_id} op=%s sensitivity=%s user=%s ts=%s */ ", F.lower("op"), "sensitivity", "db_user", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return rows.select(F.col("id").alias("op_no"), "op", "sensitivity", "db_user", "ts", F.concat(note, text).alias("sql"))


def audit_lines(ops: DataFrame, driver: str = "postgres") -> DataFrame:
    """The lines a database's audit log would hold for ``ops``, as ``line`` beside op_no."""
    if driver == "postgres":
        line = F.format_string(
            "%s.000 UTC [%d] LOG:  AUDIT: SESSION,%d,1,%s,%s,,,\"%s\",<not logged>",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.pmod("op_no", F.lit(5)) + 9000, F.col("op_no") + 1, F.when(F.col("op") == "SELECT", "READ").otherwise("WRITE"), "op", F.replace("sql", F.lit('"'), F.lit('""')),
        )
    else:
        record = F.struct(
            F.lit("Query").alias("name"), F.concat_ws("_", "op_no", F.date_format("ts", "yyyy-MM-dd")).alias("record"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lower("op").alias("command_class"),
            (F.pmod("op_no", F.lit(5)) + 10).cast("string").alias("connection_id"), F.lit(0).alias("status"), F.col("sql").alias("sqltext"), F.format_string("%s[%s] @ localhost []", "db_user", "db_user").alias("user"),
            F.lit("localhost").alias("host"), F.lit("").alias("os_user"), F.lit("127.0.0.1").alias("ip"), F.lit("practicumdb").alias("db"),
        )
        line = F.to_json(F.struct(record.alias("audit_record")))
    return ops.select("op_no", line.alias("line"))


def workload_stats(ops: DataFrame) -> DataFrame:
    """Operations by kind and sensitivity with their share in percent."""
    total = ops.agg(F.count(F.lit(1)).alias("_t"))
    return ops.groupBy("op", "sensitivity").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("op", "sensitivity", "n", F.round(100 * F.col("n") / F.col("_t"), 1).alias("percent"))
