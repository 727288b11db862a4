"""Small driver-side inputs: schema catalogue, sensitivity dictionary, risk policy, configuration."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sqltext
from ..schemas import SCHEMA_CATALOGUE

HEADER = ["db_name", "schema_name", "table_name", "column_name", "column_type"]
#: Risk levels by rank.
LEVELS = ("low", "medium", "high", "critical")
NEGATIVE = "Negative"


class ConfigError(ValueError):
    """A dictionary, policy, catalogue or configuration that cannot be used."""


def schema_frame(spark: SparkSession, rows: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """(schema, table, column, type) rows with normalised types; the last of repeated columns wins."""
    last = {(s, t, c): k for s, t, c, k in rows}
    frame = spark.createDataFrame([(*key, kind) for key, kind in last.items()], SCHEMA_CATALOGUE)
    return frame.withColumn("column_type", sqltext.column_type(F.col("column_type")))


def load_schema(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue from CSV with the exact header; rows that are short or have an empty field are passed over, extra commas belong to the type."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    rows = list(csv.reader(text.splitlines(), skipinitialspace=True))
    if not rows or [h.strip() for h in rows[0]] != HEADER:
        raise ConfigError(f"{path}: the header must be {','.join(HEADER)}")
    good = []
    for row in rows[1:]:
        if len(row) < len(HEADER):
            continue
        fields = [x.strip() for x in [*row[:4], ",".join(row[4:])]]
        if all(fields):
            good.append(tuple(fields[1:]))
    return schema_frame(spark, good)


def java_regex(pattern: str) -> str:
    """A user's pattern for Java: a final $ means the very end, . excludes line feeds only. Look-around and back references are refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise ConfigError(f"pattern uses look-around or back references: {pattern}")
    try:
        re.compile(re.sub(r"\\z", r"\\Z", pattern))
    except re.error as e:
        raise ConfigError(f"pattern does not compile: {pattern}: {e}") from e
    return "(?d)" + re.sub(r"(?<!\\)\$(?=$|\)|\|)", r"\\z", pattern)


@dataclass(frozen=True)
class Rule:
    category: str
    regex: str
    expected_types: tuple[str, ...] = ()
    sample_pattern: str | None = None


@dataclass(frozen=True)
class Dictionary:
    """Sensitivity rules by category, and negative rules that veto a column name."""

    rules: tuple[Rule, ...]
    negatives: tuple[tuple[str, str], ...] = ()

    @property
    def categories(self) -> list[str]:
        return sorted({r.category for r in self.rules})

    @classmethod
    def parse(cls, data: object) -> Dictionary:
        if not isinstance(data, dict):
            raise ConfigError("the dictionary must be an object")
        rules, negatives = [], []
        for category, entries in data.items():
            if not isinstance(entries, list) or not entries:
                raise ConfigError(f"category {category} must be a list with entries")
            for entry in entries:
                if not isinstance(entry, dict) or not isinstance(entry.get("regex"), str) or not entry["regex"]:
                    raise ConfigError(f"category {category}: an entry has no regex")
                java_regex(entry["regex"])
                if category == NEGATIVE:
                    if not isinstance(entry.get("reason"), str) or not entry["reason"]:
                        raise ConfigError("a negative entry has no reason")
                    negatives.append((entry["regex"], entry["reason"]))
                    continue
                types = entry.get("expected_types")
                if not isinstance(types, list) or not types:
                    raise ConfigError(f"category {category}: an entry has no expected_types")
                rules.append(Rule(category, entry["regex"], tuple(str(t).upper() for t in types), entry.get("sample_pattern")))
        if not rules:
            raise ConfigError("the dictionary has no category")
        return cls(tuple(rules), tuple(negatives))

    @classmethod
    def load(cls, path: str) -> Dictionary:
        with open(path) as f:
            return cls.parse(json.load(f))


@dataclass(frozen=True)
class RiskPolicy:
    """Levels by category and by combination of categories (sorted, joined by +), and the level of none."""

    base: dict[str, str]
    combinations: dict[str, str] = field(default_factory=dict)
    default: str = "low"

    def check(self, categories: Iterable[str] = ()) -> RiskPolicy:
        if not self.base:
            raise ConfigError("the policy has no base levels")
        for where, level in [*self.base.items(), *self.combinations.items(), ("default", self.default)]:
            if level not in LEVELS:
                raise ConfigError(f"{where}: {level!r} is no risk level")
        missing = sorted(set(categories) - set(self.base))
        if missing:
            raise ConfigError(f"no base level for {', '.join(missing)}")
        return self

    def unreachable(self) -> list[str]:
        """Combination keys that are not in sorted order, so that no event can match them."""
        return [k for k in self.combinations if k != "+".join(sorted(k.split("+")))]

    def normalized(self) -> RiskPolicy:
        """The policy with its combination keys put in sorted order."""
        return RiskPolicy(self.base, {"+".join(sorted(k.split("+"))): v for k, v in self.combinations.items()}, self.default)

    @classmethod
    def parse(cls, data: object) -> RiskPolicy:
        if not isinstance(data, dict) or not isinstance(data.get("base"), dict) or not data.get("default"):
            raise ConfigError("the policy needs base and default")
        return cls(dict(data["base"]), dict(data.get("combinations") or {}), data["default"]).check()

    @classmethod
    def load(cls, path: str) -> RiskPolicy:
        with open(path) as f:
            return cls.parse(json.load(f))


#: The rules a deployment starts from: category, pattern, column types.
STARTER_RULES = (
    ("PII", "(?i)^ssn$", ("VARCHAR", "CHAR", "TEXT")),
    ("PII", "(?i)^dob$", ("DATE",)),
    ("PII", "(?i)^email$", ("VARCHAR", "TEXT")),
    ("PII", "(?i)^(first_?|last_?)name$", ("VARCHAR", "TEXT")),
    ("PII", "(?i)address", ("VARCHAR", "TEXT")),
    ("PII", "(?i)^phone", ("VARCHAR", "TEXT")),
    ("PHI", "(?i)^diagnosis$", ("TEXT",)),
    ("PHI", "(?i)^treatment$", ("TEXT",)),
    ("PHI", "(?i)^dosage_?instructions?$", ("TEXT",)),
    ("PHI", "(?i)^notes$", ("TEXT",)),
    ("Financial", "(?i)^card_?last4$", ("CHAR", "VARCHAR")),
    ("Financial", "(?i)^card_?network$", ("VARCHAR", "TEXT")),
    ("Financial", "(?i)^payment_?token$", ("CHAR", "UUID", "VARCHAR")),
)
STARTER_NEGATIVES = (("(?i)^system_state$", "not personal"), ("(?i)^contract_address$", "not personal"))


def starter_dictionary() -> Dictionary:
    return Dictionary(tuple(Rule(*r) for r in STARTER_RULES), STARTER_NEGATIVES)


def starter_policy() -> RiskPolicy:
    """The shipped levels. The combination keys stand unsorted, as shipped, so none of them matches; normalized() mends that."""
    return RiskPolicy({"PII": "medium", "PHI": "high", "Financial": "high"}, {"PII+PHI": "high", "PII+Financial": "critical", "PHI+Financial": "critical", "PII+PHI+Financial": "critical"}, "low")


@dataclass
class Settings:
    """Tool configuration with its defaults."""

    version: str = "0.1"
    checkpoint_interval: str = "file_end"
    checkpoint_path: str = ""
    private_key_path: str = ""
    public_key_path: str = ""
    state_file: str = ""
    output_format: str = "ndjson"
    log_level: str = "info"
    run_log: str = ""
    reject_file: str = ""

    @classmethod
    def load(cls, path: str | None) -> Settings:
        """Settings from a YAML file of nested keys (or JSON, where no YAML reader is installed); defaults without a path."""
        if not path:
            return cls()
        with open(path) as f:
            text = f.read()
        try:
            import yaml
        except ImportError:
            data = json.loads(text)
        else:
            data = yaml.safe_load(text)
        if not isinstance(data, dict):
            raise ConfigError(f"{path}: not a mapping")
        if not isinstance(data.get("version", "0.1"), str):
            raise ConfigError("version must be a string")
        flat = {k: v for k, v in data.items() if not isinstance(v, dict)}
        for section in data.values():
            flat |= section if isinstance(section, dict) else {}
        return cls(**{k: v for k, v in flat.items() if k in cls.__dataclass_fields__})
