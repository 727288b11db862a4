"""Enrichment: tables and columns of an event's SQL, sensitivity labels, risk level.

Which categories a catalogue column belongs to depends on its name and type alone, so it
is worked out once on the catalogue, not once an event. Events then look columns up in
a one-row map, without a shuffle; catalogues beyond MAP_COLUMNS are joined instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sqltext
from ..sources.catalogue import LEVELS, Dictionary, RiskPolicy, java_regex

#: Columns a catalogue may have for the one-row map.
MAP_COLUMNS = 50_000


def classify(schema: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Catalogue columns with the sorted categories whose rules match them; vetoed and unmatched ones have none."""
    spark = schema.sparkSession
    rules = spark.createDataFrame([(r.category, java_regex(r.regex), list(r.expected_types)) for r in dictionary.rules], "category string, regex string, types array<string>")
    hits = F.regexp_like("column_name", "regex") & ((F.size("types") == 0) | F.array_contains("types", F.col("column_type")))
    keys = ["schema_name", "table_name", "column_name", "column_type"]
    matched = schema.join(F.broadcast(rules), hits).groupBy(*keys).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    if dictionary.negatives:
        vetoes = spark.createDataFrame([(java_regex(r),) for r, _ in dictionary.negatives], "veto string")
        matched = matched.join(F.broadcast(vetoes), F.regexp_like("column_name", "veto"), "left_anti")
    return schema.join(matched, keys, "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def first_schema(classified: DataFrame) -> DataFrame:
    """Columns by table name; where several schemas have a table, that of the least name counts."""
    first = classified.groupBy("table_name").agg(F.min("schema_name").alias("schema_name"))
    return classified.join(first, ["table_name", "schema_name"]).select("table_name", F.struct("column_name", "column_type", "categories").alias("column"))


def catalogue_row(classified: DataFrame) -> DataFrame:
    """One row, ``_catalogue``: MAP<table, ARRAY<STRUCT<column_name, column_type, categories>>>."""
    tables = first_schema(classified).groupBy("table_name").agg(F.array_sort(F.collect_list("column")).alias("columns"))
    return tables.agg(F.map_from_entries(F.collect_list(F.struct("table_name", "columns"))).alias("_catalogue"))


def _found(name: Column, x: Column) -> Column:
    return F.struct(name.alias("name"), x["column_name"].alias("column"), x["column_type"].alias("type"), x["categories"].alias("categories"))


def resolve(tables: Column, columns: Column, catalogue: Column) -> Column:
    """ARRAY of distinct resolved columns: alias.column, column, type, categories.

    ``*`` stands for every column of every reference, so a table with an alias counts under both
    names. A plain name belongs to the first alias, in order, whose table has it.
    """
    none = F.array().cast("array<struct<column_name:string,column_type:string,categories:array<string>>>")
    of = lambda table: F.coalesce(F.try_element_at(catalogue, table), none)
    everything = lambda entries: F.flatten(F.transform(entries, lambda e: F.transform(of(e["value"]), lambda x: _found(F.concat(e["key"], F.lit("."), x["column_name"]), x))))

    def one(c: Column, entries: Column) -> Column:
        alias, name = F.substring_index(c, ".", 1), F.substring(c, F.instr(c, ".") + 1, F.length(c))
        qualified = F.transform(F.filter(of(F.try_element_at(tables, alias)), lambda x: x["column_name"] == name), lambda x: _found(c, x))
        owners = F.flatten(F.transform(entries, lambda e: F.transform(F.filter(of(e["value"]), lambda x: x["column_name"] == c), lambda x: _found(F.concat(e["key"], F.lit("."), c), x))))
        return F.when(c == "*", everything(entries)).when(c.contains("."), qualified).otherwise(F.slice(owners, 1, 1))

    return sqltext.let(F.sort_array(F.map_entries(tables)), lambda entries: F.array_distinct(F.flatten(F.transform(columns, lambda c: one(c, entries)))))


def risk_level(categories: Column, policy: RiskPolicy) -> Column:
    """Level of a sorted set of categories: the default for none, the base level for one, a combination or the highest base level for more."""
    rank = {level: i + 1 for i, level in enumerate(LEVELS)}
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    base, ranks = pairs(policy.base), F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    best = F.array_max(F.transform(categories, lambda c: F.coalesce(F.try_element_at(ranks, F.coalesce(F.try_element_at(base, c), F.lit(""))), F.lit(0))))
    names = F.array(*[F.lit(x) for x in LEVELS])
    highest = F.when(best > 0, F.element_at(names, F.greatest(best, F.lit(1))))
    many = F.coalesce(F.try_element_at(pairs(policy.combinations), F.array_join(categories, "+")), highest, F.lit(policy.default))
    single = F.coalesce(F.try_element_at(base, F.get(categories, F.lit(0))), F.lit(policy.default))
    return F.when(F.size(categories) == 0, policy.default).when(F.size(categories) == 1, single).otherwise(many)


def _with_resolved(events: DataFrame, classified: DataFrame, sql: str) -> DataFrame:
    """``events`` with ``_refs`` and ``_resolved``."""
    # a projection each: these are used several times and must not be worked out again
    refs = events.withColumn("_q", sqltext.clean_comments(F.col(sql))).withColumn("_refs", sqltext.clean_refs(F.col("_q"))).drop("_q")
    if classified.count() <= MAP_COLUMNS:
        row = catalogue_row(classified)
        held = refs.crossJoin(F.broadcast(row))  # one row of at most MAP_COLUMNS columns
        return held.withColumn("_resolved", resolve(F.col("_refs.tables"), F.col("_refs.columns"), F.col("_catalogue"))).drop("_catalogue")
    return _resolved_by_join(refs, classified)


def _resolved_by_join(refs: DataFrame, classified: DataFrame) -> DataFrame:
    """The same by shuffling references to the catalogue, for catalogues too large to send to every task."""
    keyed = refs.withColumn("_row", F.monotonically_increasing_id())
    wanted = keyed.select("_row", F.explode(F.map_entries("_refs.tables")).alias("e"), F.col("_refs.columns").alias("cs"))
    asked = wanted.select("_row", F.col("e.key").alias("alias"), F.col("e.value").alias("table_name"), F.posexplode("cs").alias("at", "c"))
    asked = asked.where((F.col("c") == "*") | ~F.col("c").contains(".") | (F.substring_index("c", ".", 1) == F.col("alias")))
    rest = F.substring(F.col("c"), F.instr("c", ".") + 1, F.length("c"))
    name = F.when(F.col("c").contains("."), rest).otherwise(F.col("c"))
    tables = first_schema(classified).select("table_name", "column.*")
    hit = asked.join(tables, "table_name").where((F.col("c") == "*") | (F.col("column_name") == name))
    found = hit.withColumn("f", F.struct(F.when(F.col("c").contains("."), F.col("c")).otherwise(F.concat("alias", F.lit("."), "column_name")).alias("name"), F.col("column_name").alias("column"), F.col("column_type").alias("type"), F.col("categories")))
    starred = found.where((F.col("c") == "*") | F.col("c").contains(".")).select("_row", "f")
    plain = found.where((F.col("c") != "*") & ~F.col("c").contains(".")).groupBy("_row", "at").agg(F.min_by("f", "alias").alias("f")).select("_row", "f")
    gathered = starred.unionByName(plain).groupBy("_row").agg(F.collect_set("f").alias("_resolved"))
    none = F.array().cast(gathered.schema["_resolved"].dataType)
    return keyed.join(gathered, "_row", "left").withColumn("_resolved", F.coalesce("_resolved", none)).drop("_row")


def enrich(events: DataFrame, schema: DataFrame, dictionary: Dictionary, policy: RiskPolicy, emit_unknown: bool = False, debug: bool = False, distinct_labels: bool = False, sql: str = "raw_query") -> DataFrame:
    """``events`` with sensitivity (sorted Category:column labels), categories and risk_level.

    Events without a category are dropped unless ``emit_unknown``. A column that resolves
    under two names is labelled twice, unless ``distinct_labels``.
    """
    policy.check(dictionary.categories)
    resolved = _with_resolved(events, classify(schema, dictionary), sql)
    labels = F.array_sort(F.flatten(F.transform("_resolved", lambda r: F.transform(r["categories"], lambda k: F.concat(k, F.lit(":"), r["column"])))))
    named = resolved.select("*", (F.array_distinct(labels) if distinct_labels else labels).alias("sensitivity"), F.array_sort(F.array_distinct(F.flatten(F.transform("_resolved", lambda r: r["categories"])))).alias("categories"))
    out = named.withColumn("risk_level", risk_level(F.col("categories"), policy))
    if debug:
        pairs = F.flatten(F.transform("_resolved", lambda r: F.transform(r["categories"], lambda k: F.struct(k.alias("k"), r["name"].alias("n")))))
        matches = F.map_from_arrays("categories", F.transform("categories", lambda k: F.array_sort(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["n"]))))
        known = [r["table_name"] for r in schema.select("table_name").distinct().collect()]
        unknown = F.array_sort(F.filter(F.map_values("_refs.tables"), lambda t: ~t.isin(known)))
        status = F.when(F.size("_resolved") > 0, "matched").when(F.size("_refs.columns") > 0, "unresolved").otherwise("no_columns")
        out = out.withColumn(
            "debug_info",
            F.struct(
                F.col("_refs.tables").alias("parsed_tables"), F.col("_refs.columns").alias("parsed_columns"), F.size("_resolved").alias("resolved_columns"), F.size(pairs).alias("matched_columns"),
                matches.alias("category_matches"), status.alias("schema_status"), F.when((status == "unresolved") & (F.size(unknown) > 0), unknown).alias("unresolved_tables"),
            ),
        )
    out = out.drop("_refs", "_resolved")
    # as in parsing: counters on the way, and no copies of the steps above in filters on their results
    out = out.observe(f"enrich-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("input_events"), F.count_if(F.size("categories") > 0).alias("enriched_events"))
    return out if emit_unknown else out.where(F.size("categories") > 0)


def enrich_counters(events: DataFrame, enriched_all: DataFrame, emit_unknown: bool = False) -> DataFrame:
    """One row of run counters; ``enriched_all`` comes from enrich(emit_unknown=True), bad lines are marked by ``_bad``."""
    known = F.size("categories") > 0
    bad = F.col("_bad") if "_bad" in enriched_all.columns else F.lit(False)
    return enriched_all.agg(
        F.count_if(~bad).alias("input_events"), F.count_if(known & ~bad).alias("enriched_events"), F.count_if(~known & ~bad).alias("unknown_events"),
        (F.lit(0) if emit_unknown else F.count_if(~known & ~bad)).cast("long").alias("dropped_events"), F.count_if(bad).alias("error_events"),
    )


def error_events(bad: DataFrame, message: str = "invalid JSON", now: Column | None = None) -> DataFrame:
    """Bad lines as ERROR events that carry the line and the phase."""
    stamp = F.current_timestamp() if now is None else now
    return bad.select(
        F.concat(F.lit("error-"), F.xxhash64("_raw").cast("string")).alias("event_id"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("ERROR").alias("query_type"),
        F.col("_raw").alias("raw_query"), F.struct(F.lit("enrich").alias("phase"), F.lit(message).alias("message")).alias("error"),
    )


def catalogue_counts(schema: DataFrame, dictionary: Dictionary) -> dict[str, int]:
    row = schema.agg(F.count_distinct("schema_name").alias("schemas"), F.count_distinct("schema_name", "table_name").alias("tables"), F.count(F.lit(1)).alias("columns")).first()
    return row.asDict() | {"categories": len(dictionary.categories), "rules": len(dictionary.rules), "negative_rules": len(dictionary.negatives)}
