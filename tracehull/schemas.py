"""Schemas of the audit-event model."""

from __future__ import annotations

from pyspark.sql import types as T

#: A parsed event; null fields are left out when written as JSON.
PARSED_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("db_system", T.StringType()),
        T.StructField("db_user", T.StringType()),
        T.StructField("db_name", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("query_type", T.StringType()),
        T.StructField("raw_query", T.StringType()),
        T.StructField("bulk", T.BooleanType()),
        T.StructField("bulk_type", T.StringType()),
        T.StructField("full_table_read", T.BooleanType()),
        T.StructField("audit_class", T.StringType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("command_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("statement_type", T.StringType()),
        T.StructField("object_type", T.StringType()),
        T.StructField("object_name", T.StringType()),
        T.StructField("connection_id", T.LongType()),
        T.StructField("status", T.LongType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: What enrichment adds.
ENRICHED_FIELDS = (
    T.StructField("sensitivity", T.ArrayType(T.StringType())),
    T.StructField("risk_level", T.StringType()),
    T.StructField("error", T.StructType([T.StructField("phase", T.StringType()), T.StructField("message", T.StringType())])),
)

#: What sealing adds.
HASH_FIELDS = (
    T.StructField("hash_prev", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("hash_chain_index", T.LongType()),
)

SCHEMA_CATALOGUE = "schema_name string, table_name string, column_name string, column_type string"
