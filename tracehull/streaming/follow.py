"""The batch operators on streams: following log files, enriching on arrival, sealing micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chain, enrich as enriching, parse as parsing
from ..schemas import PARSED_EVENT
from ..sources import catalogue, lines as sources


def follow_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Lines of files that arrive in ``folder``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select(F.col("value").alias("line"))


def parse_stream(lines: DataFrame, database: str, emit_raw: bool = False) -> DataFrame:
    """Lines with outcome and event fields; ids come from the line, so a replayed batch repeats them."""
    return parsing.parse(lines, database, emit_raw, "hash")


def enrich_stream(lines: DataFrame, database: str, schema: DataFrame, dictionary: catalogue.Dictionary, policy: catalogue.RiskPolicy, emit_unknown: bool = False) -> DataFrame:
    events = parsing.events(parse_stream(lines, database, True))
    return enriching.enrich(events, schema, dictionary, policy, emit_unknown)


def write_parsed(lines: DataFrame, database: str, output: str, rejects: str, checkpoint: str, emit_raw: bool = False) -> StreamingQuery:
    """Events to one folder and rejects to another, each batch written once under its number."""
    names = PARSED_EVENT.fieldNames()

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        sources.write_ndjson(parsing.events(batch), f"{output}/batch={number}", *names)
        sources.write_ndjson(parsing.rejects(batch), f"{rejects}/batch={number}", *names)
        batch.unpersist()

    return parse_stream(lines, database, emit_raw).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seal_stream(lines: DataFrame, output: str, state_folder: str, checkpoint: str) -> StreamingQuery:
    """Seal arriving event lines; the chain's head goes from batch to batch through a state file a batch, so a replayed batch starts where it did."""

    def write(batch: DataFrame, number: int) -> None:
        before = chain.ChainState.load(f"{state_folder}/state-{number - 1}.json") if number else chain.ChainState()
        sealed = chain.seal(batch.withColumn("_n", F.monotonically_increasing_id()), "line", ["_n"], before).persist()
        sealed.orderBy("_n").select(F.col("sealed").alias("value")).write.mode("overwrite").text(f"{output}/batch={number}")
        chain.state_of(sealed, before).save(f"{state_folder}/state-{number}.json")
        sealed.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by query type and window of their own time, on a stream or a table."""
    timed = events.withColumn("event_ts", F.try_to_timestamp("timestamp"))
    timed = timed.withWatermark("event_ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("event_ts", width).alias("w"), "query_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "query_type", "n")
