"""Incremental ingest of landed bootstrap generations with Structured Streaming.

The reference has no streaming: its "real-time" data is one fetch at start-up.
The incremental form of that load is a file-source stream over the manifests of
a landing folder. A manifest is written when all documents of its generation
are there, so a micro-batch never holds part of a snapshot, however many
files it has. ``foreachBatch`` builds the player table as of the newest
generation of the batch with the batch operators (it needs table-wide values,
such as the cost width) and publishes it as a version. Progress is kept in a
checkpoint under the shared ``spark.checkpoint.dir``, so a restarted query
resumes where it stopped; a batch that runs again publishes the same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitchside.operators.players import build_players
from pitchside.session import checkpoint_dir
from pitchside.sources import landing, sinks
from pitchside.sources.json_docs import read_bootstrap
from pitchside.sources.stage import Staging


def generation_stream(spark: SparkSession, landing_dir: str, max_per_trigger: int = 1) -> DataFrame:
    """Streaming rows of manifests: one row for each complete generation of the landing folder."""
    return spark.readStream.schema(landing.MANIFEST).option("maxFilesPerTrigger", max_per_trigger).json(f"{landing_dir}/manifests")


def start_player_refresh(spark: SparkSession, landing_dir: str, output_path: str, query_name: str | None = "player_refresh",
                         checkpoint_location: str | None = None, max_per_trigger: int = 1, available_now: bool = False) -> StreamingQuery:
    """Start a query that publishes the player table at ``output_path`` anew for each batch of landed generations.

    A generation older than the one published is skipped, as is one before the first snapshot. ``available_now`` ends the query when all
    that has landed is done.
    """
    checkpoint_location = checkpoint_location or os.path.join(checkpoint_dir(spark), "streams", query_name or "player_refresh")

    def refresh(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("version")).first()[0]
        published = sinks.versions(spark, output_path)
        if newest is None or (published and int(published[-1]["note"]) > newest) or not landing.current(spark, landing_dir, newest):
            return
        staging = Staging()
        try:
            sinks.publish(build_players(*read_bootstrap(spark, landing_dir, newest, staging)), output_path, note=str(newest))
        finally:
            staging.close()

    writer = generation_stream(spark, landing_dir, max_per_trigger).writeStream.option("checkpointLocation", checkpoint_location)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(refresh).start()


def latest_players(spark: SparkSession, output_path: str) -> DataFrame:
    """The player table as published last, with the ``generation`` of the landing folder that it shows."""
    published = sinks.versions(spark, output_path)
    if not published:
        raise FileNotFoundError(f"no player table at {output_path}")
    return sinks.read_published(spark, output_path, published[-1]["number"]).withColumn("generation", F.lit(int(published[-1]["note"])))
