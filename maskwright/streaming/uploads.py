"""Redaction of files as they arrive.

Each file is whole when it lands, so one micro-batch can make both passes over
it; nothing is kept between batches but the names of what was done, which the
stream's checkpoint holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.plans.redact import joined_up, redact

TEXT = "doc_id string, text string"


def arriving(spark: SparkSession, folder: str, schema: str = TEXT, per_batch: int = 100) -> DataFrame:
    """Documents of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def redacting(docs: DataFrame, out: str, checkpoint: str, policy_name: str = "fake", passes: int = 2) -> StreamingQuery:
    """A query that writes redacted texts to ``out/texts`` and mappings, apart from them, to ``out/mappings``.

    A batch that is tried again overwrites its own folder: each document comes
    out once.
    """

    def write(batch: DataFrame, number: int) -> None:
        # Identities are drawn once for both outputs.
        kept = batch.persist()
        try:
            blocks, mapping = redact(kept, policy_name, passes=passes)
            joined_up(blocks).withColumnRenamed("scope", "doc_id").write.mode("overwrite").parquet(f"{out}/texts/batch={number}")
            mapping.write.mode("overwrite").parquet(f"{out}/mappings/batch={number}")
        finally:
            kept.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired(jobs: DataFrame, hours: int = 1) -> DataFrame:
    """Rows of ``jobs(job_id, created, ...)`` older than their time to live."""
    return jobs.filter(F.col("created") < F.current_timestamp() - F.make_interval(hours=F.lit(hours)))
