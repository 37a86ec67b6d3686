"""Incremental runs over a growing folder of files.

The jobs are bounded by nature; what a stream adds is picking up new files as they arrive. Each micro-batch
is a set of whole files, and no result spans two reads or two positions of different files, so a batch is
converted like any table and appended. Offsets and commits live in the stream's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cytoquill.operators import records
from cytoquill.plans import jobs


def _run(source: DataFrame, convert: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        # Writing under the batch's own name makes a replayed batch replace itself.
        convert(df).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_read_stream(spark: SparkSession, folder: str, schema: StructType | str, ref: DataFrame, output: str, checkpoint: str, **options) -> StreamingQuery:
    """Per-read methylation of every new parquet file of reads in `folder`."""
    source = spark.readStream.schema(schema).parquet(folder)
    return _run(source, lambda df: jobs.per_read(df, ref, **options), output, checkpoint)


def bed_stream(spark: SparkSession, folder: str, output: str, checkpoint: str) -> StreamingQuery:
    """CpG rows of every new parquet file of variant lines in `folder`; the first record of a position within a file stands."""
    schema = "contig string, pos bigint, kind int, ref_text string, alt_text string, qual string, filter string, info string, format string, sample string"
    source = spark.readStream.schema(schema).parquet(folder)
    return _run(source, records.lines_to_bed, output, checkpoint)
