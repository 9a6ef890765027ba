"""Results that several actions read: written once below spark.checkpoint.dir, which all executors share; and rows dealt over all cores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """The rows of `df`, worked out once: a Parquet table below spark.checkpoint.dir, which outlives lost executors and is read by column.

    Without such a folder the rows are cached, and lost parts are worked out again. The folder belongs to the job, which clears it.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        return df.persist()
    path, schema = f"{shared.rstrip('/')}/staged-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(rows: DataFrame, key: str, pieces: int = 1) -> DataFrame:
    """Rows with different keys, dealt over all cores: Spark splits files and shuffled data by their bytes, and the work on a page is out of proportion to those of its row.

    With more `pieces` for each core, few keys come out more evenly.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces * spark.sparkContext.defaultParallelism), key)
