"""Tables from and to files, and Spark's other connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Formats whose reader needs nothing but a path.
FILE_FORMATS = frozenset(("parquet", "orc", "csv", "json", "text"))


def read_files(spark: SparkSession, path: str | list[str], format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Rows of files; CSV and JSON need a schema, which spares a pass over the data."""
    if format not in FILE_FORMATS:
        raise ValueError(f"no file format {format!r}; one of {sorted(FILE_FORMATS)}")
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_files(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table over JDBC; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """A topic as a stream; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
