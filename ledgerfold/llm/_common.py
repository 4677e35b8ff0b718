"""Shared helpers: ASCII-space words, Arrow row maps, scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` as UTF-8; ``bytes.split`` splits on exactly those."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z (and nothing else) lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew if it comes from fewer files than there are cores.

    A file of one row group is read by one task however it is split, and work in
    Python would follow. With many partitions nothing is looked at or moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores)


def fold_crc(column: str, modulus: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_rows(
    df: DataFrame,
    schema: str,
    start: Callable[[], Callable[..., Iterable[tuple]]],
) -> DataFrame:
    """Runs ``start()`` once per task and its result on each row's values.

    The function that ``start`` returns takes one argument for each column of
    ``df`` and yields any number of output tuples. Rows go out in small batches,
    so memory is bounded by a batch and the longest row.
    """
    fields = spark_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start()
        for batch in batches:
            out: list[tuple] = []
            columns = batch.columns
            for i in range(batch.num_rows):
                out.extend(row(*[c[i].as_py() for c in columns]))
                if len(out) >= 4096:
                    yield to_batch(out, fields)
                    out = []
            if out:
                yield to_batch(out, fields)

    return df.mapInArrow(run, schema)


def spark_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


class Scratch:
    """Tables written to the shared folder that ``spark.checkpoint.dir`` names.

    A written table cuts lineage and outlives a lost executor. Results are lazy and read
    these tables, so they go when the driver's JVM ends. Where the setting is absent, a
    local master (tests on one machine) has a temporary folder and a cluster an error.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            root = "file://" + os.path.join(tempfile.gettempdir(), "ledgerfold-scratch")
        self.spark, self.base, self.n = spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        if self.n == 1:
            self.files.deleteOnExit(self.spark._jvm.org.apache.hadoop.fs.Path(self.base))
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path  # for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that write() returned and that nothing will read again."""
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path), True)


#: Keys with more than this share of the rows are met by broadcast, of which there can be no more than its inverse.
HOT_KEYS = 1e-3


def join_each(left: DataFrame, right: DataFrame, key: str, uses: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``uses`` how many rows of ``left`` have it.

    Keys of more than HOT_KEYS of all ``total`` rows are few, so that their rows are broadcast and those
    of ``left`` stay where they are; all others are joined by shuffle.
    """
    if total <= 1 / HOT_KEYS:
        return left.join(right.drop(uses), key)
    hot = right.where(F.col(uses) > HOT_KEYS * total).drop(uses)
    rest = right.where(F.col(uses) <= HOT_KEYS * total).drop(uses)
    cool = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cool.join(rest, key))
