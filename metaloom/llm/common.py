"""What the training-data operators share: scratch tables, table reading and id hashing."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder so that a lost executor costs no recomputation of what led to them.

    Tables dropped explicitly go at once; the rest go when the session's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/metaloom-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop_all)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(df._scratch_path)

    def drop_all(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % F.lit(m), F.lit(0))


def quoted(name: str) -> str:
    """A column's name as one identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows and, but for single rows, bytes, so that Python holds few texts at once."""
    for b in batches:
        todo = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and x.nbytes > size:
                half = x.num_rows // 2
                todo += [x.slice(half), x.slice(0, half)]
            else:
                yield x
