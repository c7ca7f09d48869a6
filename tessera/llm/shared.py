"""Small helpers of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: A word of the result contracts: anything between ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder: the rows, their
    partitions and their order are fixed from here on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Shelf:
    """Tables on the way to a result: Parquet in the session's shared folder, deleted as soon as the
    result no longer needs them, not when the driver happens to collect its garbage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark)}/shelf-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.held.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.held[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Nothing reads these tables any more."""
        for df, path in [x for x in self.held if any(x[0] is t for t in tables)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.held = [x for x in self.held if x[0] is not df]

    def clear(self) -> None:
        self.drop(*(df for df, _ in self.held))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the
    body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    used, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out
