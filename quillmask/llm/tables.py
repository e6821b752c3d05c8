"""Tables in the shared folder, Bloom filters of bounded size, and connected components over edges of any number."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.columns import release_memory
from quillmask.session import shared_checkpoint_dir

#: Spark removes the shuffle files of a finished query where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def trim_driver(spark: SparkSession) -> bool:
    """Gives what the driver has freed back to the system: of its Python, its Java heap and, by glibc, of what its JVM allocates
    besides that. Whether the JVM knows the latter."""
    release_memory()
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    known = jvm.java.lang.Class.forName
    types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, (kind, value) in enumerate((("javax.management.ObjectName", jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")), ("java.lang.String", "systemTrimNativeHeap"), ("[Ljava.lang.Object;", array(jvm.java.lang.Object, 0)), ("[Ljava.lang.String;", array(jvm.java.lang.String, 0)))):
        types[k], values[k] = known(kind), value
    try:
        # by the interface's method, as the server's own class is not open
        known("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except (Py4JError, PySparkException):
        return False
    return True


class Scratch:
    """Tables of one computation in the shared checkpoint folder: lineage ends at each, and it can go after its last reader."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_checkpoint_dir(spark).rstrip('/')}/quillmask/{uuid.uuid4().hex}"
        self.paths: dict[DataFrame, str] = {}
        self.made = 0
        self.sent: list[Any] = []

    def written(self, df: DataFrame, name: str, wide: bool = False) -> DataFrame:
        """The rows, written as Parquet and read again. The shuffle files behind them are removed, as nothing reads these again.

        A table that is not ``wide`` holds numbers only and goes into two files a core at most.
        """
        self.made += 1
        if not wide:
            df = df.coalesce(2 * self.spark.sparkContext.defaultParallelism)
        path = f"{self.root}/{name}-{self.made}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def broadcast(self, value: Any) -> Any:
        """A broadcast of bounded size, released by :meth:`release`."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def release(self) -> None:
        """Frees all broadcasts, as what reads them has been written, and the memory of finished plans in the driver."""
        for b in self.sent:
            b.destroy()
        self.sent = []
        trim_driver(self.spark)

    def drop(self, *tables: DataFrame) -> None:
        """Removes written tables that nothing will read again."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self, keep: DataFrame) -> DataFrame:
        """Removes all tables but one, and frees the broadcasts."""
        self.release()
        self.drop(*(t for t in list(self.paths) if t is not keep))
        return keep


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared checkpoint folder and read again: the lineage ends there."""
    return Scratch(df.sparkSession).written(df, name, wide=True)


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """For edges between longs, (node, root): the least node of its component, for every node with an edge to another.

    Large-star and small-star steps in turn. A node's neighbours are never
    gathered: their minimum is a partial aggregate, joined back to the edges.
    """
    now = scratch.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        last, now = now, scratch.written(small.select("e.u", "e.v").filter("u <> v").distinct(), "small")
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("v")).first())
        scratch.drop(last, large)
        if found == state:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            roots = scratch.written(roots, "roots")
            scratch.drop(now)
            return roots
        state = found


#: Bits of a Bloom filter for each id, and the most bits of one (8 MB).
BITS_PER_ID = 16
MOST_BITS = 1 << 26


def may_hold(ids: DataFrame, column: str, scratch: Scratch) -> Callable[[Column], Column]:
    """A test that is true for all ids of a column and for few others, to thin out rows before a join on it.

    A Bloom filter sized by the number of ids, up to MOST_BITS; with more ids
    it only gets true more often.
    """
    n = ids.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (n * BITS_PER_ID - 1).bit_length() if n else 0))

    def places(c: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(bits)) for k in (0, 1)]

    at = ids.select(F.explode(F.array(*places(F.col(column).cast("long")))).alias("p"))
    words = at.groupBy(F.expr("p DIV 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("m")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    held = scratch.broadcast(table)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        found = np.ones(len(a), bool)
        for x in (a.to_numpy(np.int64), b.to_numpy(np.int64)):
            found &= (held.value[x // 64] >> (x % 64).astype(np.uint64) & np.uint64(1)) == 1
        return pd.Series(found)

    return lambda c: test(*places(c))
