"""Helpers shared by the operators: table access, shared storage, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly work per row: one of fewer splits than there are cores is dealt over them, a larger one isn't moved."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, local mode, in which driver and executors are one process, gets a folder that goes
    with the process; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="docweave-checkpoint-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables; for steps whose successors are written themselves."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def carried(columns: list[str], made: list[str]) -> dict[str, str]:
    """The name of each carried column in a result that also has the made ones: its own, or with ``in_`` before it."""
    out: dict[str, str] = {}
    for c in columns:
        name = c
        while name.lower() in {x.lower() for x in made} or name.lower() in {x.lower() for x in out.values()} or (name != c and name.lower() in {x.lower() for x in columns}):
            name = f"in_{name}"
        out[c] = name
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: at most so many rows go to a Python worker at once (the session's setting is only lowered)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 0) > rows:
        spark.conf.set(key, rows)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that hands the memory it has freed back to the system when it ends."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its memory
                pass

    return tidied


def batches_of(texts: list[str], chars: int) -> Iterator[slice]:
    """Slices of neighbouring texts of together at most so many characters; a longer text by itself."""
    lo = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > chars:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(x)
    if lo < len(texts):
        yield slice(lo, len(texts))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the least node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), so
    that the number of rounds grows with the logarithm of the graph.  State is a
    written table after each round; nothing is collected but one changed count.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    pairs = materialize(pairs, "edges")
    for _ in range(rounds):
        # large star: each node joins its larger neighbours to its least neighbour
        both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("c"))
        large = both.where("m > n").join(least, "n").select(F.col("c").alias("lo"), F.col("m").alias("hi")).where("lo < hi").distinct()
        # small star: each node joins its smaller neighbours and itself to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("c"))
        small = large.join(least, "hi")
        small = small.select(F.col("c").alias("lo"), F.col("lo").alias("hi")).unionByName(small.select(F.col("c").alias("lo"), "hi")).where("lo < hi").distinct()
        new = materialize(small, "edges")
        # a forest of stars: no node is both a centre and a leaf, each leaf has one centre
        open_ends = new.select(F.col("lo").alias("n")).distinct().join(new.select(F.col("hi").alias("n")), "n", "left_semi").limit(1).count()
        release(pairs)
        pairs = new
        if not open_ends and not new.groupBy("hi").count().where("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
