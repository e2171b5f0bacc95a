"""Tables that cut lineage, in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and the session is local (as in tests), a new temporary one that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="galley-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _new(spark: SparkSession) -> str:
    """A path for a new table, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/galley/{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def keep(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: later reads survive the loss of executors, and its plan is not run again."""
    path = _new(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_sorted(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df as a table of so many buckets by a hash of the keys, each sorted by them: joins of two such tables need no shuffle."""
    spark, name = df.sparkSession, f"galley_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", _new(spark)).saveAsTable(name)
    return spark.table(name)


#: Bytes of files that make one slice: a slice's texts blow up into some million words, which one task sorts.
SLICE = 4 << 20


def slices(df: DataFrame) -> int:
    """How many slices the files below df make, at least spark.sql.shuffle.partitions: a number for repartition() that grows with the input."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # a table in memory has no size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // SLICE))


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables that keep() and keep_sorted() returned and nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column in taken has it (in any case of letters)."""
    seen, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name = f"_{name}"
        seen.add(name.lower())
        out.append(name)
    return out
