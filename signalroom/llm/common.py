"""What the operators share: table reading, materialising in the shared folder, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalroom.sources import tables

#: The words of the contracts: runs of anything but space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


#: What materialize has written, for clean_up.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one serves a local master; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="signalroom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which clean_up deletes."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far and returns how many; for when all results have been read."""
    count = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count


def free(columns: list[str], name: str) -> str:
    """name, with underscores after it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names: they give way to what an operator adds."""
    lost = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in lost])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def size_of(array: Column) -> Column:
    """The number of elements as a long; 0 for null."""
    return F.coalesce(F.when(array.isNotNull(), F.size(array)), F.lit(0)).cast("long")


def int_array(values) -> Column:
    """A constant array<int> that the plan holds as one folded literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
