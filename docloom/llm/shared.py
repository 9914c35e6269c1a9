"""The shared folder, and tables written there to cut lineage."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir.

    The cluster names that folder.  Where it is unset, a local session (tests, a laptop) gets a temporary
    folder; on a cluster that is an error, as executors don't see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/docloom-{uuid.uuid4().hex}"


@contextmanager
def once(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside run once: their shuffle files go when they end.

    Without this they stay until the driver happens to collect its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _write(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    spark = df.sparkSession
    with once(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of df, from a table written once to the shared folder.

    Nothing downstream recomputes or depends on executors' local files.
    """
    return _write(df, f"{shared_dir(df.sparkSession)}/{name}")


class Workspace:
    """Tables that one run of an operator needs on its way; they are deleted when its result is written.

        with Workspace(spark) as work:
            a = work.written(df, "a")
            ...
            return written(result_of(a), "result")

    A table that no later step reads can be dropped before that.  What leaves the block must not read the
    workspace's tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, shared_dir(spark), {}

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *error) -> None:
        self._delete(self.folder)

    def written(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """As the function of that name; a name can be used again, which stands for the newest table.

        Rows of each value of the column `by` have a folder of their own, which can be dropped alone.
        """
        self.paths[name] = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        return _write(df, self.paths[name], by)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name))

    def drop_part(self, name: str, part: str) -> None:
        """Drops the rows of one value (`column=value`) of a table written by that column."""
        self._delete(f"{self.paths[name]}/{part}")

    def _delete(self, uri: str) -> None:
        # Through Spark's own file systems, so that it works on any store Spark can write to.
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_of(df: DataFrame, name: str) -> str:
    """The name that df spells in its own case."""
    return next(c for c in df.columns if c.lower() == name.lower())


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
