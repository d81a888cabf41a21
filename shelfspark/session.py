"""Session helpers shared by operators: checkpoint folder, intermediate tables and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; where it is unset, one of this machine will do in local mode only."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfspark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Whether Spark deletes the shuffle files of a query when it ends, rather than when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Work:
    """Intermediate tables of one computation in the shared folder, deleted as soon as it is over.

    Nothing that is read after drop() may depend on them: results leave by cut().
    free: shuffle files of queries built within the context go as each query ends; of
    these, none may run twice without being cut.
    """

    def __init__(self, spark: SparkSession, free: bool = False):
        self.spark, self.at, self.n = spark, f"{scratch(spark)}/work-{uuid.uuid4().hex}", 0
        self.marks: list[str] = []
        self.free = free

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of df, written once and read from there on."""
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def mark(self, df: DataFrame) -> DataFrame:
        """The same by a checkpoint, which needs less memory for wide or nested rows; it is deleted with the tables."""
        out = cut(df)
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            self.marks.append(file.get())
        return out

    def drop(self) -> None:
        for path in [self.at, *self.marks]:
            remove(self.spark, path)

    def __enter__(self) -> Work:
        if self.free:
            self.before = self.spark.conf.get(FREE_SHUFFLES, None)
            self.spark.conf.set(FREE_SHUFFLES, "true")
        return self

    def __exit__(self, *_: object) -> None:
        if self.free:
            self.spark.conf.unset(FREE_SHUFFLES) if self.before is None else self.spark.conf.set(FREE_SHUFFLES, self.before)
        self.drop()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that Spark would use for it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Tables up to this size are dealt to all cores after the scan.
SPREAD_BYTES = 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A small table, dealt to all cores: it may be one row group, which is one task however much is computed from it.

    Filters and column choices still reach the scan. Larger tables have splits enough and are left alone.
    """
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if size <= SPREAD_BYTES and cores > 1 else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
