"""Session helpers shared by operators that cut lineage."""

from __future__ import annotations

import contextlib
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOCAL_FOLDER = "/tmp/checkpoints"
#: Deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "regrove") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config(CHECKPOINT_KEY, f"{LOCAL_FOLDER}/{app}")
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names, else one for local masters only."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return f"{LOCAL_FOLDER}/{spark.sparkContext.applicationId}"
    raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage so later steps never recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold while a table is written, and no longer."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and read them back; ``codec`` overrides the session's.

    Unlike a cache the files outlive lost executors; unlike ``checkpoint`` the plan runs once.
    The folder belongs to the job: whoever owns ``spark.checkpoint.dir`` clears it after the job.
    Shuffle files go once the rows are written; else those of all steps would lie about until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY)
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


#: Folder of each staged table that is still referred to.
_PATHS: dict[int, tuple] = {}


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads; other frames are left alone."""
    for df in frames:
        ref, path = _PATHS.pop(id(df), (None, None))
        if ref is None or ref() is not df:
            continue
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
