"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "vigilframe", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # call sites are recorded per column expression; plans here have thousands of them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_TEST_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Only a local session may go without one (a test); it gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder every executor can reach")
    if context.applicationId not in _TEST_FOLDERS:
        _TEST_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="vigilframe-")
    return _TEST_FOLDERS[context.applicationId]


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage where several branches read one result: a lost executor costs a scan of the
    written table and not the whole plan, and the readers still prune columns.
    """
    spark = df.sparkSession
    path = f"{written_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{checkpoint_dir(spark)}/vigilframe/{spark.sparkContext.applicationId}"


def remove_written(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once their results have been used."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(written_folder(spark))
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
