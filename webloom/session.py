"""Sessions, tables and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a finished query deletes its shuffle files.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for files that a task writes at once; of more values of a column its rows are sorted first, on disk.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def get_session(app: str = "webloom", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with the settings the engine is tuned for; a cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package's source to the executors, once a context, unless their Python finds it anyway."""
    home = Path(__file__).resolve().parents[1]
    found = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    context = spark.sparkContext
    if home in found or "site-packages" in home.parts or getattr(context, "_webloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="webloom-")) / "webloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((home / "webloom").rglob("*.py")):
            z.write(f, f.relative_to(home))
    context.addPyFile(str(path))  # the driver serves it to the executors
    context._webloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (a local session) a new one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="webloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone, and its folder with it
        pass


def materialize(df: DataFrame, name: str, by: str | None = None, free: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it from there: lineage ends, lost executors cost nothing.

    by: a column of fewer than 32 values, which get folders of their own. If free, what was shuffled for df is deleted
    once it is written, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"
    ours = {_FREE: "true"} if free else {}
    if by:
        ours[_WRITERS] = "32"  # Spark sorts as soon as so many are open
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._webloom_path = path
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Delete a table that materialize returned, or one folder of it; whatever was derived from it must be written."""
    _delete(df.sparkSession, f"{df._webloom_path}/{part}".rstrip("/"))
