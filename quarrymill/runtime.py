"""Session, table and shared-folder helpers used by every operator."""

from __future__ import annotations

import atexit
import logging
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
_LOCAL: list[str] = []
_SCRATCH: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quarrymill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; a folder of part files or a single file."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the session is local (tests, a laptop) is a temporary folder made, and removed
    at exit; on a cluster, where every executor would write to a disk of its own, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master or ""
        if not re.match(r"local($|\[)", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="quarrymill-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        where = f"file://{_LOCAL[0]}"
    elif re.match(r"(file:)?/", where) and not re.match(r"local", spark.sparkContext.master or "local"):
        log.warning("spark.checkpoint.dir %s must be mounted on all executors", where)
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; its file system removes it when the session's JVM ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/quarrymill/{app}"
    if app not in _SCRATCH:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _SCRATCH.add(app)
    return path


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files survive the loss of any executor, the read has exact statistics (so joins are planned on
    real sizes), and what a Python stage made is never made twice.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` once all that was read from them is itself stored."""
    for t in tables:
        spark, path = t.sparkSession, t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the granularity operators aim for when they cut work into tasks."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
