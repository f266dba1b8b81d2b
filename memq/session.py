"""Session settings and the places where intermediate tables are kept."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list = []


def build(app: str = "memq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; a master is set only for local runs."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: the session's spark.checkpoint.dir.

    Where the setting is absent (single-machine tests) a local folder is made and set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        d = "file://" + tempfile.mkdtemp(prefix="memq-")
        spark.conf.set("spark.checkpoint.dir", d)
        _WRITTEN.append((spark, d))
    return d


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder, deleted like what materialize() writes."""
    path = f"{shared_dir(spark)}/memq-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df below the shared folder and read it back.

    The written table cuts the lineage, survives the loss of executors, is read column by column,
    and gives later joins an exact size. Removed when the Python process ends, or by release().
    """
    spark = df.sparkSession
    path = scratch(spark)
    w = df.write.mode("error").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return written(spark.read.schema(df.schema).parquet(path))


def written(df: DataFrame) -> DataFrame:
    """df, marked as no more than a scan of a written table, with columns renamed or rows filtered."""
    df._memq_written = True
    return df


def once(df: DataFrame) -> DataFrame:
    """df for use in several jobs: as it is if it is marked as a scan of a written table, else written now."""
    return df if getattr(df, "_memq_written", False) else materialize(df)


def release() -> None:
    """Delete what materialize() wrote; results read from it are invalid afterwards."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            pass


atexit.register(release)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per SparkContext.

    The archive goes through Spark's own file distribution, so executors added later get it too.
    """
    sc = spark.sparkContext
    if getattr(sc, "_memq_shipped", False):
        return
    import io
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="memq-")) / "memq.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    sc._memq_shipped = True
