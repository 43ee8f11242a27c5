"""Session settings, table readers and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where neither the cluster nor the caller names a folder, in local mode.
LOCAL_SHARED = "/tmp/palimpsest-shared"
#: Rows that go to a Python worker at a time, where nobody says otherwise: rows hold whole texts.
ARROW_ROWS = 1000
#: Some narrow rows that a driver can hold as a table of hashes, about 100 bytes each.
BROADCAST_ROWS = 100_000


def build_session(app: str = "palimpsest", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster, leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch in this session, unless its settings do."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    os.makedirs(LOCAL_SHARED, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{LOCAL_SHARED}")
    spark.sparkContext.setCheckpointDir(f"file://{LOCAL_SHARED}")
    return f"file://{LOCAL_SHARED}"


def written(df: DataFrame, label: str, onto: DataFrame | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage, survives lost executors.
    onto: a table that this function returned; the rows are added to its folder, and all are read back. codec: Parquet's
    compression, where the session's does not suit.

    The folder goes with ``discard``, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}/{label}" if onto is None else f"{onto._palimpsest_folder}/{label}"
    df.write.mode("errorifexists" if onto is None else "append").parquet(path, compression=codec)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_folder = folder.getParent()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``written`` returned and that nothing reads any more."""
    for df in tables:
        folder = getattr(df, "_palimpsest_folder", None)
        if folder is not None:
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join that is not to be broadcast, whatever its files' size says: the driver would hold what
    grows with the corpus, in rows many times larger than their compressed columns. rows: how many there are, if known;
    up to BROADCAST_ROWS the session's threshold decides.
    """
    return df.hint("merge") if rows is None or rows > BROADCAST_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
