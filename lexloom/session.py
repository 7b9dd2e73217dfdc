"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexloom", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local or cluster session with the settings the engine expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a temporary one only where the cluster names none."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        # only a single-machine session may fall back to a local folder
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        conf = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the cluster sees them."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table is deleted when the application ends, or earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    files, place = _at(spark, path)
    df.write.parquet(path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    path = df.__dict__.pop("_scratch", None)
    if path:
        files, place = _at(df.sparkSession, path)
        files.delete(place, True)


#: A table of fewer splits than this (about 1 GB at the default split size) may be spread over the cores.
FEW_SPLITS = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of few splits is spread over all cores, since the work on its texts costs far more than moving them.

    Larger tables already have splits enough and are never moved; projections and filters pass below the exchange.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ("documents", "qa_log"):
        return df
    cores = spark.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package as a zip, once per application, as ``--py-files`` would."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexloom-ship-"), "lexloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lexloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)  # the driver serves it to every executor
    _shipped.add(app)
