"""Session helpers: one place for the configuration the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "evalloop",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session configured for these jobs.

    Local runs (no ``SPARK_MASTER`` in the environment, or an explicit
    ``local[...]`` master) get ``local[$BENCH_CPUS]`` and one shuffle partition
    per core.  On a cluster the master, memory, shuffle partitions and the
    checkpoint folder come from the submit configuration; AQE then coalesces
    small partitions and splits skewed ones at run time.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    local = (master or "").startswith("local") or not os.environ.get("SPARK_MASTER")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.icu.caseMappings.enabled", "false")
    )
    if local:
        builder = (builder.master(master or f"local[{cpus}]")
                   .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
                   .config("spark.driver.memory", os.environ.get("EVALLOOP_DRIVER_MEMORY", "16g")))
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def tune_session(spark: SparkSession) -> None:
    """Session settings the jobs rely on for speed (results are unchanged), and the package for the workers.

    JVM case mapping: ``lower`` via ICU is several times slower on long texts.
    Arrow batches are bounded by bytes, as texts may be long.
    A join whose one side fits a task hashes that side (told by adaptive execution from its sizes)
    instead of sorting both, and scans are cut by few bytes: narrow tables hold tens of millions of
    rows in 128 MB, which fill the memory of a task that sorts or counts them.
    """
    spark.conf.set("spark.sql.icu.caseMappings.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(64 << 20))
    narrow_scans(spark)
    ship_package(spark)


#: Bytes of a table file that one task scans at most.
SCAN_BYTES = 16 << 20


def narrow_scans(spark: SparkSession) -> None:
    """Limit what a task scans to ``SCAN_BYTES``, unless the session asks for less."""
    name = "spark.sql.files.maxPartitionBytes"
    read = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if read > SCAN_BYTES:
        spark.conf.set(name, str(SCAN_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there, and without one this raises: a folder of
    our own would be another one on every machine.  Only local runs and tests,
    where all tasks share the machine, get a fresh scratch folder.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="evalloop-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Functions of the package are sent to the workers by name; without it they can
    only be found where the driver's folder is on the workers' path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_evalloop_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="evalloop-code-"), "evalloop.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("evalloop", os.path.relpath(path, home)))
    sc.addPyFile(archive)
    sc._evalloop_shipped = True


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder and read it back.

    Same effect as a reliable ``checkpoint()`` (lineage ends at files every
    executor can read, so a lost executor never recomputes upstream work) but
    computed once: an uncached ``checkpoint()`` evaluates the plan twice.
    """
    spark = df.sparkSession
    path = f"{tables_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def tables_root(spark: SparkSession) -> str:
    """Where this application's stored tables lie: a folder of its own below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def release_tables(spark: SparkSession) -> None:
    """Delete the tables that :func:`cut_lineage` stored in this application; call it when their readers are done.

    Tables of other applications stay.  Works on any file system Spark can write.
    """
    jvm, root = spark.sparkContext._jvm, tables_root(spark)
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# Fan-out for spreading a coarse input: enough for the CPU work of one small
# file, without thousands of near-empty tasks on a large cluster (an explicit
# repartition count is not coalesced by AQE).
SPREAD_MAX = 256


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a too-coarse input over the cores.

    A file stored as one row group scans as one task, which would leave every
    per-row text rule on one core.  Inputs that already scan in more than half as
    many partitions (any large table) are left alone, so no extra shuffle is
    added at scale (a round-robin also sorts every row).
    """
    want = min(df.sparkSession.sparkContext.defaultParallelism, SPREAD_MAX)
    if 2 * df.rdd.getNumPartitions() <= want:
        return df.repartition(want)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists on whatever file system it names (local, HDFS, object store)."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path).limit(1).count()
        return True
    except AnalysisException:
        return False


def committed(spark: SparkSession, path: str) -> bool:
    """True if a Spark write to ``path`` completed (its ``_SUCCESS`` marker exists)."""
    return path_exists(spark, path.rstrip("/") + "/_SUCCESS")
