"""What the operators of this subpackage share: stage tables, and row access that tolerates any input columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_TABLES: list[str] = []  # paths of stage tables not yet deleted, in the order in which they were made


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only where the session leaves it unset and runs on one machine (as in tests) a local folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet (zstd, and with the writer's ``options``), in the shared folder and return the table read back.

    Cuts the lineage without keeping anything on one machine: a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    _TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.stage_path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _TABLES:
        _TABLES.remove(path)
    jvm = getattr(spark, "_jvm", None)  # a client without a JVM of its own leaves the files to whoever clears the folder
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now; it does so when their plans are collected as garbage.

    What the plans took of the driver's memory goes back to the machine, its heap's part and the rest.
    """
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
        trim_driver(spark)


def trim_driver(spark: SparkSession) -> str | None:
    """Have the driver's JVM return freed memory outside its heap, and give its answer; None if it can't (Java 17.0.9 and later can)."""
    lang, gateway = spark._jvm.java.lang, spark.sparkContext._gateway
    types = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, given = gateway.new_array(lang.Class, len(types)), gateway.new_array(lang.Object, len(types))
    try:
        for i, name in enumerate(types):
            kinds[i] = lang.Class.forName(name)
        given[0], given[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        beans = lang.management.ManagementFactory.getPlatformMBeanServer()
        return lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, given)
    except Py4JError:  # another Java, or another C library
        return None


@contextmanager
def scratch(spark: SparkSession):
    """Delete the stage tables made inside when it ends, but for those given to what it yields."""
    before, kept = set(_TABLES), set()
    yield lambda table: kept.add(table.stage_path)
    for path in [p for p in _TABLES if p not in before and p not in kept]:
        _delete(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def keep_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; further columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def release_memory() -> None:
    """Give freed memory back to the machine; Python workers live on between stages and would keep it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run):
    """A partition function that gives its memory back when it ends."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release_memory()

    return wrapped
