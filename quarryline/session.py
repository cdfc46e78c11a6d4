"""Session settings that the library's queries rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quarryline", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; an existing one is returned as it is."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share; a local one only where spark.checkpoint.dir is unset."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new table in the shared folder and read again: Spark then knows its size."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again; a client without a JVM of its own leaves them to whoever clears the folder."""
    for t in tables:
        jvm = getattr(t.sparkSession, "_jvm", None)
        if jvm is not None:
            at = jvm.org.apache.hadoop.fs.Path(t.stored_at)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
