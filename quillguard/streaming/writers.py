"""Writers that a repeated batch, or a second writer, doesn't make write twice."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of the JVM's Hadoop client."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def created(spark: SparkSession, path: str, content: str) -> bool:
    """Whether this call made the file; False if it was there. One of any number of callers makes it: the file system refuses
    the others. On local disks that is the kernel's exclusive creation."""
    fs, p = filesystem(spark, path)
    if fs.getUri().getScheme() == "file":
        local = urlparse(path).path if path.startswith("file:") else path
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as f:
            f.write(content)
        return True
    from py4j.protocol import Py4JJavaError

    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return True


def claim(spark: SparkSession, folder: str, kind: str, window: str, owner: str) -> bool:
    """Whether the owner may send the digest of a window (hourly, daily, weekly): one of all that ask. A claim stays, so a
    repeated run doesn't send again; a sender that dies after its claim sends nothing, rather than twice."""
    return created(spark, f"{folder.rstrip('/')}/{kind}/{window.replace(':', '-').replace(' ', 'T')}", owner)


#: How a window of each kind is cut.
KINDS = {"hourly": "hour", "daily": "day", "weekly": "week"}


def digests_due(findings: DataFrame, kind: str, now: str) -> DataFrame:
    """window, rows, critical, serious: what the digest of each window that has ended says. Input: ts, severity."""
    cut = KINDS[kind]
    by = findings.groupBy(F.date_trunc(cut, "ts").alias("window")).agg(F.count("*").alias("rows"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity").isin("high", "critical")).alias("serious"))
    return by.where(F.col("window") < F.date_trunc(cut, F.lit(now).cast("timestamp")))


def send_digests(due: DataFrame, folder: str, kind: str, owner: str, send) -> int:
    """Sends each due window that this owner is the first to claim; how many. Windows are few, a row each."""
    sent = 0
    for row in due.orderBy("window").toLocalIterator():
        if claim(due.sparkSession, folder, kind, str(row["window"]), owner):
            send(row)
            sent += 1
    return sent


def archive_sink(target: str):
    """A foreachBatch writer of archive_parts: each batch replaces its own folder, then its entry in the manifest is made; a batch
    that has one is left alone. Readers (archived) see batches with an entry only, so none is seen half written or twice."""

    def write(parts: DataFrame, batch: int) -> None:
        spark = parts.sparkSession
        entry = f"{target.rstrip('/')}/_manifest/{batch:012d}"
        fs, p = filesystem(spark, entry)
        if fs.exists(p):
            return
        # a tenant's hour is a folder; a part is a row of it, whole
        parts.withColumn("day", F.date_format("hour", "yyyy-MM-dd")).write.mode("overwrite").partitionBy("tenant", "day").json(f"{target.rstrip('/')}/batch={batch:012d}")
        created(spark, entry, f"{batch}\n")

    return write


def archived(spark: SparkSession, target: str) -> DataFrame:
    """tenant, shard, hour, part, n_lines, n_bytes, n_dropped, body of all batches that the manifest has."""
    root = target.rstrip("/")
    fs, p = filesystem(spark, f"{root}/_manifest")
    done = [f"{root}/batch={s.getPath().getName()}" for s in fs.listStatus(p)] if fs.exists(p) else []
    schema = "shard int, hour timestamp, part long, body string, n_lines long, n_bytes long, n_dropped long, tenant string, day string"
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", root).schema(schema + ", batch string").json(done).drop("batch")
