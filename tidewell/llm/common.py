"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.store import shared_folder

#: Whether shuffle files go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The tables written since the innermost `clearing` began.
_written: ContextVar[list | None] = ContextVar("written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relieve(spark: SparkSession) -> str | None:
    """Collect the driver's garbage, and give back to the system what its C library has free.

    Compiling the code of many plans takes and frees memory outside the heap, which malloc keeps otherwise. What the JVM says
    of it is returned; None where it can't (no glibc, Java before 17.0.9)."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    kinds, args, of = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4), jvm.java.lang.Class.forName
    try:
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class is closed to callers
        call = of("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return None


def materialize(*parts: DataFrame) -> DataFrame:
    """Write a table, or its parts one behind another, to the shared folder and read it back: lineage ends there, so a lost
    executor costs no recomputation.

    The shuffle files of what was written are then of no use: Spark is told to delete them when the write of a part is done.
    `relieve` keeps the driver, which makes many plans, from growing to its limit.
    """
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/tidewell-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        for df in parts:
            df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    relieve(spark)
    out = spark.read.schema(parts[0].schema).parquet(path)
    out._tidewell_path = path
    if _written.get() is not None:
        _written.get().append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._tidewell_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def clearing() -> Iterator[list]:
    """What is materialized inside is deleted behind it, but for the tables put into the list."""
    kept, before = [], _written.get()
    token = _written.set([])
    try:
        yield kept
        discard(*[df for df in _written.get() if not any(df is k for k in kept)])
    finally:
        _written.reset(token)
    if before is not None:
        before.extend(kept)


def carried(docs: DataFrame, *more: Column | str) -> DataFrame:
    """docs' columns as one struct `row`, and `more`: whatever docs' columns are called, they clash with nothing."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of `row` again, those in `changed` with new values."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def id_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most `limit` training rows (crc32(doc_id) mod 3 is not 1), in order of a hash of the id.

    Rows whose label is null are passed over; of repeated labels for one id the largest counts.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_mod(F.col("doc_id"), 3) != 1))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    # at most `limit` ids of 12 bytes are broadcast
    return texts.join(F.broadcast(rows), "doc_id")
