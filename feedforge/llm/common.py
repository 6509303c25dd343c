"""Shared plumbing of the training-data operators: inputs, staging tables, label samples."""

from __future__ import annotations

import binascii
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of a word, `[\x20\x09-\x0D]`; everything else belongs to a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one where the setting is absent and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="feedforge-shared-"))
        found = _own_dir[0]
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation of what came before. Turns on
    the session setting that deletes shuffle files once a query ends. `discard` deletes the table.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(_CLEANUP, None) != "true":
        spark.conf.set(_CLEANUP, "true")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        at = getattr(df, "_staged_at", None)
        if at is not None:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def crc_bucket_py(doc_id, modulus: int) -> int:
    return binascii.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def labelled_sample(docs: DataFrame, marks: DataFrame, target: str, modulus: int, held: int, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out remainder.

    The sample is the first `rows` ids by md5, so it is the same on every run; its size is the
    bound that lets the id list be broadcast. Null ids, null labels and labels other than 0 and 1
    are left out; a repeated label row counts once, and of contradicting ones the smallest counts.
    """
    chosen = (
        marks.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
        .where(crc_bucket(F.col("doc_id"), modulus) != held)
        .groupBy("doc_id")
        .agg(F.min(target).cast("int").alias("_label"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_label")


def whole_within(sample: DataFrame, size: Column, most: int) -> DataFrame:
    """The sample's documents whose sizes add up to `most` at most, taken whole in md5 order of their ids; one that doesn't fit is left out.

    The sizes of the sample's rows, whose number is bounded, go to the driver.
    """
    got = sample.groupBy("doc_id").agg(F.sum(size).alias("size")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").collect()
    taken, full = [], 0
    for r in got:
        if full + r["size"] <= most:
            taken.append((r.doc_id,))
            full += r["size"]
    chosen = sample.sparkSession.createDataFrame(taken, "doc_id long")
    return sample.join(F.broadcast(chosen), "doc_id", "left_semi")


def widened(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with further fields, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
