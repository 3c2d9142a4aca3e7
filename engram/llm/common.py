"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract of these operators defines it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


_KEPT: dict[str, object] = {}


def kept(key: str, make):
    """What a Python worker keeps between tasks: one thing at a time, so operators that follow each other in a session
    don't pile up their tables in workers that live on."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drops what a worker keeps: at the start of a pass that keeps nothing itself, so that the tables of the operator before
    don't stay beside its own data. What is free then goes back to the system, where the C library can do so: without, half
    of it stays with an idle worker."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests)
    uses a folder of its warehouse; on a cluster that is an error, since a folder there may be the driver's own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not where:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(docs: DataFrame, modulus: int, held: int, doc_id: str = "doc_id") -> Column:
    """True for the held-out fold: crc32 of doc_id as text, mod modulus, is held; a null id is never held out."""
    return F.coalesce(F.crc32(docs[doc_id].cast("string").cast("binary")) % modulus == held, F.lit(False))


def ids_and_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs; whatever else docs holds can't clash with its results."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def bytes_of(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def strings_of(column: pa.Array) -> list[str]:
    """Texts as str, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").to_pylist()


def pieces(batches, rows: int = 512, size: int = 4 << 20):
    """Cut Arrow batches into slices of bounded rows and bytes, so a batch of very long texts stays small."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, int(n * size / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)
