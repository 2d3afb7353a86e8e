"""Shared folders, tables cut from their lineage, and word rules that several operators use."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
#: For bytes.translate: A-Z to lower case, everything else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Where the tables of keep() lie.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession, label: str) -> str:
    """URI of a new folder that the driver and all executors see: under spark.checkpoint.dir, or, where that is not set
    and the master is this machine alone, as in tests, under the local temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tessera-shared"
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps start from its files, whatever executors are lost."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[kept] = path
    return kept


def discard(spark: SparkSession, *stored: DataFrame | str) -> None:
    """Delete tables of keep(), or folders, that no later step reads, not even to repeat lost work: what came of them is
    stored itself. Shuffle files that nothing refers to any more go as well, once the driver's collector finds them."""
    for x in stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else _FOLDERS.pop(x))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that none of the taken ones equals, in any case."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def lowered(text: Column) -> Column:
    """A-Z to lower case, other letters as they are; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column | str) -> Column:
    """Array of the words of a text, lower-cased; empty for null, empty and blank texts."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(lowered(text), SPACES), lambda w: w != "")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id has no remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def plain_words(text: str | None) -> list[bytes]:
    """The same words as bytes, in Python: bytes.split() cuts at exactly these six characters."""
    return (text or "").encode().translate(LOWER).split()


_CACHE: list = [None, {}]


def worker_cache(key, most: int) -> dict:
    """What a Python worker remembers from task to task for one purpose, such as results by word; another purpose, or
    growth beyond ``most`` entries, empties it, so that a worker holds one bounded cache at a time. What a former purpose
    has left goes back to the system."""
    if _CACHE[0] != key or len(_CACHE[1]) > most:
        used = bool(_CACHE[1]) or _CACHE[0] != key
        _CACHE[:] = [key, {}]
        if used:
            give_back()
    return _CACHE[1]


def give_back() -> None:
    """Return memory that Python, Arrow and the C library have freed, but keep, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has this call
        ctypes.CDLL(None).malloc_trim(0)
