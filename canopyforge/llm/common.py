"""What the corpus operators share: shared storage, word splitting, small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words after A-Z has been lower-cased, as the contracts state them.
ASCII_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between the same words in a text whose A-Z is still there.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none, as in tests, gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="canopyforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"


#: Rows that fill a part of a table: long ones as documents with their texts, short ones as pairs of numbers.
DOCUMENTS_A_PART, PAIRS_A_PART = 2000, 50_000
#: Parts that any table may have.
LEAST_PARTS = 4


def in_parts(df: DataFrame, rows: int, a_part: int) -> DataFrame:
    """df in no more partitions than so many rows fill, so that few rows aren't written as many files. On a local file system
    each file that a task writes starts chmod three times, and for a moment such a process shares all memory of its executor."""
    return df.coalesce(max(LEAST_PARTS, -(-rows // a_part)))


def cut(df: DataFrame, name: str, rows: int | None = None, a_part: int = PAIRS_A_PART) -> DataFrame:
    """Writes df to the shared folder and reads it again: later work no longer depends on executors that made it.
    rows: about how many there are at most, if that is known; see in_parts."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df if rows is None else in_parts(df, rows, a_part)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def a_to_z_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def column_lists(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 2000) -> Iterator[list[list]]:
    """The named columns as Python lists, at most so many rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]


_lasting: dict[tuple, object] = {}


def lasting(key: tuple, make: Callable):
    """A Python worker's one object that lasts from task to task, such as a cache; another key's replaces it."""
    if key not in _lasting:
        _lasting.clear()
        _lasting[key] = make()
    return _lasting[key]


def forget() -> None:
    """Frees what the worker kept for other operators; workers serve one after another."""
    _lasting.clear()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can; a worker that waits would keep it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


Query = Callable[[SparkSession, str], DataFrame]


def annotate(df: DataFrame, inputs: list[str], fields: dict[str, str], make: Callable, rows: int = 500) -> DataFrame:
    """df with the columns of fields (name: type) made by make(*lists of the inputs), which returns one Arrow array a field.

    All other columns pass through as they are; one of df's that has the name of a new one is replaced.
    """
    kept = [c for c in df.columns if c not in fields]
    at = [df.columns.index(n) for n in inputs]
    passed = [df.columns.index(n) for n in kept]
    names = [*kept, *fields]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{n}` {t}" for n, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = make(*[part.column(i).to_pylist() for i in at])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in passed), *made], names)

    return df.mapInArrow(run, schema)
