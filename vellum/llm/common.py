"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import ship

#: A word is a run of characters other than the space and tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]++"
CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder is set for the session if driver and executors are one
    process; on a cluster it is an error, since each machine would write to its
    own folder and the driver would read back only a part.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share (master: {master})")
        path = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set(CHECKPOINT_DIR, path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/vellum/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage: what was computed survives the loss of executors,
    and later jobs read it instead of computing it again.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back_memory() -> None:
    """Hand memory that this Python worker no longer uses back to the system: workers wait idle while other stages run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, done: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow, with this package on the executors; after a task, ``done`` drops what it remembered."""
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if done is not None:
                done()
                gc.collect()
            give_back_memory()

    return df.mapInArrow(whole, schema)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: Sequence[str], wanted: str) -> str:
    """A column name that is not taken (names are compared as Spark does, without case)."""
    names = {x.lower() for x in taken}
    name = wanted
    while name.lower() in names:
        name = "_" + name
    return name


def n_words(text: Column) -> Column:
    """Words in text as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups, with the bounds of each, from a task's batches of rows sorted by keys.

    For groups of bounded size: a task holds a batch and one group that goes on
    in the next one.
    """

    def bounds(table: pa.Table) -> list[tuple[int, int]]:
        differ = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            x = table.column(k).to_numpy()
            differ |= x[1:] != x[:-1]
        cuts = (np.flatnonzero(differ) + 1).tolist()
        return list(zip([0, *cuts], [*cuts, table.num_rows]))

    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            *whole, (last, _) = bounds(held)
            if whole:
                yield held.slice(0, last).combine_chunks(), whole
                held = held.slice(last)
    if held is not None:
        yield held.combine_chunks(), bounds(held)
