"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read again: a
    cut in the lineage that outlives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes the folders of written tables that nothing reads any more, since what was
    made from them is written, too. Other tables are left alone."""
    for table in tables:
        if path := _FOLDERS.pop(table, None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """The needed columns of a table alone, so that further columns, whatever
    their names, never meet those an operator adds; the text as string."""
    return docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns))


def boxed(docs: DataFrame) -> DataFrame:
    """The text, and all other columns in the struct ``doc``, out of the way of
    those an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc"), F.col("text").cast("string").alias("text"))


def unboxed(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, with the text as it is now; n_chars follows it."""
    n = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None

    def column(c: str):
        if c == "n_chars":
            return n.cast(docs.schema[c].dataType).alias(c)
        return F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c)

    return df.select(*map(column, docs.columns))


def row_key(text: str = "text"):
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def by_batch(make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: pa.Schema, rows: int = 1024) -> Callable:
    """A function for mapInArrow: ``make`` runs once a task and gives the
    function that turns a batch, in slices of ``rows``, into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        # the worker lives on and would keep what it freed
        pa.default_memory_pool().release_unused()

    return run


def runs(covered) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of the true values of a boolean array."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
