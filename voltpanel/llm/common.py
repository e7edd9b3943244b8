"""Shared pieces: tables, fresh column names, per-process worker state, slices of Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word separators of every contract here: space and the ASCII control spaces.
SPACES = r"\x20\x09-\x0D"
#: Documents handled at a time inside a task; bounds Python memory whatever the Arrow batch holds.
SLICE = 64
#: Bytes of text handled at a time where a batch of texts is cut into words at once.
TEXT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame, label: str) -> str:
    """A column name that the frame does not use yet (names compare without case)."""
    taken = {c.lower() for c in frame.columns}
    name = f"_{label}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def worker_state(kind: str, key: str, build):
    """An object built once per Python worker process and kept between its tasks.

    Task functions travel by value, so their module globals do not outlive a task; the
    state hangs on a module entry of the process instead. Each kind has one slot: another
    key's object replaces the one before, so workers that are reused do not gather models.
    """
    home = sys.modules.setdefault("voltpanel_worker_state", types.ModuleType("voltpanel_worker_state"))
    held = home.__dict__.get(kind)
    if held is None or held[0] != key:
        home.__dict__.pop(kind, None)
        del held  # before the next one is built
        held = home.__dict__[kind] = (key, build())
    return held[1]


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``size`` rows, without copying."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def sized(batches: Iterator[pa.RecordBatch], name: str, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes of a text column, a row at least, without copying."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
        # A null or empty text counts too, as its row is held.
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column with empty texts for null ones."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
