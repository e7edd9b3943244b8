"""Token ids in Arrow files: equal-length sequences as fixed-size lists, with their masks.

A file is an Arrow IPC file whose record batches hold three fixed-size-list columns of
``SEQUENCE`` ids: ``ids``, and one bit per id in ``mask`` (1: a token, 0: padding at the
end of the file) and ``ends`` (1: the last token of a document). A memory map of the file
gives any sequence by number without copying: the batch is ``number // BATCH`` and the
place in it ``number % BATCH``. Beside it ``.docs.arrow`` lists the documents in order.

Documents are written in ascending id order: parts are ranges of doc_id, each written by
one task under a temporary name and then renamed, so a repeated or lost task leaves no
half file. What is shuffled is packed ids, not texts.

Defined results: a null text counts as empty and still has its end id; null ids come first;
rows with equal ids follow each other, ordered by their ids; an empty table writes no file
and gives no rows; other columns are ignored. Long documents span sequences and batches.
"""

from __future__ import annotations

import bisect
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltpanel.llm.common import column, sized, slices, texts_of, worker_state
from voltpanel.llm.tokenizing import TextEncoder
from voltpanel.session import materialised, scratch_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
SEQUENCE, BATCH = 2048, 64
#: Bytes of text per file, about.
PART_BYTES = 16 << 20
MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint"


def file_schema(length: int = SEQUENCE) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.uint16(), length)),
            ("mask", pa.list_(pa.uint8(), length // 8)),
            ("ends", pa.list_(pa.uint8(), length // 8)),
        ]
    )


def _open_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class SequenceWriter:
    """Appends documents to one Arrow file, full batches as they fill up."""

    def __init__(self, folder: str, part: int):
        self.fs, self.folder = _open_fs(folder)
        self.final = f"{self.folder}/part-{part:06d}"
        self.own = f"{self.folder}/.{uuid.uuid4().hex}"
        self.part, self.docs, self.lengths, self.buffer, self.held, self.tokens = part, [], [], [], 0, 0
        self.fs.create_dir(self.folder, recursive=True)
        self.sink = self.fs.open_output_stream(self.own)
        self.writer = pa.ipc.new_file(self.sink, file_schema())

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 2)
        self.buffer.append(ids)
        self.held += len(ids) // 2
        self.tokens += len(ids) // 2
        if self.held >= SEQUENCE * BATCH * 8:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.buffer), "<u2")
        ends = np.zeros(len(ids), np.uint8)
        at = len(ids)
        for n in reversed(self.lengths[len(self.lengths) - self._pending() :]):
            ends[at - 1] = 1
            at -= n
        if self._carried is not None:
            ends[: len(self._carried)] = self._carried
        full = len(ids) if last else len(ids) // (SEQUENCE * BATCH) * SEQUENCE * BATCH
        for start in range(0, full, SEQUENCE * BATCH):
            self._write(ids[start : min(start + SEQUENCE * BATCH, full)], ends[start : min(start + SEQUENCE * BATCH, full)])
        rest = ids[full:]
        self._carried, self.buffer, self.held = ends[full:].copy(), [rest.tobytes()], len(rest)
        self._flushed = len(self.lengths)

    _carried: np.ndarray | None = None
    _flushed: int = 0

    def _pending(self) -> int:
        return len(self.lengths) - self._flushed

    def _write(self, ids: np.ndarray, ends: np.ndarray) -> None:
        pad = -len(ids) % SEQUENCE
        mask = np.packbits(np.concatenate([np.ones(len(ids), np.uint8), np.zeros(pad, np.uint8)]))
        ends = np.packbits(np.concatenate([ends, np.zeros(pad, np.uint8)]))
        ids = np.concatenate([ids, np.zeros(pad, np.uint16)]) if pad else ids
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(x), n)
            for x, n in ((ids, SEQUENCE), (mask, SEQUENCE // 8), (ends, SEQUENCE // 8))
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=file_schema()))

    def close(self) -> tuple[int, str, int, int]:
        self._flush(True)
        self.writer.close()
        self.sink.close()
        listing = pa.table({"doc_id": pa.array(self.docs, pa.int64()), "n_tokens": pa.array(self.lengths, pa.int64())})
        with self.fs.open_output_stream(f"{self.own}.docs") as sink, pa.ipc.new_file(sink, listing.schema) as writer:
            writer.write_table(listing)
        self.fs.move(f"{self.own}.docs", f"{self.final}.docs.arrow")
        self.fs.move(self.own, f"{self.final}.arrow")
        return self.part, self.final, len(self.docs), self.tokens


def encode_documents(docs: DataFrame, cuts: list[int], name: str, path: str | None, end_id: int) -> DataFrame:
    """part, doc_id, ids (little-endian 16-bit): ``cuts`` are the first ids of parts 1, 2, ..."""

    def encode(batches: Iterator[pa.RecordBatch]):
        encoder = worker_state("ids16", f"{name}-{path}", lambda: TextEncoder(name, path, dtype="<u2"))
        end = np.array([end_id], "<u2").tobytes()
        for batch in sized(batches, "text"):
            ids = [x + end for x in encoder.encode(texts_of(batch))]
            keys = column(batch, "doc_id")
            parts = [0 if k is None else bisect.bisect_right(cuts, k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "ids"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "part int, doc_id bigint, ids binary")


def part_cuts(docs: DataFrame, part_bytes: int = PART_BYTES) -> list[int]:
    """First ids of the parts: quantiles of doc_id, so many that a part has about ``part_bytes``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(size / part_bytes)
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), at, max(10_000, 20 * n))).first()[0] or []
    return sorted({int(c) for c in cuts})


def write_sequences(docs: DataFrame, folder: str, name: str = TOKENIZER, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files under ``folder``; the manifest, one row per file, is stored beside them."""
    cuts = part_cuts(docs)
    encoded = encode_documents(docs, cuts, name, path, end_id)
    ordered = encoded.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "doc_id", "ids")

    def write(batches: Iterator[pa.RecordBatch]):
        writer, done = None, []
        for batch in slices(batches, 256):
            for part, doc_id, ids in zip(*(column(batch, c) for c in ("part", "doc_id", "ids"))):
                if writer is None or writer.part != part:
                    if writer:
                        done.append(writer.close())
                    writer = SequenceWriter(folder, part)
                writer.add(doc_id, ids)
        if writer:
            done.append(writer.close())
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        names = ["part", "path", "n_docs", "n_tokens"]
        columns = zip(*done) if done else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return materialised(ordered.mapInArrow(write, MANIFEST), "token-files")


class SequenceReader:
    """Random access to the sequences of one file, without copying where it can be mapped."""

    def __init__(self, folder: str, path: str):
        self.fs, _ = _open_fs(folder)
        local = isinstance(self.fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(f"{path}.arrow") if local else self.fs.open_input_file(f"{path}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.docs_path = f"{path}.docs.arrow"

    def batch(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, mask and ends of a batch: one row per sequence; masks unpacked to 0 and 1."""
        batch = self.file.get_batch(number)
        ids, mask, ends = (batch.column(i).flatten().to_numpy(zero_copy_only=True) for i in range(3))
        bits = lambda x: np.unpackbits(x).reshape(-1, SEQUENCE)
        return ids.reshape(-1, SEQUENCE), bits(mask), bits(ends)

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and mask of one sequence; the ids are a view of the file."""
        batch = self.file.get_batch(number // BATCH)
        at = number % BATCH
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[at * SEQUENCE : (at + 1) * SEQUENCE]
        mask = batch.column(1).flatten().to_numpy(zero_copy_only=True)[at * SEQUENCE // 8 : (at + 1) * SEQUENCE // 8]
        return ids, np.unpackbits(mask)

    def documents(self) -> Iterator[np.ndarray]:
        """Every document's ids in file order, from the ids, masks and ends alone."""
        held: list[np.ndarray] = []
        for number in range(self.file.num_record_batches):
            ids, mask, ends = (x.reshape(-1) for x in self.batch(number))
            ids, ends = ids[mask == 1], ends[mask == 1]
            start = 0
            for stop in np.flatnonzero(ends) + 1:
                yield np.concatenate([*held, ids[start:stop]]) if held else ids[start:stop]
                held, start = [], stop
            if start < len(ids):
                held.append(ids[start:].copy())

    def listing(self) -> pa.Table:
        with self.fs.open_input_file(self.docs_path) as source:
            return pa.ipc.open_file(source).read_all()


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    One row per file is dealt to the tasks; ``start`` adds the tokens of the files before.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, start in zip(column(batch, "path"), column(batch, "first")):
                reader = SequenceReader(folder, path)
                listing = reader.listing()
                keys, lengths = listing.column("doc_id").to_pylist(), listing.column("n_tokens").to_pylist()
                rows = []
                for ids in reader.documents():
                    rows.append((start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if [r[1] for r in rows] != lengths:
                    raise ValueError(f"{path}: the documents listed are not those in the file")
                columns = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), *(pa.array(list(c), pa.int64()) for c in columns)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.repartition(parts, "part").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, folder: str | None = None, name: str = TOKENIZER, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents and read them back: the digest of what the files hold."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read_documents(write_sequences(docs, folder, name, path, end_id), folder)
