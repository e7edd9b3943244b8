"""Whole documents packed into sequences of at most ``capacity`` tokens by bin completion.

Only lengths decide a packing, and there are at most ``capacity`` different ones, so the
search runs on the histogram of lengths, which stays that small for any number of
documents. It builds patterns ("this many sequences hold these lengths"), each with a
multiplicity. The pieces are then dealt to the patterns' places by Spark: a piece's rank
among those of its length says which place it takes.

The search is bin completion: around the largest open length it enumerates the undominated
fillings of the rest, least waste first, and backtracks under a bound on the waste that
the incumbent still allows. Best-fit solutions are the incumbents.

Defined results: a null text counts as empty and still carries its end token; rows with a
null or repeated id are packed like any other; an empty table gives no rows; other columns
are ignored. A document longer than a sequence is cut into full pieces and a rest.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltpanel.llm.common import column, slices, worker_state
from voltpanel.llm.tokenizing import TextEncoder
from voltpanel.session import materialised

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096
#: Search effort: steps of the branch and bound, fillings kept per step, tries per filling search.
STEPS, FILLINGS, TRIES = 3_000, 4, 400
#: Pieces that one task ranks at a time.
RANK_GROUP = 5_000

Pattern = tuple[tuple[int, int], ...]


# --- the search on the histogram ---------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing by classes: every length goes to the open sequences with the least
    room that still fits it, as many at once as fit."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}  # room -> patterns and how many have it
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in open_:
                bisect.insort(rooms, room)
            open_.setdefault(room, []).append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, pattern, n = capacity, (), math.inf
            else:
                room = rooms[at]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = min(room // length, left)
            used = int(min(n, left // each))
            put(room - each * length, (*pattern, (length, each)), used)
            if n != math.inf:
                put(room, pattern, n - used)
            left -= used * each
    return [p for room in open_.values() for p in room]


def fillings(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, Pattern]]:
    """Undominated fillings of ``room``, least waste first; ``lengths`` are the open ones, ascending."""
    found: dict[Pattern, int] = {}
    tries = [TRIES]

    def dominated(chosen: list[tuple[int, int]], waste: int) -> bool:
        """Some item could give way to a longer one in the waste: that filling is better."""
        if not waste:
            return False
        taken = dict(chosen)
        for length in taken:
            at = bisect.bisect_right(lengths, length + waste) - 1
            while at >= 0 and lengths[at] > length:
                if counts[lengths[at]] > taken.get(lengths[at], 0):
                    return True
                at -= 1
        return False

    def go(at: int, left: int, chosen: list[tuple[int, int]]) -> None:
        at = min(at, bisect.bisect_right(lengths, left) - 1)
        if at < 0 or tries[0] <= 0:
            if not dominated(chosen, left):
                found.setdefault(tuple(chosen), left)
            return
        tries[0] -= 1
        length = lengths[at]
        most = min(counts[length], left // length)
        for k in range(most, max(-1, most - 3), -1):
            go(at - 1, left - k * length, [*chosen, (length, k)] if k else chosen)
            if sum(1 for w in found.values() if not w) >= FILLINGS or tries[0] <= 0:
                return

    go(len(lengths) - 1, room, [])
    return sorted((w, p) for p, w in found.items())[:FILLINGS] or [(room, ())]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: items over half a sequence stand alone, and what is longer than the
    room they leave needs sequences of its own (the L2 bound over all thresholds)."""
    lengths = np.array(sorted(counts), np.int64)
    number = np.array([counts[n] for n in lengths.tolist()], np.int64)
    total = int((lengths * number).sum())
    best = -(-total // capacity)
    for k in lengths[lengths * 2 <= capacity].tolist() + [0]:
        alone, over = lengths > capacity - k, (lengths * 2 > capacity) & (lengths <= capacity - k)
        small = (lengths >= k) & (lengths * 2 <= capacity)
        room = int((number[over] * (capacity - lengths[over])).sum())
        rest = int((number[small] * lengths[small]).sum()) - room
        best = max(best, int(number[alone].sum() + number[over].sum()) + max(0, -(-rest // capacity)))
    return best


def complete(counts: dict[int, int], capacity: int, incumbent: int, steps: int = STEPS) -> list[tuple[Pattern, int]] | None:
    """Branch and bound over completions; a packing of fewer than ``incumbent`` sequences or None."""
    total = sum(n * c for n, c in counts.items())
    bound = least_sequences(counts, capacity)
    best, best_size = None, incumbent
    path: list[tuple[Pattern, int]] = []
    # One frame per step: the untried choices, and what the chosen one took.
    frames: list[list] = []
    counts, lengths = dict(counts), sorted(counts)
    size, wasted = 0, 0

    def change(pattern: Pattern, times: int, sign: int) -> None:
        for length, k in pattern:
            before = counts[length]
            counts[length] = before - sign * k * times
            if not counts[length]:
                del lengths[bisect.bisect_left(lengths, length)]
            elif not before:
                bisect.insort(lengths, length)

    def expand() -> None:
        largest = lengths[-1]
        counts[largest] -= 1
        around = fillings(counts, lengths if counts[largest] else lengths[:-1], capacity - largest)
        counts[largest] += 1
        choices = []
        for waste, filling in around:
            taken = dict(filling)
            taken[largest] = taken.get(largest, 0) + 1
            choices.append((waste, tuple(sorted(taken.items(), reverse=True))))
        frames.append([choices[::-1], None])

    expand()
    while frames and steps > 0:
        steps -= 1
        choices, taken = frames[-1]
        if taken:
            pattern, times, waste = taken
            change(pattern, times, -1)
            path.pop()
            size, wasted, frames[-1][1] = size - times, wasted - waste * times, None
        if not choices:
            frames.pop()
            continue
        waste, pattern = choices.pop()
        times = min(counts[length] // k for length, k in pattern)
        # The waste bound: an improvement may waste this much in all.
        allowed = (best_size - 1) * capacity - total - wasted
        if waste * times > allowed:
            times = allowed // waste if waste and allowed > 0 else 0
        if allowed < 0 or times < 1:
            continue
        change(pattern, times, 1)
        path.append((pattern, times))
        size, wasted, frames[-1][1] = size + times, wasted + waste * times, (pattern, times, waste)
        if not lengths:
            if size < best_size:
                best, best_size = list(path), size
            if best_size == bound:
                break
        else:
            expand()
    return best


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """Patterns and multiplicities that pack every length; as few sequences as the search finds."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    packing = best_fit(counts, capacity)
    size = sum(times for _, times in packing)
    if size > least_sequences(counts, capacity):
        packing = complete(counts, capacity, size, steps) or packing
    return packing


# --- the DataFrame operator --------------------------------------------------------------


def cut_pieces(docs: DataFrame, name: str = TOKENIZER, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids in pieces of at most ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]):
        encoder = worker_state("ids", f"{name}-{path}", lambda: TextEncoder(name, path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            texts = [t or "" for t in column(batch, "text")]
            for doc_id, ids in zip(column(batch, "doc_id"), encoder.encode(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def places(packing: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length the runs of ranks that one pattern takes: first rank, copies per sequence,
    first sequence id, offset of the first copy."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in packing:
        offset = 0
        for length, k in pattern:
            runs.setdefault(length, []).append((taken.get(length, 0), k, sequence, offset))
            taken[length] = taken.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return {n: tuple(np.array(r, np.int64).T) for n, r in runs.items()}


def pack(docs: DataFrame, name: str = TOKENIZER, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces (a few numbers each) are stored once; the histogram has at most ``capacity``
    rows, and so have the runs that are sent to the tasks: both are bounded by the capacity
    and the search, not by the documents.
    """
    spark = docs.sparkSession
    pieces = materialised(cut_pieces(docs, name, path, end_id, capacity), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    runs = spark.sparkContext.broadcast(places(pack_lengths(counts, capacity)))
    # Rank within a length: ranked in groups of bounded size, then moved by the groups before.
    groups = spark.createDataFrame(
        [(n, math.ceil(c / RANK_GROUP)) for n, c in sorted(counts.items())], "_length bigint, _groups int"
    )
    row_hash = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = pieces.join(F.broadcast(groups), F.col("length") == F.col("_length")).withColumn(
        "_group", F.pmod(row_hash, F.col("_groups"))
    )
    before = Window.partitionBy("_length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        dealt.groupBy("_length", "_group")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    place = Window.partitionBy("_length", "_group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(place).cast("long") - 1).join(shift, ["_length", "_group"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def assign(batches: Iterator[pa.RecordBatch]):
        by_length = runs.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                first, copies, base, start = by_length[int(n)]
                at = np.searchsorted(first, rank[mine], "right") - 1
                within = rank[mine] - first[at]
                sequence[mine] = base[at] + within // copies[at]
                offset[mine] = start[at] + within % copies[at] * n
            columns = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        assign, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
