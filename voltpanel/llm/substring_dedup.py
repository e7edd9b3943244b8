"""Removal of repeated passages by relative Lempel-Ziv parsing.

A window is ``WINDOW`` consecutive words. A word goes if a window over it also starts in a
document with a smaller id. A document is factored greedily against the reference: each
factor is the longest run of words that the reference holds. A window that the reference
holds is met by one factor or crosses one factor boundary, so long factors are duplicate
spans and only the surroundings of the boundaries are looked up once more.

The reference of all smaller documents is never in one place. It is cut into blocks by
content: every window belongs to the block of its least ``GRAM``-word hash, which equal
windows share. Neighbouring windows of one block travel as one context; equal contexts are
reduced to the one with the smallest id before anything is shipped (all others are repeats
as a whole), and only blocks with contexts of several documents are parsed. A block indexes
its contexts in a suffix automaton, in the order of ids. A block with more than ``CROWD``
different contexts is not parsed in one task: its windows are grouped anew by longer runs,
which sets most of them apart, and the rest are compared by their own hashes, which Spark can
combine and spread.

Words and windows are compared by 64-bit hashes. Defined results: a null or blank text has
no words; rows with equal ids are not smaller than each other; a row without an id is kept
whole and is no reference; fewer words than a window are kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpanel.llm.common import column, slices
from voltpanel.session import materialised

WINDOW, GRAM = 50, 10
#: Words of the runs that group the windows of crowded blocks.
FINE_GRAM = 40
#: Windows of a context at most; bounds a block's members whatever repeats in a text.
RUN = 64
#: Contexts that one block's automaton takes.
CROWD = 256
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

CONTEXTS = "doc_id bigint, text_key bigint, contexts array<struct<block:bigint,content:bigint,start:int,n:int>>"
SPANS = "block bigint, content bigint, spans array<struct<start:int,stop:int>>"


# --- words and contexts ------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sequence:
    """Word hashes with the hash of any run of them at hand."""

    def __init__(self, hashes: np.ndarray):
        up = np.full(len(hashes) + 1, BASE, np.uint64)
        down = np.full(len(hashes) + 1, INVERSE, np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(up, dtype=np.uint64)[:-1], dtype=np.uint64)])

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def contexts(hashes: np.ndarray, sizes: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """text number, block, content, start and window count of the contexts of many texts.

    ``hashes`` are the texts' words one after another, ``sizes`` the texts' word counts; a
    block is the least hash of the ``gram``-word runs in a window.
    """
    empty = np.empty(0, np.int64)
    if len(hashes) < WINDOW:
        return empty, empty, empty, empty, empty
    sequence = Sequence(hashes)
    at = np.arange(len(hashes) - gram + 1)
    least = sequence.runs(at, at + gram)
    span, width = WINDOW - gram + 1, 1
    while 2 * width <= span:  # least of 2, 4, 8, ... neighbours
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    firsts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + WINDOW <= (firsts + sizes)[text])
    if not len(window):
        return empty, empty, empty, empty, empty
    text, block = text[window], least[window]
    fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (block[1:] != block[:-1])])
    lead = np.flatnonzero(fresh)
    inside = np.arange(len(window)) - np.repeat(lead, np.diff(np.append(lead, len(window))))
    lead = np.flatnonzero(inside % RUN == 0)
    n = np.diff(np.append(lead, len(window)))
    start = window[lead]
    content = sequence.runs(start, start + n + WINDOW - 1)
    return text[lead], block[lead].view(np.int64), content.view(np.int64), start - firsts[text[lead]], n


def document_contexts(docs: DataFrame) -> DataFrame:
    """The contexts of every document with an id."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            lists = [words_of(t) for t in column(batch, "text")]
            sizes = np.array([len(w) for w in lists])
            text, block, content, start, n = contexts(word_hashes([w for words in lists for w in words]), sizes)
            cuts = np.searchsorted(text, np.arange(len(lists) + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays(
                [pa.array(block), pa.array(content), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["block", "content", "start", "n"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(cuts), rows)],
                ["doc_id", "text_key", "contexts"],
            )

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text_key", "text").mapInArrow(scan, CONTEXTS)


# --- parsing -----------------------------------------------------------------------------


class Automaton:
    """Suffix automaton over several word sequences: knows every run of words in them."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _split(self, before: int, word: int, old: int) -> int:
        """The part of a state that is reached with its shortest texts, as a state of its own."""
        copy = self._state(self.length[before] + 1, dict(self.next[old]), self.link[old])
        while before != -1 and self.next[before].get(word) == old:
            self.next[before][word] = copy
            before = self.link[before]
        self.link[old] = copy
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
                continue
            new, before = self._state(self.length[last] + 1, {}, 0), last
            while before != -1 and word not in self.next[before]:
                self.next[before][word] = new
                before = self.link[before]
            if before != -1:
                old = self.next[before][word]
                self.link[new] = old if self.length[old] == self.length[before] + 1 else self._split(before, word, old)
            last = new

    def factors(self, words: list[int]) -> list[tuple[int, int]]:
        """The greedy parse; a word that was never seen is an empty factor."""
        out, at = [], 0
        while at < len(words):
            state, stop = 0, at
            while stop < len(words) and (state := self.next[state].get(words[stop], -1)) != -1:
                stop += 1
            out.append((at, stop))
            at = max(stop, at + 1)
        return out

    def windows(self, words: list[int], start: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
        """Windows inside a stretch that the sequences hold."""
        state = matched = 0
        for at in range(start, stop):
            while state and words[at] not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            follow = self.next[state].get(words[at])
            state, matched = (0, 0) if follow is None else (follow, matched + 1)
            if matched >= size:
                yield at + 1 - size, at + 1


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def repeated(index: Automaton, words: list[int], size: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of the words that windows in the index cover: long factors, and windows across a
    boundary of two factors."""
    parse, spans = index.factors(words), []
    for number, (start, stop) in enumerate(parse):
        if stop - start >= size:
            spans.append((start, stop))
        if number and parse[number - 1][1] == start and stop - parse[number - 1][0] >= size:
            first, last = max(parse[number - 1][0], start - size + 1), min(stop, start + size - 1)
            spans += index.windows(words, first, last, size)
    return united(spans)


def parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each context that smaller documents of its block hold; rows come sorted by
    block and id."""
    block, index, waiting, last = None, Automaton(), [], None
    for batch in slices(batches, 1024):
        out = []
        for row in batch.to_pylist():
            if row["block"] != block:
                block, index, waiting, last = row["block"], Automaton(), [], None
            if row["doc_id"] != last:  # the documents before are references now
                for words in waiting:
                    index.add(words)
                waiting, last = [], row["doc_id"]
            spans = repeated(index, row["words"])
            waiting.append(row["words"])
            if spans:
                out.append((block, row["content"], [{"start": a, "stop": b} for a, b in spans]))
        columns = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, SPAN_TYPES)], ["block", "content", "spans"])


SPAN_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


def finer_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of crowded contexts, grouped anew by their least ``FINE_GRAM``-word hash:
    block, content, document, that hash, the first window's place and the windows' hashes."""
    for batch in slices(batches, 1024):
        block, content, doc, words = (batch.column(batch.schema.get_field_index(c)) for c in ("block", "content", "doc_id", "words"))
        sizes = np.diff(words.offsets.to_numpy())
        hashes = words.flatten().to_numpy().view(np.uint64)
        row, fine, _, place, n = contexts(hashes, sizes, FINE_GRAM)
        firsts, stops = np.cumsum(sizes) - sizes, np.cumsum(n)
        start = np.repeat(firsts[row] + place - (stops - n), n) + np.arange(n.sum())
        keys = Sequence(hashes).runs(start, start + WINDOW).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(keys))
        taken = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [block.take(taken), content.take(taken), doc.take(taken), pa.array(fine), pa.array(place.astype(np.int32)), lists],
            ["block", "content", "doc_id", "fine", "place", "windows"],
        )


FINER = "block bigint, content bigint, doc_id bigint, fine bigint, place int, windows array<bigint>"


def crowded_spans(words: DataFrame) -> DataFrame:
    """Spans of crowded blocks' contexts, by the windows' own hashes.

    Most windows that only reach into a common passage hold a long run of words that no other
    document has; grouped by such runs they fall away before single windows are shipped.
    """
    finer = materialised(words.mapInArrow(finer_runs, FINER), "finer-runs")
    ends = finer.groupBy("block", "fine").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"))
    shared = finer.join(ends.filter(F.col("_a") < F.col("_b")).select("block", "fine"), ["block", "fine"])
    windows = shared.select("block", "content", "doc_id", "place", F.posexplode("windows").alias("_at", "window"))
    firsts = windows.groupBy("block", "window").agg(F.min("doc_id").alias("_first"))
    later = windows.join(firsts, ["block", "window"]).filter(F.col("doc_id") > F.col("_first"))
    start = F.col("place") + F.col("_at")
    return later.groupBy("block", "content").agg(F.collect_set(F.struct(start.alias("start"), (start + WINDOW).alias("stop"))).alias("spans"))


def context_words(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """The word hashes of contexts, taken out of their documents' texts."""
    wanted = needed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("block", "content", "start", "n", "crowded")).alias("wanted"))
    found = docs.join(wanted, ["doc_id", "text_key"]).select("doc_id", "text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, 16):
            rows = []
            for doc_id, text, wanted in zip(column(batch, "doc_id"), column(batch, "text"), column(batch, "wanted")):
                hashes = word_hashes(words_of(text)).view(np.int64)
                rows += [
                    (w["block"], w["content"], doc_id, w["crowded"], hashes[w["start"] : w["start"] + w["n"] + WINDOW - 1]) for w in wanted
                ]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            columns = zip(*rows) if rows else ((),) * 5
            names = ["block", "content", "doc_id", "crowded", "words"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return found.mapInArrow(cut, "block bigint, content bigint, doc_id bigint, crowded boolean, words array<bigint>")


# --- the operator ------------------------------------------------------------------------


def context_spans(members: DataFrame, docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """block, content, first (the smallest id with the context) and the spans that are repeats
    there, of the contexts that are repeats anywhere."""
    spark = docs.sparkSession
    least = F.min(F.struct("doc_id", "text_key", "start", "n")).alias("least")
    distinct = materialised(
        members.groupBy("block", "content").agg(least, F.max("doc_id").alias("last")).select("block", "content", "least.*", "last"),
        "distinct-contexts",
    )
    blocks = distinct.groupBy("block").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"))
    several = blocks.filter((F.col("_n") > 1) & (F.col("_a") < F.col("_b"))).select("block", (F.col("_n") > crowd).alias("crowded"))
    words = materialised(context_words(distinct.join(several, "block"), docs), "context-words")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = words.filter("not crowded").drop("crowded").repartition(tasks, "block").sortWithinPartitions("block", "doc_id")
    parsed = plain.mapInArrow(parse_blocks, SPANS)
    met = crowded_spans(words.filter("crowded"))
    spans = materialised(parsed.unionByName(met), "context-spans")
    whole = distinct.filter(F.col("doc_id") < F.col("last")).select("block", "content", F.col("doc_id").alias("first"))
    known = spans.join(distinct.select("block", "content", F.col("doc_id").alias("_own")), ["block", "content"])
    both = known.join(whole.drop("first").withColumn("_again", F.lit(True)), ["block", "content"], "left")
    rest = whole.join(spans, ["block", "content"], "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return both.select("block", "content", F.col("_own").alias("first"), "spans").unionByName(rest)


def removed_spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_key and the repeated spans (word places) of documents that have some."""
    scanned = materialised(document_contexts(docs), "contexts").select("doc_id", "text_key", F.inline("contexts"))
    ends = scanned.groupBy("block").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"))
    shared = ends.filter(F.col("_a") < F.col("_b")).select("block")
    members = materialised(scanned.join(shared, "block"), "shared-contexts")
    marked = members.join(context_spans(members, docs, crowd), ["block", "content"])
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("n") + WINDOW - 1).alias("stop")))
    spans = F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("spans"))
    placed = marked.select("doc_id", "text_key", "start", F.explode(spans).alias("_span"))
    placed = placed.select(
        "doc_id", "text_key", F.struct((F.col("start") + F.col("_span.start")).alias("start"), (F.col("start") + F.col("_span.stop")).alias("stop")).alias("span")
    )
    return placed.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))


def deduplicated(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, the removed spans and the kept words of every document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = docs.join(removed_spans(docs, crowd), ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string())
        for batch in slices(batches):
            rows = []
            for doc_id, text, spans in zip(*(column(batch, c) for c in ("doc_id", "text", "spans"))):
                words, cuts = words_of(text), united([(s["start"], s["stop"]) for s in spans or ()])
                kept, at = [], 0
                for start, stop in [*cuts, (len(words), len(words))]:
                    kept += words[at:start]
                    at = stop
                told = [{"start": a, "stop": b} for a, b in cuts]
                rows.append((doc_id, len(words), len(words) - len(kept), told, b" ".join(kept).decode("utf-8")))
            columns = zip(*rows) if rows else ((),) * 5
            names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, kept string"
    return found.mapInArrow(keep, schema)
