"""Benchmark decontamination: exact rare seeds, then Smith-Waterman alignment.

A document leaks an item if the best local alignment of the two (Smith-Waterman, word by
word) reaches a share of ``MIN_SCORE`` of the best possible score, so verbatim, edited and
paraphrased copies count alike. With m matched words and x mismatches and gaps the score is
2m - x, so a leak of score t has at least t / 2 matched words and spans at most 3n - t words
of the text (n: the item's words). Texts are cut into overlapping stretches that hold every
such span whole, and only stretches with that many of the item's words in common, each
counted at most as often as the item has it, can reach the score.

They are found by seeds. A Spark job counts the items' words in all documents, and each
item's words are ordered from rare to frequent. Of any ``need`` shared words at least k lie
among the n - need + k rarest, so those are the item's seeds, and a stretch that holds k of
them is a candidate: the items' frequent words, which nearly every stretch has, are never
joined. The seeds travel to the tasks and are joined there with the stretches' words; the
candidates' whole counts are then verified one by one, and what passes is aligned if the best
run of its words, each one of the item's counted as a match, could reach the score. Seeds are
single words because the score allows an edit next to every word: no longer n-gram must
survive in a copy that still reaches it. No candidate is dropped for being frequent.

Defined results: null and blank texts and items match nothing; an item of fewer than
``SEED_WORDS`` words must be there word for word; repeated items and rows each give their own rows; a
null doc_id or item_id keeps its row; an empty table on either side gives no leaks; other
columns are ignored by ``leaks`` and kept by ``clean``, which judges each row by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpanel.llm.common import column, slices

SEED_WORDS = 5
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: Test words up to which the items travel to every task (about 50 bytes a word); larger sets
#: are taken in parts.
BROADCAST_WORDS = 2_000_000
#: Seed hits, or words of candidates, held at a time.
GATHER = 2_000_000
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Lengths:
    """Items of similar length: their seeds, and what a leak of each needs.

    The k-th time that a word occurs is an entry of its own, so counts become sets.
    """

    def __init__(self, numbers: list[int], items: list[np.ndarray], scores: list[int], frequency: np.ndarray):
        self.numbers = np.array(numbers, np.int64)
        # The longest span of a leak in the text: a stretch is two of these, one overlapping.
        self.span = max(3 * len(items[k]) - scores[k] for k in numbers)
        self.need = np.array([-(-scores[k] // MATCH) for k in numbers], np.int64)
        self.least = np.maximum(1, self.need // 2)
        counts = [Counter(items[k].tolist()) for k in numbers]
        self.levels = max(max(c.values()) for c in counts)
        # Entries of each item from rare to frequent; any order would be exact.
        held = [
            sorted((int(frequency[w]), w * self.levels + level) for w, many in c.items() for level in range(many)) for c in counts
        ]
        self.entries = np.array([e for own in held for _, e in own], np.int64)
        self.bounds = np.cumsum([0, *map(len, held)])
        seeds = sorted(
            (e, at) for at, own in enumerate(held) for _, e in own[: len(own) - int(self.need[at]) + int(self.least[at])]
        )
        self.seed = np.array([e for e, _ in seeds], np.int64)
        self.holder = np.array([at for _, at in seeds], np.int64)
        self.known = np.zeros(len(frequency), bool)
        self.known[self.entries // self.levels] = True

    def stretches(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, item) of all stretches that share the words a leak needs."""
        size = len(self.known)
        keys, owner, first, cells = [], [], [], 0
        for number, text in enumerate(texts):
            blocks = len(text) // self.span + 1
            at = np.flatnonzero(self.known[text])
            # Cell c of a text holds its blocks c - 1 and c.
            cell, word = cells + at // self.span, text[at]
            keys += [cell * size + word, (cell + 1) * size + word]
            owner.append(np.full(blocks + 1, number, np.int64))
            first.append((np.arange(blocks + 1) - 1) * self.span)
            cells += blocks + 1
        key = np.sort(np.concatenate(keys))
        if not len(key):
            none = np.empty(0, np.int64)
            return none, none, none
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        level = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        key = key[level < self.levels]
        cell, entry = key // size, key % size * self.levels + level[level < self.levels]
        cell, item = self.candidates(cell, entry, size * self.levels)
        return np.concatenate(owner)[cell], np.concatenate(first)[cell], self.numbers[item]

    def candidates(self, cell: np.ndarray, entry: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, item) couples with enough entries in common, by seeds; cells come ascending."""
        low, high = np.searchsorted(self.seed, entry), np.searchsorted(self.seed, entry, "right")
        hit = np.flatnonzero(high > low)
        owner, low, many = cell[hit], low[hit], (high - low)[hit]
        whole, width = cell * size + entry, len(self.numbers)
        out = [np.empty((2, 0), np.int64)]
        at = 0
        while at < len(owner):
            # Whole cells, about GATHER seed hits at a time.
            end = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), GATHER)) + at)
            end = int(np.searchsorted(owner, owner[end - 1], "right"))
            n = many[at:end]
            place = np.repeat(low[at:end] - np.cumsum(n) + n, n) + np.arange(n.sum())
            couple, hits = np.unique(np.repeat(owner[at:end], n) * width + self.holder[place], return_counts=True)
            couple = couple[hits >= self.least[couple % width]]
            out += self.verified(couple // width, couple % width, whole, size)
            at = end
        return tuple(np.concatenate(out, axis=1))

    def verified(self, cell: np.ndarray, item: np.ndarray, whole: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """Those candidates whose entries in common, all counted, are as many as a leak needs."""
        step = max(1, GATHER // int(np.diff(self.bounds).max()))
        for at in range(0, len(cell), step):
            c, i = cell[at : at + step], item[at : at + step]
            n = self.bounds[i + 1] - self.bounds[i]
            starts = np.cumsum(n) - n
            asked = np.repeat(c * size, n) + self.entries[np.repeat(self.bounds[i] - starts, n) + np.arange(n.sum())]
            place = np.searchsorted(whole, asked)
            shared = np.add.reduceat((whole[np.minimum(place, len(whole) - 1)] == asked).astype(np.int64), starts)
            keep = shared >= self.need[i]
            yield np.stack([c[keep], i[keep]])


class Items:
    """The items as word numbers, grouped by length. 0 and 1 are no item's words.

    ``frequency`` tells how often a word occurs in the documents; absent words count as rarest.
    """

    def __init__(self, texts: list[str | None], n: int, min_score: float, frequency: dict[str, int] | None = None):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.items = [np.array([number(w, len(self.vocabulary) + 2) for w in words(t)], np.int64) for t in texts]
        self.full = [MATCH * len(x) for x in self.items]
        self.score = [max(1, math.ceil(f * (min_score if len(x) >= n else 1.0) - 1e-9)) for f, x in zip(self.full, self.items)]
        groups: dict[int, list[int]] = {}
        for k, x in enumerate(self.items):
            if 0 < len(x) and self.score[k] <= self.full[k]:
                groups.setdefault(len(x).bit_length() if len(x) & (len(x) - 1) else len(x).bit_length() - 1, []).append(k)
        known = frequency or {}
        counted = np.array([0, 0, *(known.get(w, 0) for w in self.vocabulary)], np.int64)
        self.groups = [Lengths(g, self.items, self.score, counted) for g in groups.values()]

    def numbers(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words(text), repeat(1)), np.int64)

    def reachable(self, item: list[int], passage: list[np.ndarray]) -> list[int]:
        """Couples that could reach their score if the order of the item's words were free.

        A word of the passage adds a match at most, if it is one of the item's, and costs a
        mismatch or a gap otherwise, so no alignment scores more than the best sum of a run.
        """
        order = sorted(range(len(item)), key=item.__getitem__)
        held, out, at = np.zeros(len(self.vocabulary) + 2, bool), [], 0
        while at < len(order):
            some, size = [], 0
            while at < len(order) and (not some or size + len(passage[order[at]]) < GATHER):
                some.append(order[at])
                size += len(passage[order[at]]) + 1
                at += 1
            starts = np.cumsum([0, *(len(passage[i]) + 1 for i in some)])
            # Before each passage a place for a drop that no run can make good.
            words = np.concatenate([x for i in some for x in ([0], passage[i])]).astype(np.int64)
            hit, first = np.empty(len(words), bool), 0
            for end in [*np.flatnonzero(np.diff([item[i] for i in some])) + 1, len(some)]:
                own = self.items[item[some[first]]]
                held[own] = True
                hit[starts[first] : starts[end]] = held[words[starts[first] : starts[end]]]
                held[own] = False
                first = end
            gain = np.where(hit, MATCH, max(MISMATCH, GAP))
            gain[starts[:-1]] = -MATCH * int(np.diff(starts).max())
            total = np.cumsum(gain)
            best = np.maximum.reduceat(total - np.minimum.accumulate(total), starts[:-1])
            out += [i for i, score in zip(some, best.tolist()) if score >= self.score[item[i]]]
        return out

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, float]]:
        """(text, item, start of the best stretch, score) of every couple that reaches its score."""
        texts = [self.numbers(t) for t in texts]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for group in self.groups:
            owner, first, item = (x.tolist() for x in group.stretches(texts))
            begin = [max(0, f) for f in first]
            passage = [texts[t][a : max(0, f + 2 * group.span)] for t, a, f in zip(owner, begin, first)]
            order = sorted(self.reachable(item, passage), key=lambda i: (len(passage[i]), len(self.items[item[i]])))
            for at in range(0, len(order), 32):
                some = order[at : at + 32]
                scores = align([self.items[item[i]] for i in some], [passage[i] for i in some])
                for i, score in zip(some, scores.tolist()):
                    if score >= self.score[item[i]]:
                        couple = owner[i], item[i]
                        best[couple] = max(best.get(couple, (0, 0)), (score, -begin[i]))
        return [(t, k, -start, score / self.full[k]) for (t, k), (score, start) in sorted(best.items())]


def align(item: list[np.ndarray], passage: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its passage, many couples at a time.

    A row of the score table is one array step for all couples; gaps along the passage are
    a running maximum.
    """
    n, m = max(map(len, item)), max(map(len, passage))
    a, b = np.zeros((len(item), n), np.uint64), np.ones((len(item), m), np.uint64)
    for i, (x, y) in enumerate(zip(item, passage)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    # Padding: 0 in items and 1 in passages never match each other.
    row, best = np.zeros((len(item), m + 1), np.int32), np.zeros(len(item), np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(n):
        diagonal = row[:, :-1] + np.where(a[:, i : i + 1] == b, MATCH, MISMATCH)
        fresh_row = np.zeros_like(row)
        fresh_row[:, 1:] = np.maximum(0, np.maximum(diagonal, row[:, 1:] + GAP))
        row = np.maximum.accumulate(fresh_row + slope, axis=1) - slope
        best = np.maximum(best, row.max(axis=1))
    return best


LEAK = "doc_id bigint, item bigint, n_words bigint, start bigint, score double"


def find_leaks(docs: DataFrame, items: Items) -> DataFrame:
    """One row per document and item that reaches its score."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]):
        known = shared.value
        for batch in slices(batches):
            ids = column(batch, "doc_id")
            rows = [(ids[t], k, len(known.items[k]), start, score) for t, k, start, score in known.leaks(column(batch, "text"))]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "item", "n_words", "start", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, LEAK)


def word_counts(docs: DataFrame, benchmark: DataFrame) -> dict[str, int]:
    """How often each of the items' words occurs in all documents; bounded by the items' words.

    Words are cut by Spark here. They may differ from ``words`` in rare letters, which changes
    the order of the seeds and not what they find.
    """

    def cut(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("word"))

    asked = F.broadcast(cut(benchmark).distinct())
    counted = cut(docs).join(asked, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r.word: r.n for r in counted.collect()}


def item_parts(docs: DataFrame, benchmark: DataFrame, n: int, min_score: float) -> Iterator[tuple[Items, list]]:
    """The test set in parts that fit the stated bound, each with its items' ids."""
    sizes = benchmark.select("item_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), r"\W+")).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    parts = max(1, -(-total // BROADCAST_WORDS))
    for part in range(parts):
        mine = sizes.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else sizes
        items = [(r[0], r[1]) for r in mine.select("item_id", "text").collect()]
        frequency = word_counts(docs, mine) if items else {}
        yield Items([x[1] for x in items], n, min_score, frequency), [x[0] for x in items]


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, n_words (of the item), start (first word of the best stretch), score.

    The test set must fit the stated bound to travel to the tasks; a larger one is taken in
    parts of that size, one pass over the documents each.
    """
    out = None
    for items, ids in item_parts(docs, benchmark, n, min_score):
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), "item bigint, item_id bigint")
        rows = find_leaks(docs, items).join(F.broadcast(names), "item").select("doc_id", "item_id", "n_words", "start", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with their own columns.

    Every row is judged by its own text, whatever its id: rows that share an id, or have none,
    do not stand for each other. All parts of a large test set are taken in one pass.
    """
    out = docs
    for items, _ in item_parts(docs, benchmark, SEED_WORDS, MIN_SCORE):
        out = without_leaks(out, items)
    return out


def without_leaks(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def keep(batches: Iterator[pa.RecordBatch]):
        known = shared.value
        for batch in slices(batches):
            held = {t for t, *_ in known.leaks(column(batch, "text"))}
            yield batch.filter(pa.array([t not in held for t in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
