"""Token counts by a two-tier lookup inside the map tasks.

Tier one is a broadcast table of the corpus's frequent pre-tokens and their lengths; tier
two is a cache in each worker that encodes what the table lacks. Pre-tokens are never
shuffled: the table comes from one short summary per task, made over all documents.

Which pre-tokens the table holds affects speed only. Counts always equal the library's own.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null ids and repeated
rows keep their rows; an empty table gives no rows; other columns are ignored. Long texts
are counted whole.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpanel.llm.common import column, sized, slices, texts_of, worker_state
from voltpanel.llm.tokenizing import TextCounter

TOKENIZER = "byte_bpe_50k.json"
#: Entries of the broadcast table, and of each task's summary: the bound of what is broadcast
#: (about 1 MB) and of what a task hands on.
TABLE_ENTRIES = 50_000
TASK_ENTRIES = 5_000
#: Distinct pre-tokens a task counts at a time; rarer ones are dropped beyond it.
TASK_COUNTERS = 100_000
LIMIT = 1024


def _counter(name: str, path: str | None, key: str, known: dict | None) -> TextCounter:
    return worker_state("count", f"{name}-{path}-{key}", lambda: TextCounter(name, path, known))


def frequent_words(docs: DataFrame, entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent blank-separated words over all documents, from bounded task summaries."""

    def summarise(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            seen.update(chain.from_iterable(t.split(" ")[1:] for t in column(batch, "text") if t))
            if len(seen) > TASK_COUNTERS:
                # Lossy counting: what was seen least goes first, the frequent stay.
                seen = Counter(dict(seen.most_common(TASK_COUNTERS // 2)))
        top = seen.most_common(TASK_ENTRIES)
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    summaries = docs.select("text").mapInArrow(summarise, "word string, n bigint")
    merged = summaries.groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in merged.orderBy(F.desc("n"), "word").limit(entries).select("word").collect()]


def token_counts(docs: DataFrame, name: str = TOKENIZER, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    lengths = TextCounter(name, path)
    known = {w: lengths._word(w) for w in frequent_words(docs)}
    table = docs.sparkSession.sparkContext.broadcast(known)
    key = uuid.uuid4().hex

    def count(batches):
        counter = _counter(name, path, key, table.value)
        for batch in sized(batches, "text"):
            texts = texts_of(batch)
            counts = counter.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
