"""Language identification by known words first, then by shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is scored by its
longest character n-grams that were seen at all, averaged so that it weighs as one word;
where none was seen, the next shorter ones are tried.

Only text and lang of documents outside the held-out class are learnt from; a prediction
reads the text alone. The fit uses at most ``TRAIN_DOCS`` labelled documents, picked by a
hash of their id; all documents are scored, whole.

Defined results: a null text and one without letters are ``und`` with score 0; so is every
text if nothing could be learnt; ties go to the language first in order; null ids are never
learnt from and not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltpanel.llm.common import column, remainder, slices, worker_state
from voltpanel.llm.tokenizing import PieceCache
from voltpanel.session import materialised

#: Bound of the labelled documents that the fit reads.
TRAIN_DOCS = 20_000
#: Kept per language: words, and n-grams of each length; with them the model's size is bounded
#: by the number of languages.
WORDS, GRAMS, LONGEST = 20_000, 5_000, 4
HELD_OUT = (4, 2)
UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 150_000
#: Distinct words that a task of the fit counts before it hands its counts on.
TASK_WORDS = 50_000
SMOOTH = 0.5


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def training_rows(docs: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """text and lang of the documents to learn from: a hash sample of about ``bound`` rows."""
    modulus, held = HELD_OUT
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < bound)
    return rows.select("text", "lang")


def frequencies(rows: DataFrame) -> DataFrame:
    """lang, n (0: words), gram, count and place: the most frequent of each language and length."""

    def count(batches: Iterator[pa.RecordBatch]):
        seen: dict[str, Counter] = defaultdict(Counter)

        def told(lang: str, n: int, counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(counts), pa.string()),
                    "n": pa.array([n] * len(counts), pa.int32()),
                    "gram": pa.array(list(counts), pa.string()),
                    "count": pa.array(list(counts.values()), pa.int64()),
                }
            )

        def hand_on():
            for lang, words in seen.items():
                yield told(lang, 0, words)
                for n in range(1, LONGEST + 1):
                    counts: Counter = Counter()
                    for word, times in words.items():
                        for gram in grams(word, n):
                            counts[gram] += times
                    yield told(lang, n, counts)
            seen.clear()

        for batch in slices(batches):
            for text, lang in zip(column(batch, "text"), column(batch, "lang")):
                seen[lang].update(LETTERS.findall(text.lower()))
            if sum(map(len, seen.values())) > TASK_WORDS:
                yield from hand_on()
        yield from hand_on()

    counted = rows.mapInArrow(count, "lang string, n int, gram string, count bigint")
    total = materialised(counted.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")), "gram-counts")
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram"))
    # Literal limits, so that each side's shuffle carries no more rows than they keep.
    kept = [total.filter(side).withColumn("place", place).filter(F.col("place") <= most) for side, most in (("n = 0", WORDS), ("n > 0", GRAMS))]
    return kept[0].unionByName(kept[1]).select("lang", "n", "gram", "count")


class Model:
    """Log frequencies, one number per language: a matrix for the words and one for the
    n-grams of each length, with the row of each."""

    def __init__(self, rows: list[tuple]):
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.rows: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for _, n, gram, _ in rows:
            self.rows[n].setdefault(gram, len(self.rows[n]))
        counts = [np.zeros((len(known), len(self.langs))) for known in self.rows]
        for lang, n, gram, times in rows:
            counts[n][self.rows[n][gram], at[lang]] = times
        self.tables = [
            np.log((c + SMOOTH) / (c.sum(axis=0) + SMOOTH * max(1, len(c)))).astype(np.float32) for c in counts
        ]

    def word(self, word: str) -> bytes:
        known = self.rows[0].get(word)
        if known is not None:
            return self.tables[0][known].tobytes()
        for n in range(LONGEST, 0, -1):
            seen = [r for r in map(self.rows[n].get, grams(word, n)) if r is not None]
            if seen:
                return self.tables[n][seen].mean(axis=0, dtype=np.float32).tobytes()
        return np.zeros(len(self.langs), np.float32).tobytes()


class Scorer:
    """The model with a bounded cache of words."""

    def __init__(self, model: Model):
        self.model, self.cache = model, PieceCache(model.word)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        self.cache = self.cache.turned(CACHE_WORDS)
        get, langs, out = self.cache.__getitem__, self.model.langs, []
        for text in texts:
            words = LETTERS.findall(text.lower()) if text and langs else []
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            total = np.frombuffer(b"".join(map(get, words)), np.float32).reshape(-1, len(langs)).sum(axis=0, dtype=np.float64)
            share = np.exp(total - total.max())
            best = int(np.argmax(total))
            out.append((langs[best], float(share[best] / share.sum())))
        return out


def fit(docs: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """The model; what is collected has at most WORDS + LONGEST * GRAMS rows per language."""
    return Model([tuple(r) for r in frequencies(training_rows(docs, bound)).collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    modulus, held = HELD_OUT

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = worker_state("lang", key, lambda: Scorer(shared.value))
        for batch in slices(batches):
            answers = scorer.predict(column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([a for a, _ in answers], pa.string()),
                    pa.array([s for _, s in answers], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    is_held = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held, "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
