"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a word vector with the mean of its character n-gram vectors. A GRU in
both directions gives every word a state; an attention layer weighs the states of a window
of ``WINDOW`` words into one logit. A window starts at every word, the last ones end with the
text. A document's logit is its greatest window's, mapped to a probability by a fit on the
training documents.

Windows share their words' states: the recurrence runs once over blocks of ``BLOCK`` words,
each entered ``WINDOW`` words early from both sides, so a state has read at least a window's
width of context (or up to the text's end) and depends on the text alone. As the output layer
is linear, a window's logit is a ratio of two sliding sums over its words.

Labels say only whether a document is toxic, so training windows are picked by the words'
log odds between toxic and other training documents. Labels of held-out documents are never
read, and a score reads the text alone. The fit uses at most ``TRAIN_DOCS`` labelled
documents of each class, picked by a hash of their id; every window of every document is
scored.

Defined results: a null text and one without words get the score of the lowest window;
without both classes among the labels every score is the share of toxic ones (0 for none);
null ids are never learnt from and not held out; repeated rows get equal scores; repeated
labels count as often as they stand; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpanel.llm.common import column, remainder, slices, worker_state
from voltpanel.llm.tokenizing import PieceCache
from voltpanel.session import materialised

#: Bounds of the fit: labelled documents per class, and windows of each.
TRAIN_DOCS, WINDOWS_EACH = 2_000, 3
HELD_OUT = (5, 0)
WINDOW, BLOCK = 24, 104
VOCABULARY, BUCKETS, GRAM = 4_000, 1_024, 3
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
#: Logit of a text without words.
LOWEST = -12.0
CACHE_WORDS = 60_000
#: Blocks that run through the recurrence together.
BLOCKS_EACH = 512
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def char_buckets(word: str) -> list[int]:
    padded = f"<{word}>"
    parts = (padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1)))
    return [zlib.crc32(p.encode("utf-8")) % BUCKETS for p in parts]


def window_starts(n: int) -> np.ndarray:
    """Every start of a window of ``WINDOW`` words, or of one with all words of a shorter text."""
    return np.arange(max(1, n - WINDOW + 1))


def sliding_sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``width`` values from each place on, by doubling: no difference of great sums."""
    out, done, power = np.zeros(len(x) - width + 1, x.dtype), 0, x
    size = 1
    while done < width:
        if width & size:
            out += power[done : done + len(out)]
            done += size
        power = power[:-size] + power[size:] if len(power) > size else power[:0]
        size *= 2
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


# --- the network -------------------------------------------------------------------------


class Network:
    """Parameters, forward pass, gradient, and Adam steps."""

    def __init__(self, vocabulary: list[str], odds: list[float], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: an unseen word
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        words_ = (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(np.float32)
        words_[1:, 0] = odds  # the first coordinate starts from the words' log odds
        words_[0, 0] = 0
        self.p = {
            "word": words_,
            "char": (0.1 * rng.standard_normal((BUCKETS, CHAR_DIM))).astype(np.float32),
            "wf": draw(d, 3 * h), "uf": draw(h, 3 * h), "bf": np.zeros(3 * h, np.float32),
            "wb": draw(d, 3 * h), "ub": draw(h, 3 * h), "bb": np.zeros(3 * h, np.float32),
            "wa": draw(2 * h, ATTENTION), "va": draw(ATTENTION),
            "wo": draw(2 * h), "bo": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.base = 1.0, 0.0, 0.0
        self.trained = False

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Every word vector's (with the biases) and every n-gram vector's share of all gates."""
        p, both = self.p, np.concatenate([self.p["wf"], self.p["wb"]], axis=1)
        return p["word"] @ both[:WORD_DIM] + np.concatenate([p["bf"], p["bb"]]), p["char"] @ both[WORD_DIM:]

    def projected(self, words_: list[str], gates: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The words' shares of all gates in both directions: what scoring needs of them."""
        buckets = [char_buckets(w) for w in words_]
        sizes = np.array([len(b) for b in buckets])
        flat = np.array([x for b in buckets for x in b])
        chars = np.add.reduceat(gates[1][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
        return gates[0][[self.index.get(w, 0) for w in words_]] + chars

    @staticmethod
    def _gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction; ``x`` is (steps, rows, 3h), ``mask`` (steps, rows, 1)."""
        steps, rows, h = x.shape[0], x.shape[1], u.shape[0]
        state, states, kept = np.zeros((rows, h), np.float32), np.empty((steps, rows, h), np.float32), []
        for t in range(steps):
            g = state @ u
            zr = 1.0 / (1.0 + np.exp(-(x[t, :, : 2 * h] + g[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * g[:, 2 * h :])
            new = n + z * (state - n)
            new = state + mask[t] * (new - state)
            if keep:
                kept.append((state, z, r, n, g[:, 2 * h :]))
            states[t] = state = new
        return states, kept

    @staticmethod
    def _gru_back(grad: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray):
        steps, rows, h = grad.shape
        dx, du, ds = np.empty((steps, rows, 3 * h), np.float32), np.zeros_like(u), np.zeros((rows, h), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, n, gn = kept[t]
            total = grad[t] + ds
            dnew, ds = total * mask[t], total * (1 - mask[t])
            dz, dn = dnew * (before - n) * z * (1 - z), dnew * (1 - z) * (1 - n * n)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            du += before.T @ dg
            ds += dnew * z + dg @ u.T
        return dx, du

    def pooled(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from their projected inputs, all (steps, rows, ...)."""
        p = self.p
        hf, kf = self._gru(xf, p["uf"], mask, keep)
        hb, kb = self._gru(xb[::-1], p["ub"], mask[::-1], keep)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        a = np.tanh(h @ p["wa"])
        e = np.where(mask[:, :, 0] > 0, a @ p["va"], -1e9)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        context = (weight[:, :, None] * h).sum(axis=0)
        logit = context @ p["wo"] + p["bo"][0]
        return (logit, (h, a, weight, context, kf, kb)) if keep else logit

    def gradient(self, ids: np.ndarray, chars: np.ndarray, mask: np.ndarray, label: np.ndarray):
        """Gradients of the mean cross-entropy; ids (steps, rows), chars (words, buckets) as weights."""
        p, rows = self.p, ids.shape[1]
        unique, at = np.unique(ids, return_inverse=True)
        at = at.reshape(ids.shape)
        wid = self.word_ids[unique]
        x = np.concatenate([p["word"][wid], chars[unique] @ p["char"]], axis=1)
        xf, xb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
        logit, (h, a, weight, context, kf, kb) = self.pooled(xf[at], xb[at], mask, True)
        dl = ((sigmoid(logit) - label) / rows).astype(np.float32)
        g = {"wo": context.T @ dl, "bo": np.array([dl.sum()], np.float32)}
        dc = dl[:, None] * p["wo"]
        dw = (dc[None] * h).sum(axis=2)
        de = weight * (dw - (weight * dw).sum(axis=0))
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["va"] = np.einsum("tr,tra->a", de, a)
        g["wa"] = np.einsum("trh,tra->ha", h, da)
        dh = weight[:, :, None] * dc[None] + da @ p["wa"].T
        half = HIDDEN
        dxf, g["uf"] = self._gru_back(dh[:, :, :half], kf, p["uf"], mask)
        dxb, g["ub"] = self._gru_back(dh[::-1, :, half:], kb, p["ub"], mask[::-1])
        df, db = np.zeros_like(xf), np.zeros_like(xb)
        np.add.at(df, at, dxf)
        np.add.at(db, at, dxb[::-1])
        g["wf"], g["bf"], g["wb"], g["bb"] = x.T @ df, df.sum(axis=0), x.T @ db, db.sum(axis=0)
        dx = df @ p["wf"].T + db @ p["wb"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], wid, dx[:, :WORD_DIM])
        g["char"] = chars[unique].T @ dx[:, WORD_DIM:]
        return g

    def train(self, windows: list[list[str]], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> None:
        rng, vocabulary = np.random.default_rng(seed), sorted({w for x in windows for w in x})
        place = {w: i for i, w in enumerate(vocabulary)}
        self.word_ids = np.array([self.index.get(w, 0) for w in vocabulary] or [0])
        chars = np.zeros((max(1, len(vocabulary)), BUCKETS), np.float32)
        for i, w in enumerate(vocabulary):
            b = char_buckets(w)
            np.add.at(chars[i], b, 1.0 / len(b))
        ids = np.zeros((WINDOW, len(windows)), np.int64)
        mask = np.zeros((WINDOW, len(windows), 1), np.float32)
        for i, x in enumerate(windows):
            ids[: len(x), i], mask[: len(x), i] = [place[w] for w in x], 1
        y = np.array(labels, np.float32)
        m, v, step = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        # A word unseen in training must have an input too: some words are hidden at random.
        known = self.word_ids.copy()
        least = max(epochs, -(-600 * BATCH // max(1, len(windows))) if len(windows) < 100 * BATCH else epochs)
        for _ in range(min(least, 60)):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                self.word_ids = np.where(rng.random(len(known)) < 0.05, 0, known)
                g = self.gradient(ids[:, some], chars, mask[:, some], y[some])
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    x = x * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        del self.word_ids
        self.trained = True

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Fit scale and shift of the documents' logits by weighted logistic regression."""
        spread = max(float(logits.std()), 1e-3)
        a, b = 1.0 / spread, -float(np.average(logits, weights=weights)) / spread
        for _ in range(50):  # Newton steps with a small ridge
            q = sigmoid(a * logits + b)
            g, w = weights * (q - labels), weights * q * (1 - q)
            grad = np.array([(g * logits).sum() + 1e-2 * a, g.sum()])
            hess = np.array([[(w * logits**2).sum() + 1e-2, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-6]])
            move = np.linalg.solve(hess, grad)
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -5, 5)
        self.scale, self.shift = (float(a), float(b)) if a > 0 else (1.0, 0.0)


class Scorer:
    """A network with a bounded cache of projected words."""

    def __init__(self, network: Network):
        self.network, self.gates, self.cache = network, network.gates(), PieceCache(None)

    def learn(self, seen: set) -> None:
        """Project the words that the cache lacks, all at once."""
        self.cache = self.cache.turned(CACHE_WORDS)
        cache, older, missing = self.cache, self.cache.older, []
        for w in seen:
            if w not in cache:
                known = older.get(w)
                if known is None:
                    missing.append(w)
                else:
                    cache[w] = known
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            cache.update(zip(part, map(np.ndarray.tobytes, self.network.projected(part, self.gates))))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The greatest window logit of every text; LOWEST without words."""
        out = np.full(len(texts), LOWEST)
        tokens = [words(t) for t in texts]
        self.learn(set().union(*tokens))
        get, width = self.cache.__getitem__, 6 * HIDDEN
        packed = b"".join(get(w) for x in tokens for w in x)
        if not packed:
            return out
        x = np.frombuffer(packed, np.float32).reshape(-1, width)
        sizes = np.array([len(t) for t in tokens])
        ends = np.cumsum(sizes)
        pull, value = self.words_read(x, ends - sizes, ends)
        for i in np.flatnonzero(sizes):
            mine, reach = slice(ends[i] - sizes[i], ends[i]), min(WINDOW, sizes[i])
            logit = sliding_sums((pull * value)[mine], reach) / sliding_sums(pull[mine], reach)
            out[i] = max(LOWEST, float(logit.max()) + float(self.network.p["bo"][0]))
        return out

    def words_read(self, x: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's attention (not yet divided by its window's sum) and its share of the logit.

        ``x`` holds the projected words of all texts, text i from ``firsts[i]`` up to ``lasts[i]``.
        """
        p, h = self.network.p, 3 * HIDDEN
        begin = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(firsts, lasts)])
        owner = np.repeat(np.arange(len(firsts)), -(-(lasts - firsts) // BLOCK))
        end = np.minimum(begin + BLOCK, lasts[owner])
        low, high = np.maximum(begin - WINDOW, firsts[owner]), np.minimum(end + WINDOW, lasts[owner])
        pull, value = np.empty(len(x)), np.empty(len(x))
        # Blocks of like length go together, so that few steps are masked.
        order = np.argsort(high - low, kind="stable")
        for at in range(0, len(order), BLOCKS_EACH):
            some = order[at : at + BLOCKS_EACH]
            steps = np.arange(int((high - low)[some].max()))[:, None]
            # Forwards a block is entered at its low end, backwards at its high end.
            ahead, back = low[some] + steps, high[some] - 1 - steps
            hf, _ = Network._gru(x[np.minimum(ahead, len(x) - 1), :h], p["uf"], (ahead < end[some]).astype(np.float32)[:, :, None], False)
            hb, _ = Network._gru(x[np.maximum(back, 0), h:], p["ub"], (back >= begin[some]).astype(np.float32)[:, :, None], False)
            own = (ahead >= begin[some]) & (ahead < end[some])
            step, lane = np.nonzero(own)
            place = ahead[step, lane]
            states = np.concatenate([hf[step, lane], hb[high[some][lane] - 1 - place, lane]], axis=1)
            pull[place] = np.exp((np.tanh(states @ p["wa"]) @ p["va"]).astype(np.float64))
            value[place] = states @ p["wo"]
        return pull, value

    def scores(self, texts: list[str | None]) -> np.ndarray:
        n = self.network
        return sigmoid(n.scale * self.logits(texts) + n.shift) if n.trained else np.full(len(texts), n.base)


# --- the DataFrame operator --------------------------------------------------------------


def training_docs(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic of at most about ``bound`` labelled documents per class, and the classes' sizes."""
    modulus, held = HELD_OUT
    usable = labels.filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held))
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {int(r[0]): int(r[1]) for r in usable.groupBy("toxic").count().collect()}
    chosen = usable.filter(
        F.pmod(F.xxhash64("doc_id"), F.when(F.col("toxic") == 1, sizes.get(1, 1)).otherwise(sizes.get(0, 1))) < bound
    )
    # At most about twice the bound of ids: small whatever the tables hold.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialised(rows, "toxicity-training"), sizes


def log_odds(rows: DataFrame) -> list[tuple[str, float]]:
    """The words that tell the classes apart most, with the log odds of a document holding them."""

    def count(batches: Iterator[pa.RecordBatch]):
        seen = {0: Counter(), 1: Counter()}
        for batch in slices(batches):
            for text, toxic in zip(column(batch, "text"), column(batch, "toxic")):
                seen[toxic].update(set(words(text)))
        both = [(w, seen[0][w], seen[1][w]) for w in seen[0].keys() | seen[1].keys()]
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array([b[0] for b in both], pa.string()),
                "clean": pa.array([b[1] for b in both], pa.int64()),
                "toxic": pa.array([b[2] for b in both], pa.int64()),
            }
        )

    sizes = {int(r[0]): int(r[1]) for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    seen = rows.select("text", "toxic").mapInArrow(count, "word string, clean bigint, toxic bigint")
    seen = seen.groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).filter(F.col("c") + F.col("t") >= 3)
    rate = lambda c, n: (F.col(c) + 0.5) / F.lit(n + 1.0)
    odds = F.log(rate("t", n1) / (1 - rate("t", n1) + 1e-9)) - F.log(rate("c", n0) / (1 - rate("c", n0) + 1e-9))
    # Weight by how often a word is there at all: rare words' odds are mostly noise.
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    rows = seen.select("word", (odds / spread).alias("z"), odds.alias("odds"))
    rows = rows.orderBy(F.desc(F.abs("z")), "word").limit(VOCABULARY).collect()
    return [(r[0], float(np.clip(r[2], -4, 4)) if abs(r[1]) > 3 else 0.0) for r in rows]


def training_windows(rows: DataFrame, odds: list[tuple[str, float]]) -> tuple[list[list[str]], list[int]]:
    """Windows to learn from: of toxic documents some of those with the greatest odds, of others
    one of these and some anywhere, picked by their id."""
    weight = {w: max(0.0, o) for w, o in odds}

    def pick(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            out, label = [], []
            for doc_id, text, toxic in zip(*(column(batch, c) for c in ("doc_id", "text", "toxic"))):
                tokens = words(text)
                if not tokens:
                    continue
                starts = window_starts(len(tokens))
                summed = np.concatenate([[0.0], np.cumsum([weight.get(w, 0.0) for w in tokens])])
                heat = summed[np.minimum(starts + WINDOW, len(tokens))] - summed[starts]
                rng = np.random.default_rng(abs(doc_id or 0))
                # Any of the hottest: the first would have its telling words at the end each time.
                hottest = np.flatnonzero(heat >= heat.max() - 1e-9)
                take = hottest[rng.integers(0, len(hottest), WINDOWS_EACH if toxic else 1)].tolist()
                if toxic == 0:
                    take += rng.integers(0, len(starts), WINDOWS_EACH - 1).tolist()
                for k in dict.fromkeys(take):
                    out.append(tokens[starts[k] : starts[k] + WINDOW])
                    label.append(toxic)
            yield pa.RecordBatch.from_pydict({"window": pa.array(out, pa.list_(pa.string())), "toxic": pa.array(label, pa.int32())})

    picked = rows.mapInArrow(pick, "window array<string>, toxic int").collect()
    picked = sorted((list(r[0]), r[1]) for r in picked)
    return [p[0] for p in picked], [p[1] for p in picked]


def _scored(rows: DataFrame, network: Network, names: list[str], extra: list[pa.DataType], calibrated: bool) -> DataFrame:
    """The first columns of ``rows`` as they are, then the logit or the score of ``text``."""
    shared, key = rows.sparkSession.sparkContext.broadcast(network), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = worker_state("toxicity", key, lambda: Scorer(shared.value))
        for batch in slices(batches):
            texts = column(batch, "text")
            values = scorer.scores(texts) if calibrated else scorer.logits(texts)
            kept = [batch.column(i).cast(kind) for i, kind in enumerate(extra)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.float64())], [*names, "value"])

    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean"}
    schema = ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, extra)) + ", value double"
    return rows.select(*names, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Network:
    """Train on the bounded sample; the windows and logits collected are bounded by it too."""
    rows, sizes = training_docs(docs, labels, bound)
    odds = log_odds(rows)
    network = Network([w for w, _ in odds], [o for _, o in odds])
    network.base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    windows, toxic = training_windows(rows, odds)
    if len(set(toxic)) < 2:
        return network
    network.train(windows, toxic)
    seen = _scored(rows, network, ["toxic"], [pa.int32()], False).collect()
    label = np.array([r[0] for r in seen], float)
    # Each class stands for all its labelled documents, sampled or not.
    weight = np.where(label == 1, sizes[1] / max(1, label.sum()), sizes[0] / max(1, (1 - label).sum()))
    network.calibrate(np.array([r[1] for r in seen]), label, weight)
    return network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    modulus, held = HELD_OUT
    is_held = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held, "text")
    rows = _scored(rows, network, ["doc_id", "held_out"], [pa.int64(), pa.bool_()], True)
    return rows.select("doc_id", "held_out", F.col("value").alias("score"), (F.col("value") >= 0.5).cast("int").alias("predicted"))
