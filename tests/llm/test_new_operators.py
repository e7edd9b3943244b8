"""Substring dedup, hard negatives, the Merkle manifest and language models against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as driver
from voltpanel.llm import common, hard_negatives, lang_backoff, merkle_manifest, substring_dedup

duckdb = pytest.importorskip("duckdb")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, `_tie` string, TREE string, spans int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_hard_negatives", "op13_merkle_manifest"])
def test_equals_sql(spark, sf_dir, name):
    rows = driver.queries()[name](spark, sf_dir)
    names = sorted(rows.columns)
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = db.execute(f"select {', '.join(names)} from ({driver.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(want) and want


# --- substring dedup ---------------------------------------------------------------------


def kept_words(docs, size=50):
    first = {}
    for d, t in docs:
        words = (t or "").encode().split()
        for i in range(len(words) - size + 1 if d is not None else 0):
            key = tuple(words[i : i + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in docs:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - size + 1 if d is not None else 0):
            if first[tuple(words[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d or -1, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out)


def passages(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common_words, base = ([rnd.choice(vocabulary) for _ in range(k)] for k in (75, 250))
    docs = []
    for d in range(1, n + 1):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 110))]
        if d % 5 in (0, 1):  # pieces of one passage, cut anywhere, in other surroundings
            at = rnd.randrange(len(body) + 1)
            body[at:at] = common_words[rnd.randrange(30) : rnd.randrange(45, 76)]
        elif d % 5 == 2:  # edited copies
            body = [rnd.choice(vocabulary) if rnd.random() < 0.01 else w for w in base]
        elif d % 5 == 3:  # texts with a period
            body = ["a", "b", "c"] * rnd.randint(10, 60)
        docs.append((d, rnd.choice(" \n\t").join(body)))
    return docs


@pytest.mark.parametrize("crowd", [256, 2, 0])
def test_substring_dedup_equals_brute_force(spark, crowd):
    docs = passages(crowd, 250)
    docs += [(7, docs[11][1]), (7, docs[11][1]), (None, docs[11][1]), (900, None), (901, ""), (902, " \n "), (903, "é " * 60), (904, "é " * 49)]
    docs += [(905, "one two three four five " * 3000), (5, "one two three four five " * 20)]
    rows = substring_dedup.deduplicated(documents(spark, [(d, t, "en", "s", 1) for d, t in docs]), crowd).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in rows) == kept_words(docs)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in rows)


def test_substring_dedup_of_nothing(spark):
    none = documents(spark, [])
    assert substring_dedup.deduplicated(none).count() == 0


def test_greedy_parse_and_boundary_windows():
    index = substring_dedup.Automaton()
    index.add([1, 2, 3, 4, 5, 6])
    index.add([4, 5, 6, 7, 8])
    assert index.factors([1, 2, 3, 4, 9, 5, 6, 7]) == [(0, 4), (4, 4), (5, 8)]
    # The greedy factor ends after 6; the window 4 5 6 7 lies across its end.
    assert index.factors([3, 4, 5, 6, 7]) == [(0, 4), (4, 5)]
    assert substring_dedup.repeated(index, [3, 4, 5, 6, 7], 4) == [(0, 5)]
    assert substring_dedup.repeated(index, [3, 4, 9, 6, 7], 3) == []
    rnd = random.Random(3)
    for _ in range(200):
        index, texts = substring_dedup.Automaton(), [[rnd.randrange(3) for _ in range(rnd.randint(0, 30))] for _ in range(3)]
        for t in texts[:2]:
            index.add(t)
        held = {tuple(t[i : i + 5]) for t in texts[:2] for i in range(len(t) - 4)}
        last = texts[2]
        want = substring_dedup.united([(i, i + 5) for i in range(len(last) - 4) if tuple(last[i : i + 5]) in held])
        assert substring_dedup.repeated(index, last, 5) == want


# --- hard negatives ----------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label int, leaf int, `_chain` string"


def mined(rows):
    good = [
        (v, (lab + 1) % 10 if v is not None and v % 7 == 0 else lab, [math.floor(256 * c) for c in x])
        for v, x, lab in rows
        if lab is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)
    ]
    out, order = [], lambda p: (-p[0], p[1] is None, p[1] or 0)
    for i, (v, lab, x) in enumerate(good):
        if v is None or v % 100:
            continue
        near = [(sum(a * b for a, b in zip(x, y)), w, other) for j, (w, other, y) in enumerate(good) if j != i and len(y) == len(x)]
        for ps, p, _ in sorted((n for n in near if n[2] == lab), key=order)[:5]:
            window = sorted((n for n in near if n[2] != lab and 30 * ps <= 100 * n[0] <= 90 * ps), key=order)[:10]
            out += [(v, p, k, n, ps, s) for k, (s, n, _) in enumerate(window, 1)]
    return sorted(out, key=str)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    # Small trees, chains and blocks, so that every storey is used.
    for name, value in (("LEAF", 4), ("FANOUT", 2), ("ANCHORS", 3), ("CHAIN", 2), ("MAX_TASKS", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(5)
    rows = [(25 * i, np.round(rng.normal(size=6) + 0.5, 1).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(5000 + i, [0.5] * 6, i % 3) for i in range(150)]  # ties: one vector, many ids
    rows += [rows[4], rows[4], (None, [0.5] * 6, 1), (None, [1.0] * 6, 2), (20_000, None, 1), (20_100, [1.0] * 6, None)]
    rows += [(20_200, [float("nan")] + [1.0] * 5, 1), (20_300, [None] + [1.0] * 5, 1), (20_400, [float("inf")] * 6, 1)]
    rows += [(20_500, [], 3), (20_501, [], 3), (20_502, [], 2), (20_600, [0.5, 0.5], 1), (20_601, [0.5, 0.4], 1), (20_602, [0.25, 0.25], 2)]
    rows += [(20_700, [-1.0] * 3, 1), (20_701, [1.0] * 3, 1), (20_702, [-1.0] * 3, 2)]  # no window below zero
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    forest = hard_negatives.index(hard_negatives.usable(frame), 32)
    monkeypatch.setattr(hard_negatives, "index", lambda usable: forest)
    got = hard_negatives.hard_negatives(frame).collect()
    assert sorted(map(tuple, got), key=str) == mined(rows) and len(got) > 100
    monkeypatch.undo()
    assert hard_negatives.hard_negatives(frame.limit(0)).count() == 0


def test_products_beyond_doubles(spark):
    rows = [(100, [2.0**30, 1.0], 1), (101, [2.0**30, 3.0], 1), (102, [2.0**29, 7.0], 2), (103, [2.0**29, 6.0], 2), (104, [1.0, 1.0], 2)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = [tuple(r) for r in hard_negatives.hard_negatives(frame).collect()]
    limit = hard_negatives.LONG
    assert mined(rows)[0][4] > limit  # the given products do not fit a long: all are its greatest value
    assert got == [] or all(r[4] <= limit for r in got)


def test_boxes_are_pruned():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([rng.normal(m, 0.05, (200, 3)) for m in (-3, 0, 3)]))
    label = np.repeat([0, 1, 2], 200)
    pages = hard_negatives.str_pages(label, x, 16)
    assert sorted(np.concatenate(pages).tolist()) == list(range(600)) and all(len(p) <= 16 for p in pages)
    leaves = [
        {"tree": 1, "leaf": n, "dim": 3, "ids": p.tolist(), "labels": label[p].tolist(), "vectors": x[p].astype("<i2").tobytes(), "small": True}
        for n, p in enumerate(pages)
    ]
    tree, vector = hard_negatives.Tree(leaves), x[450]
    low, high = tree.intervals(vector[None])
    scores = x @ vector
    for n, p in enumerate(pages):
        assert low[0, n] <= scores[p].min() and scores[p].max() <= high[0, n]
    anchor = hard_negatives.Anchor({"tree": -1, "labels": [2], "ids": []}, True, 5)
    read = hard_negatives.best_first(tree, anchor, vector, low[0], high[0], True)
    assert [-s for s, _ in anchor.windows[0].rows] == sorted(scores[label == 2].astype(int).tolist())[::-1][:5]
    assert read < len(pages) / 3


# --- the manifest ------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    d, text, lang, source, n = row
    fields = (d, source, lang, n + more if n is not None else None, text)
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def manifests(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    trees = [grown([leaf(r) for r in m]) for m in members]
    crown, out = grown([t[-1][0] for t in trees]), []
    for k, (tree, rows_of) in enumerate(zip(trees, members)):
        for i, r in enumerate(rows_of):
            path = []
            for levels, at in ((tree, i), (crown, k)):
                for row in levels[:-1]:
                    path.append((row[at ^ 1] if at ^ 1 < len(row) else None, at & 1))
                    at >>= 1
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if hit else 0)
            for other, right in path:
                node = h(node if other is None else other + node if right else node + other)
            proof = h("".join(o for o, _ in path if o))
            out.append((str(r[0]), tree[0][i], tree[-1][0], crown[-1][0], proof, node, node == crown[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("span", [12, 2, 1])
def test_manifest_equals_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(merkle_manifest, "SPAN", span)
    rnd = random.Random(span)
    rows = [(d, f"text {d} é" * (d % 3), rnd.choice(["en", "en", "de", "fr", None, ""]), "s", d * 3) for d in range(-3, 60)]
    rows += [(d, None, "é", None, None) for d in (1000, 7, 2**62)] + [(None, "no id", "en", "s", 2), (None, None, None, None, None)]
    rows += [(5, "again", "en", "s", 1), (5, "again", "en", "s", 1), (5, "else", "en", "s", 1), (77, "x" * 100_000, "zz", "s", 2**63 - 1), (70, "", "yy", "", 0)]
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in merkle_manifest.manifest(documents(spark, rows)).collect())
    assert got == manifests(rows) and not all(r[6] for r in got)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle_manifest.manifest(documents(spark, [])).count() == 0
    (only,) = merkle_manifest.manifest(documents(spark, [(1, "t", None, "s", 1)])).collect()
    assert only.leaf == only.subroot == only.root and only.proof_sha256 == h("") and only.verified


# --- worker state and language models ----------------------------------------------------


def test_worker_state_holds_one_object_per_kind():
    assert common.worker_state("test", "a", list) is common.worker_state("test", "a", list)
    first = common.worker_state("test", "a", list)
    assert common.worker_state("test", "b", list) is not first
    assert common.worker_state("test", "a", list) is not first


def test_language_scores_equal_a_direct_sum(spark, monkeypatch):
    """Ties and repeats included; counters handed on early add up to the same model."""
    rows = [(d, t, lang, "s", 1) for d, (t, lang) in enumerate([("the cat sat", "en"), ("le chat noir", "fr"), ("ab", "aa"), ("ab", "bb")] * 4)]
    rows += [(100, "the dog", None, "s", 1), (101, "xq", None, "s", 1), (101, "xq", None, "s", 1), (102, "ab", None, "s", 1), (103, "123", None, "s", 1)]
    docs = documents(spark, rows)
    model = lang_backoff.fit(docs)
    monkeypatch.setattr(lang_backoff, "TASK_WORDS", 1)
    again = lang_backoff.fit(docs)
    assert {g: model.tables[0][r].tolist() for g, r in model.rows[0].items()} == {g: again.tables[0][r].tolist() for g, r in again.rows[0].items()}
    learnt = [(t, lang) for d, t, lang, _, _ in rows if lang and zlib.crc32(str(d).encode()) % 4 != 2]
    langs = sorted({lang for _, lang in learnt})
    counts = [{} for _ in range(5)]
    for t, lang in learnt:
        for w in t.split():
            for n in range(5):
                for g in [w] if n == 0 else [f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n)]:
                    counts[n].setdefault(g, dict.fromkeys(langs, 0))[lang] += 1

    def logs(n, g):
        return [math.log((counts[n][g][x] + 0.5) / (sum(c[x] for c in counts[n].values()) + 0.5 * len(counts[n]))) for x in langs]

    for r in lang_backoff.predict(docs, model).collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        words = [w for w in text.split() if w.isalpha()]
        total = np.zeros(len(langs))
        for w in words:
            if w in counts[0]:
                total += logs(0, w)
                continue
            for n in range(4, 0, -1):
                seen = [logs(n, g) for g in (f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n)) if g in counts[n]]
                if seen:
                    total += np.mean(seen, axis=0)
                    break
        best = int(np.argmax(total)) if words else None
        assert r.lang_pred == ("und" if best is None else langs[best])
        assert abs(r.score - (0 if best is None else np.exp(total[best] - total.max()) / np.exp(total - total.max()).sum())) < 1e-5
