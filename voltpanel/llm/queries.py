"""Named queries of this subpackage over the test tables, and their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpanel.llm import (
    decontaminate,
    hard_negatives,
    html_density,
    lang_backoff,
    merkle_manifest,
    packing,
    quality_ledger,
    secret_ledger,
    simhash_gray,
    substring_dedup,
    token_arrow,
    token_counts,
    toxicity_gru,
)
from voltpanel.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality_rules(spark, sf_dir):
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    bits = F.col("failure_bits")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_ledger.accepted(bits, quality_ledger.BASE)).alias("base_failed"),
        quality_ledger.accepted(bits, quality_ledger.STANDARD).alias("kept"),
        "failure_bits",
    )


_QUALITY_ROWS = r"""
w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c >= 2),
n AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper
  FROM w JOIN l USING (rid) LEFT JOIN n USING (rid)),
q AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 7 * word_chars)::INT
    + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
    + 32 * (word_chars > 20 * n_words)::INT + 64 * (2 * n_upper > word_chars)::INT)::BIGINT AS failure_bits
  FROM m)
"""
ORACLES["op1_quality_rules"] = f"""WITH {_QUALITY_ROWS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed,
  failure_bits = 0 AS kept, failure_bits FROM q"""


@query
def quality_ablations(spark, sf_dir):
    """What each rule of each policy version rejects, and what it alone rejects."""
    return quality_ledger.ablations(quality_ledger.ledger(table(spark, sf_dir, "documents")))


ORACLES["quality_ablations"] = f"""WITH {_QUALITY_ROWS},
policies AS (SELECT * FROM (VALUES ('base', 1, 3), ('standard', 1, 127)) AS p(policy, version, mask)),
rules AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16),
  ('long_words', 32), ('shouting', 64)) AS r(rule, bit))
SELECT policy, version, rule, sum((failure_bits & mask = 0)::INT)::BIGINT AS n_accepted,
  sum((failure_bits & bit <> 0)::INT)::BIGINT AS n_failing, sum((failure_bits & mask = bit)::INT)::BIGINT AS n_failing_alone
FROM q JOIN policies ON true JOIN rules ON mask & bit <> 0 GROUP BY policy, version, rule"""


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_secret_scans(spark, sf_dir):
    rows, _ = secret_ledger.findings(table(spark, sf_dir, "documents"))
    return secret_ledger.digest(rows)


def _secret_matches() -> str:
    parts = []
    for place, rule in enumerate(secret_ledger.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {place} AS place, '{rule.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, gaps, m, c, {rule.least} AS least FROM ("
            f"SELECT rid, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS m,"
            f" regexp_extract_all(text, '{pattern}', {rule.group}) AS c FROM d)"
        )
    return " UNION ALL ".join(parts)


ORACLES["op3_secret_scans"] = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({_secret_matches()}),
y AS (SELECT rid, place, kind, least, length(m[i]) AS size, length(c[i]) AS counted,
  sum(length(gaps[i]) + length(m[i])) OVER (PARTITION BY rid, place ORDER BY i) AS stop FROM x),
s AS (SELECT rid, place, kind, (stop - size)::BIGINT AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span
  FROM y WHERE counted >= least),
a AS (SELECT rid, sum((kind = 'assign')::INT) AS n_assign, sum((kind = 'access')::INT) AS n_access, sum((kind = 'hex')::INT) AS n_hex,
  string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


@query
def op4_main_text(spark, sf_dir):
    return html_density.main_texts(table(spark, sf_dir, "pages"))


@query
def op5_token_files(spark, sf_dir):
    return token_arrow.token_files(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lang_backoff.predict(docs, lang_backoff.fit(docs))


@query
def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op9_simhash_near_dedup(spark, sf_dir):
    return simhash_gray.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity_gru.score(docs, toxicity_gru.fit(docs, table(spark, sf_dir, "labels")))


@query
def op11_substring_dedup(spark, sf_dir):
    rows = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_substring_dedup"] = r"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT rid, doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
r AS (SELECT rid, i FROM w JOIN f USING (h) WHERE doc_id > first),
p AS (SELECT rid, i, words[i] AS word FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
c AS (SELECT p.rid, p.i, word, coalesce(max((r.i IS NOT NULL)::INT) OVER (PARTITION BY p.rid ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM p LEFT JOIN r ON p.rid = r.rid AND p.i = r.i),
a AS (SELECT rid, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (rid)"""


@query
def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLES["op12_hard_negatives"] = """WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.v) = len(b.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.arid, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.arid, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.arid = s.arid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


@query
def op13_merkle_manifest(spark, sf_dir):
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = """WITH RECURSIVE b AS (
  SELECT row_number() OVER () AS rid, *, coalesce('=' || lang, '') AS tree,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes FROM documents),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: list_reduce(
    list_prepend(xor(c, x), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)),
    4294967295::BIGINT) % 7 = 0 AND n_chars IS NOT NULL AS hit FROM b),
h AS (SELECT rid, doc_id, tree, hit,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS told,
    strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) AS changed,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM k),
l AS (SELECT rid, doc_id, tree, leaf, tampered, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS n
  FROM (SELECT *, sha256(head || told || tail) AS leaf, CASE WHEN hit THEN sha256(head || changed || tail) END AS tampered FROM h)),
up AS (SELECT tree, 0 AS lvl, place, n, leaf AS node FROM l
  UNION ALL SELECT tree, lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
  FROM up WHERE n > 1 GROUP BY tree, lvl, place // 2, n),
t AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, lvl AS height FROM up WHERE n = 1),
crown AS (SELECT 0 AS lvl, place, n, node FROM t
  UNION ALL SELECT lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM crown WHERE n > 1 GROUP BY lvl, place // 2, n),
g AS (SELECT node AS root, lvl AS height FROM crown WHERE n = 1),
steps AS (
  SELECT l.rid, s.lvl, u.node, u.place < l.place >> s.lvl AS leftward
  FROM l JOIN t USING (tree) JOIN (SELECT unnest(range(64)) AS lvl) s ON s.lvl < t.height
  LEFT JOIN up u ON u.tree = l.tree AND u.lvl = s.lvl AND u.place = xor(l.place >> s.lvl, 1)
  UNION ALL
  SELECT l.rid, t.height + s.lvl, u.node, u.place < t.place >> s.lvl
  FROM l JOIN t USING (tree) JOIN g ON true JOIN (SELECT unnest(range(64)) AS lvl) s ON s.lvl < g.height
  LEFT JOIN crown u ON u.lvl = s.lvl AND u.place = xor(t.place >> s.lvl, 1)),
fold AS (SELECT rid, 0 AS lvl, coalesce(tampered, leaf) AS node FROM l
  UNION ALL SELECT f.rid, f.lvl + 1, sha256(CASE WHEN s.node IS NULL THEN f.node WHEN s.leftward THEN s.node || f.node ELSE f.node || s.node END)
  FROM fold f JOIN steps s USING (rid, lvl)),
p AS (SELECT rid, sha256(coalesce(string_agg(node, '' ORDER BY lvl), '')) AS proof_sha256 FROM l LEFT JOIN steps USING (rid) GROUP BY rid),
z AS (SELECT rid, arg_max(node, lvl) AS folded_root FROM fold GROUP BY rid)
SELECT doc_id, leaf, t.node AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN t USING (tree) JOIN g ON true JOIN p USING (rid) JOIN z USING (rid)"""
