"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger row keeps the measurements and one
integer whose bit *r* says that rule *r* failed. Policies are versioned bit masks over
that integer: applying another version, or asking what each rule costs, never reads a text
again.

Defined results: a null text counts as empty (no words, every count 0) and fails the word
minimum; repeated rows get equal ledger rows; an empty table gives an empty ledger; other
columns of the input are ignored by ``ledger`` and kept by ``keep_accepted``, whatever
their names. A text of any length is measured whole: repeated windows are found by
sorting, so the work per text is n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpanel.llm.common import SPACES, fresh, words_of

RULES_VERSION = 1
#: name -> condition over the measurements that means failure; the place is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 7 * word_chars",
    "repeated_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "2 * n_upper > word_chars",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


@dataclass(frozen=True)
class Policy:
    """A named version of the rules that reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(RULES))
POLICIES = (BASE, STANDARD)


def _count(text: Column, unwanted: str) -> Column:
    """Code points left once ``unwanted`` is gone."""
    return F.char_length(F.regexp_replace(text, unwanted, "")).cast("long")


def with_ledger(docs: DataFrame, into: str) -> DataFrame:
    """``docs`` with a struct column ``into`` of the measurements and ``failure_bits``."""
    words, lines, keys, alike, starts = (fresh(docs, x) for x in ("words", "lines", "keys", "alike", "starts"))
    text = F.coalesce(F.col("text"), F.lit(""))
    w, k = F.col(words), F.col(keys)
    empty = F.array().cast("array<bigint>")
    # One long per 3-word window: 32 hash bits above the window's 1-based place. Sorted, equal
    # windows are neighbours; windows that only share the hash are told apart further down.
    window_key = lambda i: F.shiftleft(F.hash(w[i - 1], w[i], w[i + 1]).cast("long"), 32).bitwiseOR(i.cast("long"))
    # Neighbours with equal hash bits; both keys of every such couple are candidates.
    same_hash = lambda i: F.shiftright(F.get(k, i - 1).bitwiseXOR(F.get(k, i)), 32) == 0
    couples = F.filter(F.sequence(F.lit(1), F.size(k) - 1), same_hash)
    candidates = F.array_distinct(F.flatten(F.transform(couples, lambda i: F.array(F.get(k, i - 1), F.get(k, i)))))
    # The exact windows of those candidates, again sorted with their places at the end.
    spelled = lambda x: (
        lambda i: F.concat_ws(" ", w[i - 1], w[i], w[i + 1], F.lpad(i.cast("string"), 10, "0"))
    )(x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    front = lambda s: F.substr(s, F.lit(1), F.length(s) - 10)
    a = F.col(alike)
    equal = lambda x, y: F.coalesce(front(x) == front(y), F.lit(False))
    s = F.col(starts)
    frame = docs.withColumns(
        {words: words_of(F.col("text")), lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))}
    )
    frame = frame.withColumn(
        keys,
        F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), window_key))).otherwise(empty),
    )
    frame = frame.withColumn(
        alike, F.when(F.size(k) >= 2, F.sort_array(F.transform(candidates, spelled))).otherwise(F.array().cast("array<string>"))
    )
    frame = frame.withColumn(
        starts,
        F.sort_array(
            F.transform(
                F.filter(a, lambda x, i: equal(x, F.get(a, i - 1)) | equal(x, F.get(a, i + 1))),
                lambda x: F.right(x, F.lit(10)).cast("long"),
            )
        ),
    )
    covered = F.aggregate(
        F.transform(s, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(x - F.get(s, i - 1), F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    measures = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.concat_ws("", w)).cast("long"),
        "n_symbols": _count(text, "[^#*$%&|<>]+"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered,
        "n_lines": F.size(lines).cast("long"),
        "n_upper": _count(text, r"\P{Lu}+"),
    }
    frame = frame.withColumn(into, F.struct(*[c.alias(n) for n, c in measures.items()]))
    named = lambda rule: F.expr(_qualified(rule, into))
    bits = sum((F.when(named(rule), F.lit(1 << r)).otherwise(F.lit(0)) for r, rule in enumerate(RULES.values())), F.lit(0))
    whole = F.struct(f"{into}.*", bits.cast("long").alias("failure_bits"))
    # One row in, one row out: the generator keeps filters on the ledger above it. Pushed below,
    # they would write the whole evaluation out again for every rule.
    return frame.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(whole)).alias(into))


def _qualified(rule: str, into: str) -> str:
    return " ".join(f"`{into}`.{part}" if part in MEASURES else part for part in rule.split(" "))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, rules_version, the measurements and failure_bits: one row per document."""
    name = fresh(docs, "ledger")
    rows = with_ledger(docs.select("doc_id", "text"), name)
    return rows.select("doc_id", F.lit(RULES_VERSION).alias("rules_version"), f"{name}.*")


def accepted(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy version and rule: rejected by the rule, and rejected by it alone.

    Ledger rows are first counted per distinct bit pattern (2 ** rules of them at most), so
    the rest of the work is bitwise arithmetic on that bounded table.
    """
    patterns = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    asked = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("policy"),
                F.lit(p.version).alias("version"),
                F.lit(rule).alias("rule"),
                F.lit(p.mask).cast("long").alias("mask"),
                F.lit(1 << list(RULES).index(rule)).cast("long").alias("bit"),
            )
            for p in policies
            for rule in p.rules
        ]
    )
    crossed = patterns.select("failure_bits", "n", F.inline(asked))
    failed = F.col("failure_bits").bitwiseAND(F.col("mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return crossed.groupBy("policy", "version", "rule").agg(
        total(failed == 0).alias("n_accepted"),
        total(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
        total(failed == F.col("bit")).alias("n_failing_alone"),
    )


def keep_accepted(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The documents that the policy accepts, with their own columns only."""
    name = fresh(docs, "ledger")
    rows = with_ledger(docs, name)
    return rows.filter(accepted(F.col(name)["failure_bits"], policy)).select(*[F.col(f"`{c}`") for c in docs.columns])
