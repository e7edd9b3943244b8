"""Secret scanning with an incremental blob ledger, in DataFrame functions only.

Every version of every text is addressed by its content (SHA-256). A ledger remembers which
blobs were scanned under which version of the rules; only unseen pairs are scanned, each
blob once however many paths hold it, and findings are joined back to all paths.

Defined results: a null text counts as empty and has no findings; null ids and repeated
rows keep their rows; an empty table gives no rows; other columns are ignored by ``paths``
and kept by ``redacted``. Texts of any length are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltpanel.llm.common import fresh
from voltpanel.session import materialised

RULES_VERSION = 1


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which spans with equal starts are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 and more are the same matches as all runs with the short ones dropped.
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")
KINDS = tuple(rule.kind for rule in RULES)
SPANS = "array<struct<start: bigint, place: int, kind: string, end: bigint>>"


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, place: int, rule: Rule) -> Column:
    """Per match its number, the code points before it since the match before, its own and its group's."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    rows = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part")),
        lambda x, i: F.struct(
            F.lit(place).alias("place"),
            i.alias("number"),
            F.char_length(x["gap"]).cast("long").alias("gap"),
            F.char_length(x["whole"]).cast("long").alias("size"),
            F.char_length(x["part"]).alias("counted"),
        ),
    )
    # The text after the last match is a gap without a match.
    rows = F.filter(rows, lambda x: x["size"].isNotNull())
    kind = "array<struct<place: int, number: int, gap: bigint, size: bigint, counted: int>>"
    return F.when(text.rlike(rule.pattern), rows).otherwise(F.array().cast(kind))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans (sorted) for the blobs with findings; ``blobs`` has blob and text.

    Positions are running sums of gaps and matches, one row per match, so a text with very
    many matches needs no long array work.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[_matches(text, place, rule) for place, rule in enumerate(rules)])
    rows = blobs.select("blob", F.inline(found))
    # A blob that came in twice (rows with equal id and text) gives its matches once.
    rows = rows.groupBy("blob", "place", "number").agg(*[F.max(c).alias(c) for c in ("gap", "size", "counted")])
    order = Window.partitionBy("blob", "place").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    rows = rows.select("blob", "place", "counted", (end - F.col("size")).alias("start"), end.alias("end"))
    least = F.element_at(F.array(*[F.lit(rule.least) for rule in rules]), F.col("place") + 1)
    kind = F.element_at(F.array(*[F.lit(rule.kind) for rule in rules]), F.col("place") + 1)
    rows = rows.filter(F.col("counted") >= least).withColumn("kind", kind)
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("spans"))


def addresses(docs: DataFrame) -> DataFrame:
    """doc_id and blob: which content each path holds."""
    return docs.select("doc_id", blob(F.col("text")).alias("blob"))


def update(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: int = RULES_VERSION) -> DataFrame:
    """New ledger rows (blob, rules_version, spans) for the blobs not yet scanned under ``version``.

    One path stands for each unseen blob; only narrow addresses are compared, and the texts
    are dealt by blob and path, so a blob that many paths share is no hot key.
    """
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("_id"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rules_version") == version).select("blob").distinct(), "blob", "left_anti")
    texts = docs.select(F.col("doc_id").alias("_doc"), "text", blob(F.col("text")).alias("_blob"))
    chosen = texts.join(
        unseen.hint("shuffle_hash"), (F.col("_blob") == F.col("blob")) & F.col("_doc").eqNullSafe(F.col("_id"))
    ).select("blob", "text")
    found = scan(chosen, rules)
    rows = unseen.select("blob").join(found, "blob", "left")
    return rows.select("blob", F.lit(version).alias("rules_version"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, spans) for every path, and the ledger with the new rows added."""
    paths = materialised(addresses(docs), "addresses")
    new = materialised(update(docs, paths, ledger), "ledger")
    ledger = new if ledger is None else ledger.unionByName(new)
    # Blobs without findings need no join: they are most of the ledger, and their answer is empty.
    hits = ledger.filter((F.col("rules_version") == RULES_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    joined = paths.join(hits, "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), ledger


def written(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the base spans' SHA-256, and all spans as text."""
    spans = F.col("spans")
    of_kind = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in BASE]
    base = F.filter(spans, lambda s: s["place"] < len(BASE))
    return rows.select(
        "doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans")
    )


def redacted(docs: DataFrame, mark: str = "[redacted]") -> DataFrame:
    """The documents with every span replaced by ``mark`` and n_chars counted anew.

    All rows and columns stay; texts without findings stay as they are.
    """
    _, ledger = findings(docs)
    address, spans = fresh(docs, "address"), fresh(docs, "spans")
    hits = ledger.filter(F.size("spans") > 0).select(F.col("blob").alias(address), F.col("spans").alias(spans))
    rows = docs.withColumn(address, blob(F.col("text"))).join(hits, address, "left")
    text = F.col("text")
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    built = F.aggregate(
        F.col(spans),
        begin,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit(mark)).alias("out"), s["end"].alias("at")),
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.concat(acc["out"], piece(acc["at"], F.char_length(text).cast("long"))),
    )
    rows = rows.withColumn("text", F.when(F.col(spans).isNotNull(), built).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn(
            "n_chars", F.when(F.col(spans).isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


