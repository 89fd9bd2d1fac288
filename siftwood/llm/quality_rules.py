"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger keeps the measurements and
one failure bit per rule. Policies are named, versioned sets of bits; applying
one, or asking what a rule changes (ablation), is bit arithmetic on the ledger
and never reads a text again.

Words are runs of characters other than ASCII white space. A document's repeated
words are those in 8-word windows that occur twice or more in it; windows are
compared exactly, by numbering words, then pairs, fours and eights of them.

Results: null text has no words (all measures 0, fails too_short); a document of
any length is measured whole; repeated rows get equal results; an empty table
gives an empty table; columns that clash with result names are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, sizes, small_batches, table, without, worker_state

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")

#: Rules in bit order: name and failing condition over the measures, as SQL (of Spark and DuckDB).
RULES = (
    ("too_short", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("shouting", "2 * n_marks > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
)
#: Policies by version: a document is rejected if it fails one of these rules.
POLICIES = {
    "base-1": ("too_short", "repeated_windows"),
    "full-1": tuple(name for name, _ in RULES),
}
POLICY, BASE = "full-1", "base-1"


def mask(policy: str) -> int:
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in 8-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    wide = 1
    while wide < WINDOW:  # ids of windows of twice the width
        _, ids = np.unique(ids[:-wide] * (len(words) + 1) + ids[wide:], return_inverse=True)
        wide *= 2
    counts = np.bincount(ids)
    starts = np.flatnonzero(counts[ids] > 1)
    if not len(starts):
        return 0
    return int(np.minimum(np.diff(starts), WINDOW).sum()) + WINDOW


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    n_words = len(words)
    blanks = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()] if n_words else []
    return (n_words, len(text) - blanks, n_symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), raw.count(b"!"))


def measures_column(text: Column) -> Column:
    """Struct of MEASURES."""

    @F.arrow_udf(", ".join(f"{m} long" for m in MEASURES))
    def run(texts):
        import pyarrow as pa

        worker_state("quality", dict)
        rows = np.array([measure(t) for t in sizes(texts)], np.int64).reshape(-1, len(MEASURES))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(MEASURES))], list(MEASURES))

    return run(text)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures and failed_bits: one bit per rule of RULES."""
    keep = without(small_batches(docs), *[n for n in (*MEASURES, "failed_bits") if n != text.lower()])
    (own,) = fresh(keep, "measures")
    kept = [F.col(f"`{c}`") for c in keep.columns if c.lower() not in (*MEASURES, "failed_bits")]
    out = keep.withColumn(own, measures_column(F.col(f"`{text}`"))).select(*kept, f"`{own}`.*")
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)), F.lit(0))
    return out.withColumn("failed_bits", bits.cast("long"))


def passes(policy: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """A ledger with base_failed and kept."""
    base = passes(BASE)
    return without(rows, "base_failed", "kept").withColumn("base_failed", ~base).withColumn("kept", base & passes(policy))


def ablations(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (kept again without the rule), and that fail any."""
    used = mask(policy)
    failing = F.col("failed_bits").bitwiseAND(F.lit(used))
    patterns = rows.select(failing.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))  # at most 2^rules rows
    parts = [
        F.struct(
            F.lit(name).alias("rule"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, F.col("n")).otherwise(0)).cast("long").alias("n_failed"),
            F.sum(F.when(F.col("bits") == (1 << k), F.col("n")).otherwise(0)).cast("long").alias("n_failed_alone"),
            F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).cast("long").alias("n_rejected"),
        )
        for k, (name, _) in enumerate(RULES)
        if used >> k & 1
    ]
    return patterns.agg(F.array(*parts).alias("r")).select(F.inline("r")).na.fill(0)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_policy(ledger(docs)).drop("text")


_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))

#: Window by window, so for the small tables.
ORACLE = {
    "op5_quality_rules": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d
), p AS (
  SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i, unnest(list_transform(range(len(ws)), lambda i: CASE WHEN i + 8 <= len(ws) THEN list_slice(ws, i + 1, i + 8) END)) AS win FROM w
), q AS (
  SELECT r, i, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM p
), c AS (
  SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM q
), reps AS (
  SELECT r, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY r
), ln AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_marks
  FROM w JOIN ln USING (r) LEFT JOIN reps USING (r)
), b AS (SELECT *, ({_BITS})::BIGINT AS failed_bits FROM m)
SELECT *, failed_bits & {mask(BASE)} <> 0 AS base_failed, failed_bits & {mask(POLICY)} = 0 AS kept FROM b
"""
}

QUERIES = {"op5_quality_rules": op5}
