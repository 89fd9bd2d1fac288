"""Benchmark decontamination by a broadcast hash set of test n-grams (DataFrame operations only).

A word is a run of ASCII digits, ASCII letters (lower-cased) and characters
beyond ASCII. A benchmark item gives its windows of 13 consecutive words; an item
of fewer words is one window. A document word inside any occurrence of a window
is hit.

Scan: each occurrence of a window of L words holds a gram of g = min(5, L) words
that starts at a multiple of L - g + 1. Only these grams of a document are hashed
and looked up in the hash set of all grams of the windows. Documents with such a
gram have all their windows hashed and looked up; those found are verified by
their words, in a join with the benchmark's windows.

The hash sets are part of the tasks' code. They hold what the benchmark gives,
and no more than MOST_GRAMS hashes. With a larger benchmark the same grams of the
documents are looked up by a semi-join, and only texts that hold one have their
windows joined with the benchmark's.

Results: null text has no words and is clean; texts of any length are read whole;
empty items match nothing; equal items all count; repeated rows each get the
result; empty tables give empty tables (an empty benchmark: all clean); other
columns are kept, whatever their names, and those that clash with result names
(spans among them) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, fixed, fresh, stored, table, without

#: A window's words; the least words of a gram in the scan; the most hashes in a task's code.
WINDOW, GRAM, MOST_GRAMS = 13, 5, 50_000
#: Contaminated texts' hashes broadcast at most; more are joined.
MOST_REMOVED = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS_OF_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def rough_words(text: Column) -> Column:
    """As many words, alike for texts whose words() are alike, and cheaper: lower-cased beyond ASCII too."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("Σ"), F.lit("σ")))
    return F.filter(F.split(plain, SEPARATORS_OF_ANY_CASE), lambda w: w != "")


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, len, win (words joined by spaces) and rough (words in rough form)."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w"), rough_words(F.col(text)).alias("rw")).where(F.size("w") > 0)
    rows = rows.withColumn("len", F.least(F.size("w"), F.lit(WINDOW)))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))))
    return rows.select("item", "len", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("win"), F.slice("rw", F.col("at") + 1, F.col("len")).alias("rough")).distinct()


def _starts_sql(w: str, length: int, step: int = 1) -> str:
    return f"CASE WHEN size(`{w}`) >= {length} THEN sequence(0, size(`{w}`) - {length}, {step}) ELSE cast(array() AS array<int>) END"


def _grams_sql(w: str, length: int, step: int) -> str:
    """Hashes of the grams of that many words at 0, step, ..."""
    return f"transform({_starts_sql(w, length, step)}, i -> xxhash64(slice(`{w}`, i + 1, {length})))"


def _occurrences_sql(w: str, length: int) -> str:
    """All windows of that many words: pos, len, win."""
    return f"transform({_starts_sql(w, length)}, i -> named_struct('pos', i, 'len', {length}, 'win', array_join(slice(`{w}`, i + 1, {length}), ' ')))"


def _in_sql(value: str, hashes: list[int]) -> str:
    """One expression for the whole set; Spark makes a hash set of it."""
    return f"{value} IN ({', '.join(f'{h}L' for h in hashes)})" if hashes else "false"


HITS = "array<struct<pos:int,len:int,win:string>>"


def _sampled(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Of each window length: itself, its grams' length, and the step at which documents are sampled for those."""
    return [(n, min(GRAM, n), n - min(GRAM, n) + 1) for n in lengths]


def find_hits(docs: DataFrame, wins: DataFrame, text: str) -> tuple[DataFrame, str, str, bool]:
    """docs without their text, with a row number, n_words and hits (pos, len and win of windows whose hashes are known); the names of row number and hits; whether the benchmark was small enough to broadcast."""
    lengths = sorted(r.len for r in wins.select("len").distinct().collect())  # 1 to 13 at most
    grams = wins.select("len", F.least(F.col("len"), F.lit(GRAM)).alias("g"), "rough").select("len", F.explode(F.transform(F.sequence(F.lit(0), F.col("len") - F.col("g")), lambda i: F.xxhash64(F.slice("rough", i + 1, F.col("g"))))).alias("h")).distinct()
    hashes = wins.select("len", F.xxhash64("win").alias("h")).distinct()
    if max(grams.count(), hashes.count()) > MOST_GRAMS:
        return *_find_by_joins(docs, wins, grams, lengths, text), False
    by_gram: dict[int, list[int]] = {n: [] for n in lengths}
    by_window: dict[int, list[int]] = {n: [] for n in lengths}
    for rows, to in ((grams, by_gram), (hashes, by_window)):
        for r in rows.collect():  # counted above
            to[r.len].append(r.h)
    rid, w, rough, hits = fresh(docs, "rid", "w", "rough", "hits")
    rows = docs.withColumn(rid, F.monotonically_increasing_id()).withColumn(rough, rough_words(F.col(f"`{text}`")))
    near = " OR ".join(f"exists({_grams_sql(rough, g, step)}, h -> {_in_sql('h', by_gram[n])})" for n, g, step in _sampled(lengths)) or "false"
    rows = rows.withColumn("n_words", F.size(rough).cast("long")).withColumn(w, F.when(F.expr(near), words(F.col(f"`{text}`"))))
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in (rough, text)])
    found = [f"filter({_occurrences_sql(w, n)}, x -> {_in_sql('xxhash64(x.win)', by_window[n])})" for n in lengths]
    both = f"CASE WHEN `{w}` IS NULL THEN cast(array() AS {HITS}) ELSE concat({', '.join([f'cast(array() AS {HITS})', *found])}) END"
    return rows.withColumn(hits, F.expr(both)).drop(w), rid, hits, True


def _find_by_joins(docs: DataFrame, wins: DataFrame, grams: DataFrame, lengths: list[int], text: str) -> tuple[DataFrame, str, str]:
    """For a benchmark of any size. Texts go by two hashes; those that share a sampled gram have their windows joined by their words."""
    rid, hits, a, b = fresh(docs, "rid", "hits", "a", "b")
    t = F.col(f"`{text}`")
    marks = [F.xxhash64(t).alias(a), F.xxhash64(F.lit(1), t).alias(b)]
    own = docs.where(t.isNotNull()).select(*marks, rough_words(t).alias("rough"))
    some = None
    for n, g, step in _sampled(lengths):
        x = own.select(a, b, F.lit(n).alias("len"), F.explode(F.expr(_grams_sql("rough", g, step))).alias("h"))
        some = x if some is None else some.unionByName(x)
    near = fixed(some.join(grams, ["len", "h"], "left_semi").select(a, b).distinct())
    texts = docs.where(t.isNotNull()).select(*marks, t.alias("text")).join(near, [a, b], "left_semi").dropDuplicates([a, b]).select(a, b, words(F.col("text")).alias("w"))
    alls = F.expr(f"concat({', '.join(_occurrences_sql('w', n) for n in lengths)})")
    found = texts.select(a, b, F.inline(alls)).join(wins.select("win", "len").distinct(), ["win", "len"], "left_semi").groupBy(a, b).agg(F.collect_list(F.struct("pos", "len", "win")).alias(hits))
    rows = docs.withColumns({rid: F.monotonically_increasing_id(), a: marks[0], b: marks[1], "n_words": F.size(rough_words(t)).cast("long")}).drop(text)
    out = rows.join(fixed(found), [a, b], "left").withColumn(hits, F.coalesce(hits, F.array().cast(HITS)))
    return out.drop(a, b), rid, hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs (without text) with n_words, n_hit, n_items, items_sha256, contaminated and spans: [from, to) of hit words."""
    docs = without(docs, *[n for n in (*RESULTS, "spans") if n != text.lower()])
    wins = fixed(windows(benchmark, item, item_text))
    rows, rid, hits, small = find_hits(docs, wins, text)
    rows = stored(rows, "hits")
    items, at, win, len_, pos = fresh(rows, "items", "at", "win", "len", "pos")
    by_win = wins.groupBy(F.col("win").alias(win), F.col("len").alias(len_)).agg(F.sort_array(F.collect_set("item")).alias(items))
    by_win = F.broadcast(by_win) if small else by_win
    own = rows.where(F.size(hits) > 0).select(rid, F.explode(hits).alias("x")).select(rid, F.col("x.pos").alias(pos), F.col("x.len").alias(len_), F.col("x.win").alias(win)).join(by_win, [win, len_])
    own = own.groupBy(rid).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(items)))).alias(items),
        F.sort_array(F.collect_set(F.struct(F.col(pos).alias("a"), (F.col(pos) + F.col(len_)).alias("b")))).alias(at),
    )
    none = F.array().cast("array<struct<a:int,b:int>>")
    merged = F.aggregate(
        at,
        none,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
    )
    own = own.select(rid, items, merged.alias("spans"))
    out = rows.drop(hits).join(own, rid, "left").withColumn("spans", F.coalesce("spans", none)).withColumn(items, F.coalesce(items, F.array().cast("array<string>")))
    out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["b"] - x["a"]).cast("long"))
    out = out.withColumn("n_items", F.size(items).cast("long")).withColumn("items_sha256", F.sha2(F.array_join(items, ","), 256))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    out = fixed(out.drop(rid, items))
    drop_stored(rows)
    return out


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the contaminated ones."""
    key, size = fresh(docs, "key", "size")
    marks = [F.xxhash64(F.col(f"`{text}`")).alias(key), F.octet_length(F.col(f"`{text}`")).alias(size)]
    found = decontaminate(docs.select(*marks, F.col(f"`{text}`").alias("text")), benchmark)
    found = fixed(found.where("contaminated").select(key, size).distinct())
    found = F.broadcast(found) if found.count() <= MOST_REMOVED else found
    return docs.withColumn(key, marks[0]).withColumn(size, marks[1]).join(found, [key, size], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", *RESULTS)


ORACLE = {
    "op2_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT item, least(len(w), 13) AS n, unnest(list_transform(range(greatest(len(w) - 12, 1)), lambda i: array_to_string(list_slice(w, i + 1, i + least(len(w), 13)), ' '))) AS win FROM b WHERE len(w) > 0
), k AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, n, unnest(range(len(w) - n + 1)) AS i, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(list_slice(w, i + 1, i + n), ' '))) AS win FROM d, k WHERE len(w) >= n
), h AS (
  SELECT r, i, n, item FROM dw JOIN bw USING (n, win)
), c AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN it USING (r)
"""
}

QUERIES = {"op2_decontamination": op2}
