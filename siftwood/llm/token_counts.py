"""Token counts by rank-synchronous merging over ragged numpy arrays.

The distinct pre-tokens of a batch stand one behind another in a single array of
symbol ids. Each round finds, for every sequence at once, the lowest rank among
its adjacent pairs (a segmented minimum), merges all occurrences of that pair
from left to right without overlap, and takes sequences without a known pair out.
What is left of a sequence is its token count. The ranks of a merge's results lie
above its own rank, so merging all occurrences at once equals merging one by one.

Results: null text is empty: 0 bytes, 0 tokens; texts of any length are counted
whole; repeated rows get equal results; an empty table gives an empty table;
columns that clash with result names are replaced, all others are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_files import LONG_PIECE, BpeFile, pieces, slices
from .common import Memo, small_batches, table, without, worker_state

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
NO_RANK = np.iinfo(np.int64).max
#: Symbols held at once.
CHUNK = 1_000_000


class RankMerger:
    def __init__(self, file: BpeFile):
        ids, size = dict(file.vocab), len(file.vocab)
        self.symbol = np.full(0x200, -1, np.int64)
        for c in file.to_byte:
            self.symbol[ord(c)] = ids[c]
        self.size = max(ids.values(), default=size) + 1
        keys = np.array([ids[u] * self.size + ids[v] for u, v in file.merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.first = np.full((self.size_base(file) + 1,) * 2, NO_RANK)
        for k, (u, v) in enumerate(file.merges):
            if ids[u] < len(self.first) and ids[v] < len(self.first):
                self.first[ids[u], ids[v]] = min(k, self.first[ids[u], ids[v]])
        self.result = np.array([ids[u + v] for u, v in file.merges], np.int64)

    @staticmethod
    def size_base(file: BpeFile) -> int:
        """The largest id of a single byte."""
        return max(file.vocab[c] for c in file.to_byte)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word (in the file's alphabet, none empty)."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-16-le"), "<u2")]
        seq = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(sym), NO_RANK)
        same = seq[:-1] == seq[1:]
        rank[:-1][same] = self.first[sym[:-1][same], sym[1:][same]]
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.r_[starts, len(sym)])
            done = least == NO_RANK
            out[seq[starts[done]]] = spans[done]
            at = np.flatnonzero((rank == np.repeat(least, spans)) & (rank != NO_RANK))
            if not len(at):
                break
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # runs as of a pair (a, a): every second one counts
            inside = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[inside % 2 == 0]
            sym[at] = self.result[rank[at]]
            keep = np.repeat(~done, spans)
            keep[at + 1] = False
            now = (np.cumsum(keep) - 1)[at]  # where the merged symbols stand afterwards
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            beside = np.zeros(len(sym), bool)  # only pairs beside a merged symbol have another rank
            beside[now] = True
            beside[now[now > 0] - 1] = True
            new = np.flatnonzero(beside)
            rank[new] = NO_RANK
            new = new[new < len(sym) - 1]
            new = new[seq[new] == seq[new + 1]]
            rank[new] = self.rank(sym[new], sym[new + 1])
        return out


class Counter:
    def __init__(self, path: str):
        self.file = BpeFile(path)
        self.merger = RankMerger(self.file)
        self.memo = Memo()

    def fill(self, new: list[str]) -> dict[str, int]:
        """Counts of pieces: their distinct pre-tokens are merged together."""
        parts = [self.file.words(p) for p in new]
        distinct = list({w: None for ws in parts for w in ws if isinstance(w, str)})
        n: dict[str, int] = {}
        at = 0
        while at < len(distinct):
            held, end = 0, at
            while end < len(distinct) and (held == 0 or held + len(distinct[end]) <= CHUNK):
                held += len(distinct[end])
                end += 1
            n.update(zip(distinct[at:end], self.merger.counts(distinct[at:end]).tolist(), strict=True))
            at = end
        return {p: sum(1 if isinstance(w, int) else n[w] for w in ws) for p, ws in zip(new, parts, strict=True)}

    def counts(self, texts: list[str]) -> list[int]:
        cut = [pieces(t) for t in texts]
        memo = self.memo
        known = {p: memo[p] for ps in cut for p in ps}
        known |= (now := self.fill([p for p, k in known.items() if k is None]))
        for p, k in now.items():
            if len(p) <= LONG_PIECE:
                memo.keep(p, k, 2 * len(p))
        return [sum([known[p] for p in ps]) for ps in cut]


def counter(path: str) -> Counter:
    return worker_state(("counter", path), lambda: Counter(path))


def count_column(text: Column, vocabulary: str = VOCABULARY) -> Column:
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else None

    @F.arrow_udf("long")
    def run(texts):
        import pyarrow as pa

        c = counter(path or public_tokenizers.path(vocabulary))
        return pa.array([n for part in slices(texts) for n in c.counts(part)], pa.int64())

    return run(text)


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    t = F.col(f"`{text}`")
    return (
        without(small_batches(docs), *[n for n in ("n_bytes", "n_tokens", "over_limit") if n != text.lower()])
        .withColumn("n_bytes", F.coalesce(F.octet_length(t), F.lit(0)).cast("long"))
        .withColumn("n_tokens", count_column(t, vocabulary))
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op10_token_counts": op10}
