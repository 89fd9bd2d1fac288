"""Sampled splitters: size-weighted key samples, quantile boundaries, range numbers.

A key is up to three long columns, compared in order. What is collected is a
sample of bounded expected size (per range a few keys) and one row per range.
Overfull ranges are sampled again and subdivided until none is, or MOST_ROUNDS.
exact_cuts() goes on subdividing the ranges in which a cut is to lie, until each
holds no more than LAST records, and puts the cuts between records.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled keys per range; a range of more than OVERFULL times its share is subdivided; rounds of that.
PER_RANGE, OVERFULL, MOST_ROUNDS = 24, 2.0, 4
#: Records of a range whose keys are collected to place a cut, at most (one such range for each cut).
LAST = 2048


def range_column(keys: list[Column], splitters: list[tuple]) -> Column:
    """How many splitters are below the key."""
    first = np.array([s[0] for s in splitters], np.int64)

    @F.arrow_udf("int")
    def run(*columns):
        import pyarrow as pa

        a, *more = (np.asarray(c) for c in columns)
        low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        for i in np.flatnonzero(low != high):  # keys that begin as a splitter does
            low[i] = bisect_left(splitters, (int(a[i]), *[int(m[i]) for m in more]))
        return pa.array(low.astype(np.int32))

    return run(*keys) if splitters else F.lit(0)


def _sample(df: DataFrame, keys: list[str], rate: Column, seed: int) -> list[tuple]:
    """Keys of the rows that a hash draws with that chance, in order."""
    u = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 50)).cast("double") / float(1 << 50)
    return sorted(tuple(r) for r in df.where(u < rate).select(*keys).collect())


def _quantiles(drawn: list[tuple], pieces: int) -> list[tuple]:
    return [drawn[len(drawn) * i // pieces] for i in range(1, pieces)] if len(drawn) > pieces else drawn


def count_ranges(rows: DataFrame, keys: list[str], size: str, splitters: list[tuple]) -> list[tuple[int, int]]:
    """Each range's size and rows."""
    r = range_column([F.col(k) for k in keys], splitters)
    found = {x.r: (x.s, x.n) for x in rows.select(r.alias("r"), size).groupBy("r").agg(F.sum(size).alias("s"), F.count("*").alias("n")).collect()}
    return [found.get(k, (0, 0)) for k in range(len(splitters) + 1)]


def _subdivided(rows: DataFrame, keys: list[str], rate: Column, seed: int, splitters: list[tuple], pieces: dict[int, int]) -> list[tuple]:
    """splitters and more of them in the ranges named by pieces."""
    r = range_column([F.col(k) for k in keys], splitters)
    drawn = _sample(rows.where(r.isin(list(pieces))), keys, rate, seed)
    new = []
    for k, n in pieces.items():
        low = splitters[k - 1] if k else None
        new += _quantiles([x for x in drawn if (low is None or x > low) and (k == len(splitters) or x <= splitters[k])], n)
    return sorted({*splitters, *new})


def choose_splitters(rows: DataFrame, keys: list[str], size: str, n_ranges: int, total: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Boundaries for about n_ranges ranges of equal size, and each range's size and rows. rows: a stored table; keys: long columns without nulls."""
    share = max(total / max(n_ranges, 1), 1.0)
    rate = F.col(size) * F.lit(PER_RANGE / share)
    splitters = sorted(set(_quantiles(_sample(rows, keys, rate, 1), n_ranges)))
    ranges = count_ranges(rows, keys, size, splitters)
    for seed in range(2, 1 + MOST_ROUNDS):
        over = {k: int(s // share) + 1 for k, (s, n) in enumerate(ranges) if s > OVERFULL * share and n > 1}
        more = _subdivided(rows, keys, rate, seed, splitters, over) if over else splitters
        if len(more) == len(splitters):
            break
        splitters = more
        ranges = count_ranges(rows, keys, size, splitters)
    return splitters, ranges


def exact_cuts(rows: DataFrame, keys: list[str], size: str, splitters: list[tuple], ranges: list[tuple[int, int]], total: int, pieces: int) -> list[tuple]:
    """The splitters that cut rows into pieces of equal size: of each cut, the key of the last record whose middle lies before it. Keys are unique."""
    for seed in itertools.count(100):
        at, before, held = {}, 0, []
        for k, (s, n) in enumerate(ranges):
            for i in range(-(-before * pieces // max(total, 1)), (before + s) * pieces // max(total, 1) + 1):
                if 0 < i < pieces and n:
                    at.setdefault(k, []).append(i)
            held.append(before)
            before += s
        wide = {k: ranges[k][1] // (LAST // 4) + 1 for k in at if ranges[k][1] > LAST}
        if not wide:
            break
        rate = F.lit(8.0 * 4 / LAST)  # by rows: ranges of a cut are to have few of them
        splitters = _subdivided(rows, keys, rate, seed, splitters, wide)
        ranges = count_ranges(rows, keys, size, splitters)
    if not at:
        return []
    r = range_column([F.col(k) for k in keys], splitters)
    own: dict[int, list[tuple]] = {k: [] for k in at}
    for x in rows.where(r.isin(list(at))).select(r.alias("r"), *keys, size).collect():  # LAST rows for each cut at most
        own[x[0]].append(tuple(x)[1:])
    cuts = set()
    for k, targets in at.items():
        for i in targets:
            upto, last = held[k], splitters[k - 1] if k else None
            for *key, s in sorted(own[k]):
                if (2 * upto + s) * pieces >= 2 * i * total:
                    break
                upto, last = upto + s, tuple(key)
            cuts.add((i, last))
    best: dict[int, tuple] = {}
    for i, last in cuts:  # a cut between two ranges is met in both
        if last is not None:
            best[i] = max(best.get(i, last), last)
    return [best[i] for i in sorted(best)]
