"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct word shingles. Documents link
when 100 * intersection >= PERCENT * union. The steps:

1. Measure: one row per document: set size and digest. Documents of one digest
   have one set and are a single class from here on. The shingles that may come
   into prefixes are counted over all documents, in cells (the first half of their
   hash), and those of the fullest cells are ordered last.
2. Prefixes: under that order linked sets share a shingle in their prefixes (size -
   ceil(t * size) + 1 first ones). Classes with the same prefix and size are one
   group. A prefix shingle that two classes have makes a bucket of groups.
3. Near members of the buckets first: each class goes to the buckets of two of its
   shingles, stands beside those that agree with it further on, and is verified
   against some before it by the whole sets, unless they are connected already.
4. The rest of the join: buckets whose groups are not all connected are split into
   tiles; in a tile, group pairs whose sizes and components allow a link are
   expanded to their members, member pairs are filtered by an exact bound on the
   intersection from bitmaps, and what passes is verified by the whole sets. Every
   pair of classes with a shared prefix shingle is connected by step 3 or gets
   here, so no link between components is lost.
5. Components of the links, and the least doc_id of each.

Broadcast are at most FREQUENT cells, MOST_WANTED row keys (more are joined) and
one row for each key that holds TOGETHER classes or more.

Results: null text and text without words have an empty set and link with
nothing; fewer words than a shingle are one shingle; texts of any length are read
whole; null doc_ids don't count for component_id (null only where no row of the
component has one); repeated rows are copies; an empty table gives an empty table.
jaccard_components returns its own columns alone; keep_one keeps all columns,
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, fixed, fresh, small_batches, stored, table, worker_state
from .components import components
from .shingles import digest, shingles

WORDS, PERCENT = 4, 85
#: Cells ordered last at most, and the count from which one is; rows' keys broadcast at most.
FREQUENT, FREQUENT_FROM, MOST_WANTED = 200_000, 16, 200_000
#: Classes that the next one is compared with in step 3; classes of one key in a task at most, about; groups of a bucket in a tile, about.
NEIGHBOURS, TOGETHER, TILE = 48, 20_000, 768
#: Hashes whose cells a task counts at once; digests that a task knows again.
COUNTED, KNOWN = 1_000_000, 100_000
#: 64-bit words of a bitmap; rows of a tile that need no arrays.
BITS, FEW = 8, 12
LOWEST = -(1 << 63)


def required(a, b, percent: int = PERCENT):
    """The least intersection with which sets of these sizes link: 100 i >= p (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    need = required(len(a), len(b), percent)
    if min(len(a), len(b)) < need:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= need


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITS words; a bit says whether an odd number of hashes fall on it. Two sets differ in as many hashes as their bitmaps in bits, at least."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (64 * BITS - 1), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def bitmaps_allow(a: np.ndarray, others: np.ndarray, n: int, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether a set of size n with bitmap a may link with those of sizes m and bitmaps others."""
    return np.bitwise_count(others ^ a).sum(axis=1, dtype=np.int64) <= n + m - 2 * required(n, m, percent)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


class _Known:
    """Digests met in a task, as far as remembered: copies that follow need no more work."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def new(self, d: bytes) -> bool:
        if d in self.seen:
            return False
        if len(self.seen) > KNOWN:
            self.seen.clear()
        self.seen.add(d)
        return True


MEASURED = "range int, counts binary, doc_id long, th long, n long, digest binary"


def _measure(width: int, percent: int):
    """Rows with a range hold counts of its cells: as many cells and counts, four bytes each; the others are documents."""

    def run(batches):
        import pyarrow as pa

        worker_state("jaccard", dict)
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in MEASURED.split(", ")]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

        def counted():
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            parts = cells >> np.uint32(20)
            at = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
            blobs = [cells[i:j].tobytes() + n[i:j].astype("<u4").tobytes() for i, j in zip(at, np.r_[at[1:], len(cells)], strict=True)]
            k = len(blobs)
            return batch([parts[at].astype(np.int32), blobs, *[[None] * k] * 4])

        held, size, known = [], 0, _Known()
        for b in batches:
            n, digests = [], []
            for t in b.column("text"):
                h = shingles(t.as_py(), width)
                d = digest(h)
                n.append(len(h))
                digests.append(d)
                if len(h) and known.new(d):
                    first = _cells(h[: 2 * prefix_length(len(h), percent)])
                    held.append(first)
                    size += len(first)
                    if size > COUNTED:
                        yield counted()
                        held, size = [], 0
            k = len(n)
            yield batch([[None] * k, [None] * k, b.column("doc_id"), b.column("th"), n, digests])
        if held:
            yield counted()

    return run


def _sum_cells(batches):
    """Of counts sorted by range: cells with FREQUENT_FROM or more. A range's counts take a fixed array."""
    import pyarrow as pa

    worker_state("jaccard", dict)
    now, total = None, None

    def full():
        at = np.flatnonzero(total >= FREQUENT_FROM)
        return pa.RecordBatch.from_arrays([pa.array(at + (now << 20), pa.int64()), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    for b in batches:
        for r, blob in zip(b.column("range").to_pylist(), b.column("counts"), strict=True):
            if r != now:
                if now is not None:
                    yield full()
                now, total = r, np.zeros(1 << 20, np.int64)
            x = np.frombuffer(blob.as_py(), "<u4")
            cells, n = np.split(x, 2)
            total[cells & np.uint32((1 << 20) - 1)] += n
    if now is not None:
        yield full()


PREFIXES = "dk long, th long, digest binary, n int, gid long, bits binary, prefix array<long>"


def _prefixes(frequent: list[tuple[int, int]], width: int, percent: int):
    """Per class (at least once): its row's key, size, group, bitmap and prefix, under the order: rare shingles by hash, then those of frequent cells by count."""
    late = np.array([c for c, _ in frequent], np.uint32)
    late_counts = np.array([n for _, n in frequent], np.int64)

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as number

        worker_state("jaccard", dict)
        known = _Known()
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for t, dk, th in zip(b.column("text"), b.column("dk").to_pylist(), b.column("th").to_pylist(), strict=True):
                h = shingles(t.as_py(), width)
                d = digest(h)
                if not len(h) or not known.new(d):
                    continue
                k = prefix_length(len(h), percent)
                own = h[:k]
                if len(late):
                    cells = _cells(h)
                    at = np.minimum(np.searchsorted(late, cells), len(late) - 1)
                    is_late = late[at] == cells
                    own = h[~is_late][:k]
                    if len(own) < k:
                        rest, counts = h[is_late], late_counts[at[is_late]]
                        own = np.r_[own, rest[np.lexsort((rest, counts))][: k - len(own)]]
                gid = number(own.tobytes(), len(h))
                for to, x in zip(rows, (dk, th, d, len(h), gid - (gid >> 63 << 64), bitmap(h).tobytes(), _signed(own)), strict=True):
                    to.append(x)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in PREFIXES.split(", ")])

    return run


def _shared(batches):
    """Of rows (tok, split, gid, half a digest, n, pos) sorted so: each group of the shingles that two classes have. split: null, or the part of a very frequent shingle, of which all groups are given out."""
    import pyarrow as pa

    worker_state("jaccard", dict)
    now, first, said = None, None, None  # the bucket; its first class, while it is the only one; the last group given out
    for b in batches:
        rows = []
        for t, split, g, d, n, pos in zip(*[b.column(k).to_pylist() for k in range(6)], strict=True):
            if (t, split) != now:
                now, first, said = (t, split), None if split is not None else (g, d, n, pos), None
                if split is None:
                    continue
            if first is not None:
                if first[:2] == (g, d):
                    continue
                rows.append((t, first[0], first[2], first[3]))
                said, first = first[0], None
            if g != said:
                rows.append((t, g, n, pos))
                said = g
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["tok", "gid", "n", "pos"])


def _buckets(prefixes: DataFrame, frequent: list[tuple[int, int]]) -> DataFrame:
    """tok, gid, n, pos: the groups of each shingle that two classes have in their prefixes, and its place there."""
    half = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    parts = prefixes.select(F.posexplode("prefix").alias("pos", "tok"), "gid", "n", half.alias("half"))
    many = [(c, -(-n // TOGETHER)) for c, n in frequent if n >= TOGETHER]
    if many:
        hot = F.broadcast(prefixes.sparkSession.createDataFrame(many, "cell long, parts long"))  # FREQUENT rows at most
        parts = parts.join(hot, F.shiftrightunsigned("tok", 32) == F.col("cell"), "left").withColumn("split", F.pmod(F.xxhash64("gid"), F.col("parts")))
    else:
        parts = parts.withColumn("split", F.lit(None).cast("long"))
    parts = parts.select("tok", "split", "gid", "half", "n", "pos").repartition("tok", "split").sortWithinPartitions("tok", "split", "gid", "half")
    return parts.mapInArrow(_shared, "tok long, gid long, n long, pos long")


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (checkpointed; dk, th and more) with the texts of its rows."""
    small = wanted.count() <= MOST_WANTED
    return rows.join(F.broadcast(wanted) if small else wanted, ["dk", "th"])


def _salts(rows: DataFrame, key: str) -> DataFrame:
    """rows with salt: keys of TOGETHER rows or more are split. One row per such key is broadcast."""
    many = rows.groupBy(key).agg(F.count("*").alias("many")).where(F.col("many") >= TOGETHER)
    out = rows.join(F.broadcast(many), key, "left")
    return out.withColumn("salt", F.when(F.col("many").isNotNull(), F.pmod(F.xxhash64("digest"), F.ceil(F.col("many") / TOGETHER))).otherwise(F.lit(0)).cast("long")).drop("many")


def _compare(width: int, percent: int):
    """Of rows (key, salt, digest, n, bits, text) sorted by key and likeness: links u, v.

    Of a key are held: digest, hashes, label, links found, size, bitmap. Those of one label are linked already. What has
    linked most stays longest: of a group of near copies, the ones with the fewest edits link with nearly all others."""

    def run(batches):
        import pyarrow as pa

        worker_state("jaccard", dict)
        held: list[list] = []
        last, labels = None, 0
        for b in batches:
            out = []
            for key, salt, d, n, raw, t in zip(*[b.column(k).to_pylist() for k in range(5)], b.column(5), strict=True):
                if last != (key, salt):
                    held, last = [], (key, salt)
                if held and held[-1][0] == d:
                    continue
                h, own, hits, bits = None, -1, 0, int.from_bytes(raw, "little")
                for x in sorted(held, key=lambda x: -x[3]):
                    need = required(n, x[4], percent)
                    if x[2] == own or min(n, x[4]) < need or (x[5] ^ bits).bit_count() > n + x[4] - 2 * need:
                        continue
                    h = shingles(t.as_py(), width) if h is None else h
                    if not isinstance(x[1], np.ndarray):
                        x[1] = shingles(x[1], width)
                    if not links(h, x[1], percent):
                        continue
                    out.append((d, x[0]))
                    x[3] += 1
                    hits += 1
                    if own < 0:
                        own = x[2]
                    else:
                        old = x[2]
                        for y in held:
                            y[2] = own if y[2] == old else y[2]
                labels += 1
                held.append([d, t.as_py() if h is None else h, labels if own < 0 else own, hits, n, bits])
                if len(held) > NEIGHBOURS:
                    held.pop(min(range(max(1, NEIGHBOURS // 2)), key=lambda i: (held[i][3], i)))
            u, v = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return run


def _near(rows: DataFrame, members: DataFrame, shared: DataFrame, width: int, percent: int) -> DataFrame:
    """Links u, v between members that meet in the buckets of two of their shingles."""
    # The first shingle that two sets of like sizes share stands in the first part of a prefix.
    keys = shared.where(f"(n - pos) * {100 + percent} div {percent} - n >= n").groupBy("gid").agg(F.min("tok").alias("k1"), F.min_by("tok", F.xxhash64("tok")).alias("k2"))
    wanted = fixed(members.join(keys, "gid").select("dk", "th", "digest", "n", "bits", "k1", "k2"))
    texts = stored(_texts_of(rows, wanted).select("digest", "n", "bits", "k1", "k2", "text"), "near")
    found = None
    for key, other in (("k1", "k2"), ("k2", "k1")):
        x = _salts(texts, key).repartition(key, "salt").sortWithinPartitions(key, "salt", other, "n", "digest")
        x = x.select(key, "salt", "digest", "n", "bits", "text").mapInArrow(_compare(width, percent), "u binary, v binary")
        found = x if found is None else found.unionByName(x)
    found = fixed(found.distinct())
    drop_stored(texts)
    return found


def _most(n, pos, percent: int):
    """The size up to which a set may link with one of size n or more, if the first shingle that they share is number pos of its prefix; less than n if none may."""
    return (n - pos) * (100 + percent) // percent - n


def tile_pairs(side: np.ndarray, gid: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: np.ndarray, cross: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of members (rows sorted by n and gid) that may link and aren't connected. cross: only those of different sides.

    A group is held against groups of fitting sizes and places of the shingle, unless all are one component; members are filtered by bitmaps."""
    starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
    ends = np.r_[starts[1:], len(gid)]
    size, most = n[starts], _most(n[starts], pos[starts], percent)
    stops = np.searchsorted(n, np.minimum(most, size * 100 // percent), "right")
    changes = np.r_[0, np.cumsum(comp[1:] != comp[:-1])]
    use = (most >= size) & (changes[np.maximum(stops - 1, 0)] != changes[starts])
    out = []
    for start, end, stop in zip(starts[use].tolist(), ends[use].tolist(), stops[use].tolist(), strict=True):
        fits = n[start:stop] - pos[start:stop] >= required(int(n[start]), n[start:stop], percent)
        for i in range(start, end):
            j = (comp[i + 1 : stop] != comp[i]) & fits[i + 1 - start :]
            j = np.flatnonzero(j & (side[i + 1 : stop] != side[i]) if cross else j) + i + 1
            if len(j):
                out += [(i, x) for x in j[bitmaps_allow(bits[i], bits[j], int(n[i]), n[j], percent)].tolist()]
    return out


def _tiles(percent: int):
    """Of rows (tok, a, b, side, gid, comp, n, pos, digest, bits) sorted by tok, a, b, n and gid: pairs u, v to verify. a is negative in tiles whose pairs need not be of two sides."""

    def run(batches):
        import pyarrow as pa

        worker_state("jaccard", dict)
        said: set[tuple[bytes, bytes]] = set()
        now: tuple | None = None
        held: list[tuple] = []

        def pairs():
            nonlocal said
            found: set[tuple[bytes, bytes]] = set()
            if len(held) <= FEW:  # as tile_pairs() does
                for i, x in enumerate(held):
                    most = min(_most(x[3], x[4], percent), x[3] * 100 // percent)
                    for y in held[i + 1 :]:
                        if y[3] > most:
                            break
                        if x[2] != y[2] and (now[1] < 0 or x[0] != y[0]) and y[3] - y[4] >= (need := required(x[3], y[3], percent)):
                            if (int.from_bytes(x[6], "little") ^ int.from_bytes(y[6], "little")).bit_count() <= x[3] + y[3] - 2 * need:
                                found.add((min(x[5], y[5]), max(x[5], y[5])))
                found -= said
                said |= found
            elif len({r[2] for r in held}) > 1:
                side, gid, comp, n, pos = (np.array([r[k] for r in held], np.int64) for k in range(5))
                bits = np.frombuffer(b"".join(r[6] for r in held), "<u8").reshape(-1, BITS)
                both = [(held[i][5], held[j][5]) for i, j in tile_pairs(side, gid, comp, n, pos, bits, now[1] >= 0, percent)]
                found = {(min(x), max(x)) for x in both} - said
                said = found if len(said) > KNOWN else said | found
            u, v = zip(*sorted(found), strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for tok, a, c, *row in zip(*columns, strict=True):
                if (tok, a, c) != now:
                    if held:
                        yield pairs()
                    now, held = (tok, a, c), []
                held.append(tuple(row))
        if held:
            yield pairs()

    return run


def _rest(shared: DataFrame, members: DataFrame, early: DataFrame, percent: int) -> DataFrame:
    """Pairs u, v of digests in one bucket but not yet connected that may link.

    The largest component of a bucket needs no pairs within: its rows are dealt to tiles once for each part of the others,
    and the others once for each of its parts; besides, the others are tiled among themselves."""
    comp = F.xxhash64(F.coalesce("root", "digest"))  # stands for the component
    own = members.join(early.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "gid", "n", "bits", comp.alias("comp"))
    own = stored(own, "members")
    sizes = own.groupBy("gid", "comp").agg(F.count("*").alias("k"))
    small = F.expr(f"(n - pos) * {100 + percent} div {percent} - n >= n")  # may be the smaller set of a pair in this bucket
    in_bucket = shared.join(sizes, "gid").groupBy("tok", "comp").agg(F.sum("k").alias("k"), F.max(small).alias("small"))
    buckets = in_bucket.groupBy("tok").agg(F.max("small").alias("small"), F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("k_main"), F.sum("k").alias("k")).where("k > k_main and small")
    parts = lambda k: F.ceil(k / TILE).cast("int")
    buckets = fixed(buckets.select("tok", "main", parts(F.col("k_main")).alias("main_parts"), parts(F.col("k") - F.col("k_main")).alias("other_parts")))
    alive = fixed(shared.join(buckets, "tok"))
    rows = alive.join(own.drop("n"), "gid").withColumn("is_main", F.col("comp") == F.col("main")).withColumn("h", F.xxhash64("digest"))
    main_part, other_part = F.pmod("h", "main_parts").cast("int"), F.pmod("h", "other_parts").cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"))
    with_others = F.transform(each("other_parts"), lambda b: tile(main_part, b, F.lit(0)))
    with_main = F.transform(each("main_parts"), lambda a: tile(a, other_part, F.lit(1)))
    among = F.transform(each("other_parts"), lambda x: tile(-1 - F.least(other_part, x), F.greatest(other_part, x), other_part))
    rows = rows.withColumn("x", F.explode(F.when(F.col("is_main"), with_others).otherwise(F.concat(with_main, among))))
    rows = rows.select("tok", "x.a", "x.b", "x.side", "gid", "comp", "n", "pos", "digest", "bits")
    rows = rows.repartition("tok", "a", "b").sortWithinPartitions("tok", "a", "b", "n", "gid", "digest")
    pairs = fixed(rows.mapInArrow(_tiles(percent), "u binary, v binary").distinct())
    drop_stored(own)
    return pairs


def _verify(pairs: DataFrame, members: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs of digests u, v whose sets link."""
    wanted = pairs.select(F.col("u").alias("digest")).unionByName(pairs.select(F.col("v").alias("digest"))).distinct()
    wanted = fixed(members.select("digest", "dk", "th").join(wanted, "digest", "left_semi"))

    @F.arrow_udf("binary")
    def sets(texts):
        import pyarrow as pa

        return pa.array([shingles(t.as_py(), width).tobytes() for t in texts], pa.binary())

    own = stored(_texts_of(rows, wanted).select("digest", sets("text").alias("hashes")).dropDuplicates(["digest"]), "sets")

    @F.arrow_udf("boolean")
    def linked(a, b):
        import pyarrow as pa

        return pa.array([links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(a, b, strict=True)], pa.bool_())

    both = pairs.join(own.select(F.col("digest").alias("u"), F.col("hashes").alias("ha")), "u")
    both = both.join(own.select(F.col("digest").alias("v"), F.col("hashes").alias("hb")), "v")
    out = fixed(both.where(linked("ha", "hb")).select("u", "v"))
    drop_stored(own)
    return out


def jaccard_rows(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id (long), th (hash of the text), n (set size), top (the component's least digest; null for empty sets), component_id."""
    small_batches(docs)
    t, d = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("long")
    rows = docs.select(d.alias("doc_id"), F.coalesce(d, F.lit(LOWEST)).alias("dk"), F.xxhash64(t).alias("th"), t.alias("text"))
    measured = stored(rows.select("doc_id", "th", "text").mapInArrow(_measure(width, percent), MEASURED), "measured")
    counts = measured.where("range is not null").select("range", "counts").repartition("range").sortWithinPartitions("range").mapInArrow(_sum_cells, "cell long, n long")
    frequent = sorted((r.cell, r.n) for r in counts.orderBy(F.desc("n"), "cell").limit(FREQUENT).collect())
    own = measured.where("range is null").select("doc_id", "th", "n", "digest")

    prefixes = stored(rows.select("dk", "th", "text").mapInArrow(_prefixes(frequent, width, percent), PREFIXES), "prefixes")
    shared = stored(_buckets(prefixes, frequent), "shared")
    first = F.min(F.struct("dk", "th")).alias("row")
    members = prefixes.groupBy("digest").agg(first, *[F.first(c).alias(c) for c in ("n", "gid", "bits")])
    members = stored(members.select("digest", "row.dk", "row.th", "n", "gid", "bits"), "classes")
    drop_stored(prefixes)

    early = fixed(components(_near(rows, members, shared, width, percent)))
    late = _verify(_rest(shared, members, early, percent), members, rows, width, percent)
    drop_stored(shared)

    lifted = late.join(early.withColumnsRenamed({"node": "u", "root": "ru"}), "u", "left").join(early.withColumnsRenamed({"node": "v", "root": "rv"}), "v", "left")
    lifted = lifted.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    merged = fixed(components(lifted).select(F.col("node").alias("root"), F.col("root").alias("top")))
    classes = own.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    tops = classes.join(early.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest")).join(merged, "root", "left")
    tops = fixed(tops.select("digest", "least", F.coalesce("top", "root").alias("top")))
    drop_stored(members)
    least = fixed(tops.groupBy("top").agg(F.min("least").alias("component_id")))
    named = fixed(tops.join(least, "top").select("digest", "top", "component_id"))
    out = own.join(named, "digest", "left")
    out = fixed(out.select("doc_id", "th", "n", "top", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
    drop_stored(measured)
    return out


def jaccard_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of docs."""
    kind = docs.schema[doc_id].dataType
    rows = jaccard_rows(docs, width, percent, text, doc_id)
    return rows.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component: the least doc_id's (nulls last); rows with empty sets all stay."""
    gone_id, gone_th = fresh(docs, "gone_id", "gone_th")
    rows = jaccard_rows(docs, width, percent, text, doc_id).where("n > 0")
    first = F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    stay = fixed(rows.groupBy("top").agg(first.alias("x")).select("top", F.col("x.doc_id").alias("stay_id"), F.col("x.th").alias("stay_th")))
    gone = rows.join(stay, "top").where(~(F.col("doc_id").eqNullSafe(F.col("stay_id")) & F.col("th").eqNullSafe(F.col("stay_th"))))
    gone = fixed(gone.select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)).distinct())
    id_, th = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))
    same = id_.eqNullSafe(F.col(gone_id)) & th.eqNullSafe(F.col(gone_th))
    small = gone.count() <= MOST_WANTED
    out = docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
    again = fixed(rows.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)))
    n = again.count()
    if not n:
        return out
    again = F.broadcast(again) if n <= MOST_WANTED else again  # rows that are there twice
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([doc_id, text]))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_jaccard_join": op8}
