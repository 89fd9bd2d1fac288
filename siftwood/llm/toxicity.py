"""Toxicity with noisy-channel deobfuscation.

1. Character model: trigram counts of all texts (bounded by the alphabet), summed
   by Spark; probabilities interpolated with bigrams.
2. Channel: a suspicious token (leetspeak signs among letters, repeated letters,
   letters spaced out by blanks or marks) becomes a lattice: each observed
   character may stand for letters, for a repetition, or for a separator, at a
   price. Viterbi decoding under the character model gives the restored word; in
   a run of letters that stand apart or a token of more than LONGEST signs, any
   letter may also begin a new word.
3. Score: a logistic model over features of the words as they are and as restored
   (words, and their beginnings of 4 to 6 letters; of runs and long tokens also 5 and
   6 letters from every letter on, as words' ends are guesses there). Features are those that toxic
   rows hold more often than chance over all candidates allows.

The classifier is fitted on MOST_LABELLED labelled rows of either class at most,
chosen by a hash of doc_id, near copies (by min-hashes) once; the base rate comes from all labelled rows.
Every feature of that sample that chance does not explain is in the model.
Inputs of a score: the text alone.

Results: null and empty texts get the score of a text without features (under
0.7); texts, runs and tokens of any length are read whole; repeated rows get equal
scores; a table without usable labels scores every text 0; an empty table gives an
empty table; columns that clash with result names are replaced, all others are
kept; of a doc_id labelled more than once the largest label counts.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, drop_stored, fixed, small_batches, stored, table, without, worker_state
from .shingles import min_hashes, shingles

THRESHOLD = 0.7
#: Rows of either class in the fit; chance of a false feature over all candidates; toxic rows from which a feature is sure.
MOST_LABELLED, CHANCE, SURE = 6000, 0.05, 40
#: Bytes of a worker's remembered tokens and of its restored ones, about.
TOKEN_BYTES, RESTORED_BYTES = 32 << 20, 12 << 20
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäåæçèéêëìíîïñòóôöøùúûüßœ"
SIZE = 64
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
SEPARATORS = set("._-*~ '/\\|,:;·")
LEET_COST, REPEAT_COST, SEPARATOR_COST, OTHER_COST = -1.0, -1.0, -0.5, -6.0
#: Price of no word's end at a gap wider than the run's least one; lengths of features taken at every letter of a run.
WIDE_COST, INNER = -3.0, (5, 6)
#: Signs up to which a token counts as one word; in longer ones words may begin at any letter.
LONGEST = 40
COLLAPSED = re.compile(r"(.)\1{2,}", re.DOTALL)
GAPS = re.compile(r"[\s._\-*~'/\\|,:;·]{4,}")
#: Signs of a run that are decoded at once, and those that the next piece repeats: 100 letters or more.
WINDOW, OVERLAP = 8192, 400
PARTS = re.compile(r"[._\-*~'/\\|,:;·]+")
#: Four letters or more that stand apart, behind any number of separators each; the two classes share no sign, so matching takes linear time.
SPACED = re.compile(r"(?<![^\s._\-*~'/\\|,:;·])([^\s._\-*~'/\\|,:;·](?:[\s._\-*~'/\\|,:;·]++[^\s._\-*~'/\\|,:;·]){3,})[!?\")\]]*+(?![^\s._\-*~'/\\|,:;·])")
REPEATED = re.compile(r"([^\W\d_])\1")
SIGNS = re.compile(r"[0-9@$!|+(€£¡*#]")
MARKED = re.compile(r"[^\W\d_](?:[._\-*~'/\\|·][^\W_]){2,}|[^\W\d_][._\-*~][^\W\d_]")
EDGES = " \t.,;:!?\"'()[]{}<>&%#*$|-_«»¿¡"


def codes(text: str) -> np.ndarray:
    """Letters as 1 to 63, all else as 0."""
    return _code_table()[np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")]


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    t = np.zeros(1 << 16, np.int32)
    for i, c in enumerate(LETTERS, 1):
        t[ord(c)] = i
    return t


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all letter trigrams of all texts."""

    def run(batches):
        import pyarrow as pa

        worker_state("trigrams", dict)
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            held, size = [], 0
            for t in [*b.column(0).to_pylist(), None]:
                if t is not None:
                    held.append(t)
                    size += len(t)
                if size > 2_000_000 or t is None and held:
                    c = codes(" ".join(["", *held, ""]))
                    total += np.bincount(c[:-2] * (SIZE * SIZE) + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)
                    held, size = [], 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["gram", "n"])

    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "gram long, n long")
    out = np.zeros(SIZE**3, np.int64)
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # SIZE ** 3 rows at most
        out[r.gram] = r.n
    return out


class Channel:
    """Viterbi decoding of tokens under a character model."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + SIZE)
        p2 = (n2 + 20 * p1) / (n2.sum(1, keepdims=True) + 20)
        p3 = (n3 + 20 * p2) / (n3.sum(2, keepdims=True) + 20)
        self.log = np.log(p3).astype(np.float32)

    def options(self, token: str) -> list[list[tuple[str, float]]]:
        """Per observed character, the letters it may stand for ('' for none) and their prices."""
        out, before = [], ""
        for i, c in enumerate(token):
            own = []
            if c in LETTERS:
                own.append((c, 0.0))
                if c == before:
                    own.append(("", REPEAT_COST))
            own += [(x, LEET_COST) for x in LEET.get(c, "")]
            if c in LEET and i and token[i - 1] == c:
                own.append(("", REPEAT_COST))
            if c in SEPARATORS:
                own.append(("", SEPARATOR_COST))
            if c not in SEPARATORS:
                before = c
            out.append(own or [("", OTHER_COST)])
        return out

    def decode(self, token: str) -> str:
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.options(token):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, said) in best.items():
                for letter, price in options:
                    if letter:
                        c = LETTERS.index(letter) + 1
                        key, s, x = (b, c), score + price + float(self.log[a, b, c]), said + letter
                    else:
                        key, s, x = (a, b), score + price, said
                    if key not in new or s > new[key][0] or s == new[key][0] and x < new[key][1]:
                        new[key] = (s, x)
            best = new
        return max(((s + float(self.log[a, b, 0]), x) for (a, b), (s, x) in best.items()), key=lambda y: (y[0], y[1]))[1]

    def words(self, run: str) -> list[str]:
        """The words of a run whose words' ends are not known: any letter may begin one. Time is in proportion to the length."""
        signs, gap = [], 0
        for options in self.options(run):
            if any(letter for letter, _ in options):
                signs.append((gap, options))
                gap = 0
            else:  # separators, and signs that stand for nothing, cost all paths the same
                gap += 1
        least = min((g for g, _ in signs[1:]), default=0)
        log, best = self.log, {(0, 0): (0.0, None)}
        for gap, options in signs:
            wide = WIDE_COST if gap > least else 0.0
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, said) in best.items():
                for letter, price in options:
                    if not letter:
                        ways = [((a, b), score + price, said)]
                    else:
                        c = LETTERS.index(letter) + 1
                        ways = [((b, c), score + price + wide * (b > 0) + float(log[a, b, c]), (said, letter))]
                        if b:
                            ways.append(((0, c), score + price + float(log[a, b, 0]) + float(log[b, 0, c]), ((said, " "), letter)))
                    for key, s, x in ways:
                        if key not in new or s > new[key][0]:
                            new[key] = (s, x)
            best = new
        said = max(((s + float(log[a, b, 0]), (a, b), x) for (a, b), (s, x) in best.items()), key=lambda y: y[:2])[2]
        letters = []
        while said:
            said, letter = said
            letters.append(letter)
        return "".join(reversed(letters)).split()


def suspicious(token: str) -> bool:
    return len(token) <= LONGEST and (bool(REPEATED.search(token)) or any(c.isalpha() for c in token) and (bool(SIGNS.search(token)) or bool(MARKED.search(token))))


class Reader:
    """Features of texts; tokens and their restored forms are remembered."""

    def __init__(self, channel: Channel):
        self.channel = channel
        self.restored = Memo(RESTORED_BYTES)

    def restore(self, token: str) -> str:
        """token is lower-case; '' if nothing is restored."""
        x = self.restored[token]
        if x is None:
            x = self.channel.decode(token)
            self.restored.keep(token, x, 2 * len(token) + 2 * len(x))
        return x

    def own_forms(self, core: str) -> list[str]:
        return [core, self.restore(core)] if suspicious(core) else [core]

    def forms(self, token: str) -> list[str]:
        """The word in a lower-case token, its parts between separators, and their restored forms."""
        core = token.strip(EDGES)
        out = self.own_forms(core) if len(core) <= LONGEST else []
        parts = PARTS.split(core)
        if len(parts) > 1:
            out += [x for p in parts if len(p) <= LONGEST for x in self.own_forms(p)]
        if core != token:  # signs at the edges may stand for letters
            edge = token.strip(" \t.,;:?\"'[]{}<>&%-_«»¿")
            if edge != core and SIGNS.search(edge) and any(c.isalpha() for c in edge) and len(edge) <= LONGEST and len(edge) - len(core) <= 2:
                out.append(self.restore(edge))
        return list(dict.fromkeys(x for x in out if x))

    def token_features(self, token: str) -> Iterator[str]:
        """Features of a lower-case token of any length; long repetitions in long ones count as two."""
        if len(token) > LONGEST:
            token = COLLAPSED.sub(r"\1\1", token)
        for x in self.forms(token):
            yield from self.features(x)
        if len(token) > LONGEST:
            yield from self.run_features(token)

    @staticmethod
    def features(form: str) -> list[str]:
        return [f"={form}", *[f"^{form[:k]}" for k in (4, 5, 6) if len(form) > k]]

    def run_words(self, run: str) -> Iterator[list[str]]:
        """The restored words of a run, in overlapping pieces."""
        run = GAPS.sub(lambda m: m[0][:3], run)
        for k in range(0, max(len(run) - OVERLAP, 1), WINDOW - OVERLAP):
            yield self.channel.words(run[k : k + WINDOW])

    def run_features(self, run: str) -> Iterator[str]:
        """Features of a run's words, and those at every letter, wherever its words may begin."""
        for words in self.run_words(run):
            for w in words:
                yield from self.features(w)
            joined = "".join(words)
            for k in INNER:
                for i in range(len(joined) - k + 1):
                    yield f"={joined[i : i + k]}"
                    yield f"^{joined[i : i + k]}"

    @staticmethod
    def spaced_runs(low: str) -> list[str]:
        """Runs of letters that stand apart."""
        return [m[1] for m in SPACED.finditer(low) if sum(c in LETTERS or c in LEET for c in m[1]) >= 4]

    def spaced(self, low: str) -> list[str]:
        """Restored words of letters that stand apart."""
        return [w for r in self.spaced_runs(low) for words in self.run_words(r) for w in words]

    def spaced_features(self, low: str) -> Iterator[str]:
        for r in self.spaced_runs(low):
            yield from self.run_features(r)

    def text_features(self, text: str) -> set[str]:
        low = text.lower()
        return {f for t in set(low.split()) for f in self.token_features(t)}.union(self.spaced_features(low))


class Model:
    """weights: feature to weight; score(text)."""

    def __init__(self, reader: Reader, weights: dict[str, tuple[float, float]], bias: float):
        self.reader, self.weights, self.bias = reader, weights, bias
        self.names = {f: f for f in weights}
        self.memo = Memo(TOKEN_BYTES)

    def token(self, token: str) -> tuple[str, ...]:
        own = tuple(dict.fromkeys(self.names[f] for f in self.reader.token_features(token) if f in self.names))
        if len(token) <= LONGEST:
            self.memo.keep(token, own, 2 * len(token) + 8 * len(own))
        return own

    def score(self, text: str) -> float:
        low = text.lower()
        get, make = self.memo.__getitem__, self.token
        found: set[str] = set()
        for t in low.split():
            own = get(t)
            if own is None:
                own = make(t)
            if own:
                found.update(own)
        found.update(f for f in self.reader.spaced_features(low) if f in self.weights)
        own = [self.weights[f] for f in sorted(found)]
        z = max([self.bias + sum(w for w, _ in own), *[least for _, least in own]])
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _log_tail(k: int, n: int, p: float) -> float:
    """log of the chance of k or more of n at p (at least its largest term)."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, min(n, k + 40) + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def _least_toxic(n_of: dict[int, int], tried: int) -> int:
    """The fewest toxic rows with which a feature that no other row has can pass choose()."""
    n1, n0 = n_of.get(1, 0), n_of.get(0, 0)
    if not n1 or not n0:
        return 3
    return max(3, math.ceil(math.log(CHANCE / max(tried, 1)) / math.log(n1 / (n1 + n0))))


def choose(found: list[tuple[str, int, int]], n1: int, n0: int, tried: int) -> list[tuple[str, int, int]]:
    """Of features (name, toxic rows, rows) those that chance over all tried does not explain."""
    p = n1 / (n1 + n0)
    limit = math.log(CHANCE / max(tried, 1))
    kept = sorted((x, f, k, n) for f, k, n in found if (x := _log_tail(k, n, p)) < limit)
    return [(f, k, n) for _, f, k, n in kept]


def fit(chosen: list[tuple[str, int, int]], sets: list[list[int]], y: np.ndarray, base: float) -> tuple[dict[str, tuple[float, float]], float]:
    """Weight and least logit by feature, and the bias. sets: indexes of features of each row; base: the share of toxic rows outside the sample.

    The least logit is what a feature shows alone that SURE toxic rows and no others hold: their number against three."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    p = n1 / (n1 + n0)
    weight = np.where(y > 0, base / p, (1 - base) / (1 - p))
    flat = np.array([i for s in sets for i in s], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    w, b = np.zeros(len(chosen)), math.log(base / (1 - base))
    vw, vb = np.zeros(len(chosen)), 0.0
    for _ in range(400):  # gradient descent with momentum on the ridge-penalised loss
        z = b + np.bincount(row, w[flat], minlength=len(sets))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        vw = 0.9 * vw - 40.0 * (np.bincount(flat, g[row], minlength=len(chosen)) / weight.sum() + 1e-5 * w)
        vb = 0.9 * vb - 0.5 * g.sum() / weight.sum()
        w, b = np.clip(w + vw, 0, 12), b + vb
    least = [math.log(k / 3) if k == n >= SURE else -60.0 for _, k, n in chosen]
    return {f: (float(x), z) for (f, _, _), x, z in zip(chosen, w, least, strict=True)}, float(b)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, tuple[float, float]], float]:
    """Character counts over all docs; weights and bias from labelled training rows (crc32(doc_id) mod 3 is not 1)."""
    counts = count_trigrams(docs)
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):  # nothing to tell apart
        return counts, {}, -60.0
    picked = [own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED) for k in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * MOST_LABELLED rows at most
    small, key = _packed(counts), uuid.uuid4().hex

    @F.arrow_udf("fs array<string>, p1 long, p2 long, p3 long")
    def features(texts):
        import pyarrow as pa

        reader = worker_state(key, lambda: Reader(Channel(_unpacked(small))))
        texts = [t or "" for t in texts.to_pylist()]
        parts = [pa.array([sorted(reader.text_features(t)) for t in texts], pa.list_(pa.string()))]
        parts += [pa.array(x, pa.int64()) for x in zip(*[min_hashes(shingles(t)) for t in texts], strict=True)] if texts else [pa.array([], pa.int64())] * 3
        return pa.StructArray.from_arrays(parts, ["fs", "p1", "p2", "p3"])

    all_drawn = stored(docs.join(picked, "doc_id").select("doc_id", "toxic", features("text").alias("x")).select("doc_id", "toxic", "x.*"), "features")
    single = all_drawn.select("doc_id", "p1", "p2", "p3")
    for p in ("p1", "p2", "p3"):  # near copies of one text count once, else its words would seem to be signs of its label
        single = single.groupBy(p).agg(F.min_by(F.struct("doc_id", "p1", "p2", "p3"), "doc_id").alias("x")).select("x.*")
    drawn = fixed(all_drawn.drop("p1", "p2", "p3").join(F.broadcast(single.select("doc_id").distinct()), "doc_id"))
    rows = drawn.select("toxic", F.explode("fs").alias("f")).groupBy("f").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).where("k >= 3")
    tried = rows.count()
    n_of = {r.toxic: r.n for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # As many as the sample's rows, a bounded number, hold three times or more: about as many in a table of any size.
    best = rows.where("k >= 0.8 * n").where(F.lit(_least_toxic(n_of, tried)) <= F.col("k"))
    chosen = choose([(r.f, r.k, r.n) for r in best.collect()], n_of.get(1, 0), n_of.get(0, 0), tried)
    at = {f: i for i, (f, _, _) in enumerate(chosen)}

    @F.arrow_udf("array<int>")
    def places(sets):
        import pyarrow as pa

        return pa.array([sorted(at[f] for f in fs or () if f in at) for fs in sets.to_pylist()], pa.list_(pa.int32()))

    held = [(r.toxic, r.fs) for r in drawn.select("doc_id", "toxic", places("fs").alias("fs")).orderBy("doc_id").collect()]
    drop_stored(all_drawn)
    return counts, *fit(chosen, [s for _, s in held], np.array([t for t, _ in held], np.float64), totals[1] / (totals[0] + totals[1]))


def _packed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return at, counts[at]


def _unpacked(packed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(SIZE**3, np.int64)
    out[packed[0]] = packed[1]
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def score_column(text: Column, counts: np.ndarray, weights: dict[str, tuple[float, float]], bias: float) -> Column:
    key, small = uuid.uuid4().hex, _packed(counts)

    @F.arrow_udf("double")
    def run(texts):
        import pyarrow as pa

        model = worker_state(key, lambda: Model(Reader(Channel(_unpacked(small))), weights, bias))
        return pa.array([model.score(t.as_py() or "") for t in texts], pa.float64())

    return run(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    small_batches(docs)
    counts, weights, bias = train(docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text")), labels.select("doc_id", "toxic"))
    out = without(docs, "score", "predicted").withColumn("score", F.round(score_column(F.col(f"`{text}`"), counts, weights, bias), 9))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7}
