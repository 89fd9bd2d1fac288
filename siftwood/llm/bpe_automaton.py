"""BPE encoding and decoding by a tokenization automaton.

compile: the automaton starts as one state with an arc for each base symbol. The
merges are taken in rank order; merge (u, v) -> w applies one gadget: the state
that u arcs lead to is split off for u (a copy of its arcs), the copy loses its
arc v, and every state that still has an arc u gains an arc w to where v arcs
lead. The automaton then reads a token string exactly if it is the BPE encoding
of its bytes. Construction follows "Constructing a BPE Tokenization DFA"
(Berglund, Martens, van der Merwe, 2024).

The compiled table: all arcs of a token lead to one state (goal), and tokens with
arcs in the same states are one column (column), so the arcs of all states are a
bit for each column and state. It is complete before the first word is read.

encode: from each place, the longest token with an arc in the state reached there.
Where no token has one, the last step is taken back for the next shorter token. A
word's beginnings have one encoding each, so no place is come to twice, and time is
in proportion to the word's length (times that of a token, at most). decode: the
bytes on the arcs, joined.

Results: null text is empty and has no ids; texts of any length are read whole;
repeated rows and ties get equal results; an empty table gives an empty table;
columns that clash with result names are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_files import LONG_PIECE, BpeFile, pieces
from .common import Memo, fresh, sizes, small_batches, table, without, worker_state

VOCABULARY = "byte_bpe_50k.json"
#: The key of a node's token in the trie; no character has it.
TOKEN = ""
#: Bytes of a worker's remembered pieces, about.
PIECE_BYTES = 72 << 20


class MergeAutomaton:
    """goal, column: by token id; bits: whether the arcs of a column leave a state, width bytes a column."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        base = [t for t in vocab if len(t) == 1]
        goal = dict.fromkeys(base, 0)
        leads = [len(base)]  # how many tokens' arcs lead to a state
        column = {t: i for i, t in enumerate(base)}
        users = [1] * len(base)  # how many tokens share a column
        bits = np.zeros((max(1024, 2 * len(base)), 256), np.uint8)
        bits[: len(base), 0] = 1
        for u, v in merges:
            w = u + v
            if w in goal or not (w in vocab and u in goal and v in goal):
                continue
            s = behind = goal[u]
            if leads[s] > 1 or u == v:  # arcs of other tokens lead there too: split it off for u
                leads[s] -= 1
                n = goal[u] = len(leads)
                leads.append(1)
                if n >> 3 == bits.shape[1]:
                    bits = np.pad(bits, ((0, 0), (0, n >> 3)))
                bits[: len(users), n >> 3] |= (bits[: len(users), s >> 3] >> (s & 7) & 1) << (n & 7)
                s = n
            own = column[v]
            if bits[own, s >> 3] >> (s & 7) & 1:  # s loses its arc v
                if users[own] > 1:  # v leaves the column that it shares
                    users[own] -= 1
                    new = column[v] = len(users)
                    users.append(1)
                    if new == len(bits):
                        bits = np.pad(bits, ((0, new // 2), (0, 0)))
                    bits[new] = bits[own]
                    own = new
                bits[own, s >> 3] &= 0xFF ^ 1 << (s & 7)
            column[w] = column[u]  # an arc w wherever there is an arc u
            users[column[u]] += 1
            goal[w] = behind if u == v else goal[v]  # the second u leads to the state as it was
            leads[goal[w]] += 1
        self.states, self.width = len(leads), (len(leads) + 7) // 8
        self.bits = bits[: len(users), : self.width].tobytes()
        size = 1 + max(vocab.values(), default=0)
        self.goal, self.row = array("i", bytes(4 * size)), array("i", bytes(4 * size))  # row: where a token's column begins
        self.length = array("i", bytes(4 * size))
        self.trie: dict = {TOKEN: -1}  # the first node; each has the token that ends there, if any, and the nodes below by character
        for t, to in goal.items():
            i = vocab[t]
            self.goal[i], self.row[i], self.length[i] = to, column[t] * self.width, len(t)
            node = self.trie
            for c in t:
                node = node.setdefault(c, {TOKEN: -1})
            node[TOKEN] = i

    def arc(self, state: int, token: int) -> bool:
        return bool(self.bits[self.row[token] + (state >> 3)] >> (state & 7) & 1)

    def encode(self, word: str) -> list[int]:
        """The token ids of a word."""
        trie, goal, row, bits, length = self.trie, self.goal, self.row, self.bits, self.length
        at, end, s, path, shorter = 0, len(word), 0, [], []
        while at < end:
            node, i, found = trie, at, []
            while i < end:
                node = node.get(word[i])
                if node is None:
                    break
                i += 1
                t = node[TOKEN]
                if t >= 0:
                    found.append(t)
            byte, bit = s >> 3, s & 7
            while found and not bits[row[found[-1]] + byte] >> bit & 1:
                found.pop()
            while not found:
                if not path:
                    raise ValueError("a symbol outside the vocabulary")
                at -= length[path.pop()]
                found, byte, bit = shorter.pop()
                while found and not bits[row[found[-1]] + byte] >> bit & 1:
                    found.pop()
            t = found.pop()
            path.append(t)
            shorter.append((found, byte, bit))
            at += length[t]
            s = goal[t]
        return path


class Codec:
    def __init__(self, path: str):
        self.file = BpeFile(path)
        self.automaton = MergeAutomaton(self.file.vocab, self.file.merges)
        self.labels = self.file.token_bytes()
        self.memo = Memo(PIECE_BYTES)

    def piece_ids(self, piece: str) -> bytes:
        out = array("I")
        for w in self.file.words(piece):
            if isinstance(w, int):
                out.append(w)
            else:
                out.extend(self.automaton.encode(w))
        ids = out.tobytes()
        if len(piece) <= LONG_PIECE:
            self.memo.keep(piece, ids, 2 * len(piece) + len(ids))
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, make = self.memo.__getitem__, self.piece_ids
        return b"".join([get(p) or make(p) for p in pieces(text)])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, array("I", ids))).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return worker_state(("codec", path), lambda: Codec(path))


def encode_column(text: Column, vocabulary: str, digest: bool = False) -> Column:
    """Struct of n_tokens, ids (little-endian bytes; or ids_sha256) and decoded (or decoded_sha256)."""
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else None

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids binary, decoded string"

    @F.arrow_udf(kind)
    def run(texts):
        import pyarrow as pa

        c = codec(path or public_tokenizers.path(vocabulary))
        n, a, b = [], [], []
        for t in sizes(texts):
            ids = c.encode(t)
            back = c.decode(ids)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest() if digest else ids)
            b.append(hashlib.sha256(back.encode()).hexdigest() if digest else back)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string() if digest else pa.binary()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256" if digest else "ids", "decoded_sha256" if digest else "decoded"])

    return run(text)


def bpe_encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, digest: bool = False) -> DataFrame:
    """docs with n_tokens, ids and decoded of the whole text (or with their digests)."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    keep = without(small_batches(docs), *[n for n in names if n.lower() != text.lower()])
    (own,) = fresh(keep, "bpe")
    out = keep.withColumn(own, encode_column(F.col(f"`{text}`"), vocabulary, digest))
    kept = [F.col(f"`{c}`") for c in keep.columns if c.lower() not in names]
    return out.select(*kept, *[F.col(f"`{own}`.{n}").alias(n) for n in names])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, digest=True).drop("text")


QUERIES = {"op9_bpe_automaton": op9}
