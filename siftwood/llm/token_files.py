"""Token ids as Arrow IPC files of fixed-size-list batches.

A file holds a range of documents in ascending doc_id order as one stream of ids,
cut into rows of equal length: ids (fixed-size list of the smallest unsigned type
that holds the vocabulary), mask (false for the padding of the last row) and ends
(true at a document's last id). Batches have equal row counts, so row i is row
i % BATCH of batch i // BATCH, read from a memory map without copying. Beside
each file stands one with its doc_ids.

Texts are cut at ASCII white space, which the word-level vocabulary drops and
never joins over; the library encodes each distinct piece, apart from marks at its
end, and the rest is remembered.

Files go to the shared folder; each attempt writes under names of its own, and
only names that a finished task returned are read.

A file holds about FILE_BYTES of texts (a longer text is not split), and one task
writes it: files grow in number with the input, not in size.

Results: null text is empty and gives the end id alone; texts of any length are
encoded whole; null doc_id comes first, equal doc_ids stand by the hash of their
texts; an empty table gives no files and an empty table; other columns are not
read. Who asks for the files deletes them: drop_token_files().
"""

from __future__ import annotations

import itertools
import re
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_files import LONG_PIECE, slices
from .common import Memo, fixed, scratch_path, small_batches, table, worker_state
from .ranges import choose_splitters, range_column

VOCABULARY, END = "word_bpe_49k.json", 1
LENGTH, BATCH = 2048, 64
#: Bytes of text per file, about; files at least.
FILE_BYTES, FEWEST = 32 << 20, 48
LOWEST = -(1 << 63)
KEYS = ["id", "key", "salt"]
#: ASCII marks, without those of special strings.
MARKS = b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
#: Letters of ASCII and Latin-1 (UTF-8) alone: one word to the library, in any case.
WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Bytes of remembered pieces, about.
REMEMBERED = 96 << 20
#: Words that the library gets as one text.
TOGETHER = 200
#: Characters of texts that are cut together, and pieces whose ids are put together at once.
CUT, BLOCK = 4_000_000, 1 << 18


class WordEncoder:
    """Ids of a text as bytes of the smallest unsigned type."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if len(vocab) <= 1 << 16 else "<u4")
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.memo = Memo(REMEMBERED)

    def _ask(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _ids(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces from the library. Words stand together in its texts: each has one id that ends a word, its last."""
        words = [p for p in pieces if p.isalpha() or WORD.fullmatch(p)]
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out: dict[bytes, bytes] = {}
        for group, ids in zip(groups, self._ask([b" ".join(g) for g in groups]), strict=True):
            stops = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(stops) == len(group):
                raw = ids.tobytes()
                out.update(zip(group, (raw[i:j] for i, j in itertools.pairwise([0, *stops])), strict=True))
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, (ids.tobytes() for ids in self._ask(rest)), strict=True))
        return out

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, as far as possible remembered ones."""
        memo = self.memo
        known: dict[bytes, bytes | None] = {}  # a piece may have no ids: None alone means not known
        marked = {}
        for p in pieces:
            stem = p.rstrip(MARKS)
            if len(stem) < len(p) and stem and 97 <= stem[-1] <= 122:  # a letter, then marks: they are a word of their own
                marked[p] = stem, p[len(stem) :]
            else:
                known[p] = memo[p]
        for part in itertools.chain.from_iterable(marked.values()):
            if part not in known:
                known[part] = memo[part]
        found = self._ids([p for p, ids in known.items() if ids is None])
        known |= found
        for p, ids in found.items():
            if len(p) <= LONG_PIECE:
                memo.keep(p, ids, len(p) + len(ids))
        for p, (stem, marks) in marked.items():
            known[p] = known[stem] + known[marks]
        return [known[p] for p in pieces]

    @staticmethod
    def _folded(text: str) -> bytes:
        """The text in small ASCII letters. Case stays for special strings, and before marks that the library composes with small letters only."""
        raw = text.encode()
        return raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        from pyarrow import compute

        cut = compute.ascii_split_whitespace(pa.array([self._folded(t) for t in texts], pa.string()))
        coded = cut.values.dictionary_encode()
        ids, words = self._known(coded.dictionary.cast(pa.binary()).to_pylist()), coded.indices.to_numpy()
        flat, n = np.frombuffer(b"".join(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        first, stops = np.cumsum(n) - n, np.zeros(len(words) + 1, np.int64)
        np.cumsum(n[words], out=stops[1:])
        parts = []
        for i in range(0, len(words), BLOCK):
            w = words[i : i + BLOCK]
            at = np.repeat(first[w] - stops[i : i + len(w)], n[w])
            at += np.arange(stops[i], stops[i + len(w)])
            parts.append(flat[at].tobytes())
        raw = b"".join(parts)
        ends = (stops[cut.offsets.to_numpy()] * self.dtype.itemsize).tolist()
        return [raw[i:j] for i, j in itertools.pairwise(ends)]


def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its own
    return worker_state(("encoder", path), lambda: WordEncoder(path))


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


def ids_column(text: Column, vocabulary: str = VOCABULARY, end: int = END) -> Column:
    """The ids of the whole text and the end id, as bytes."""

    @F.arrow_udf("binary")
    def run(texts):
        import pyarrow as pa

        e = encoder(_path(vocabulary))
        last = np.array([end], e.dtype).tobytes()
        return pa.array([ids + last for part in slices(texts, CUT) for ids in e.encode(part)], pa.binary())

    return run(text)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


class FileWriter:
    """Streams ids into one file."""

    def __init__(self, uri: str, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH):
        import pyarrow as pa

        self.pa, self.dtype, self.length, self.room = pa, dtype, length, length * batch
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])
        self.store, self.path = _open(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = pa.OSFile(self.path, "wb") if type(self.store).__name__ == "LocalFileSystem" else self.store.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held, self.size, self.ends, self.docs, self.total = [], 0, [], [], 0

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append(doc_id)
        a = np.frombuffer(ids, self.dtype)
        self.total += len(a)
        while len(a):
            part = a[: self.room - self.size]
            self.held.append(part)
            self.size += len(part)
            a = a[len(part) :]
            if not len(a):
                self.ends.append(self.size - 1)
            if self.size == self.room:
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.size // self.length)
        ids, mask, ends = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool), np.zeros(rows * self.length, bool)
        ids[: self.size], mask[: self.size], ends[self.ends] = np.concatenate(self.held), True, True
        lists = [self.pa.FixedSizeListArray.from_arrays(self.pa.array(x), self.length) for x in (ids, mask, ends)]
        self.file.write_batch(self.pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.size, self.ends = [], 0, []

    def close(self, id_type) -> None:
        if self.size:
            self._flush()
        self.file.close()
        self.out.close()
        rows = self.pa.table({"doc_id": self.pa.array(self.docs, id_type)})
        with self.store.open_output_stream(self.path + ".docs") as out, self.pa.ipc.new_file(out, rows.schema) as f:
            f.write_table(rows)


def open_file(uri: str):
    """A reader with zero-copy batches (of a memory map, where the file is local)."""
    import pyarrow as pa

    store, path = _open(uri)
    return pa.ipc.open_file(pa.memory_map(path) if type(store).__name__ == "LocalFileSystem" else store.open_input_file(path))


def sequence(reader, i: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of row i."""
    rows = reader.get_batch(i // batch)
    return tuple(rows.column(k)[i % batch].values.to_numpy(zero_copy_only=k == "ids") for k in ("ids", "mask"))


def read_documents(uri: str):
    """(doc_id, n_tokens, crc32 of the ids as unsigned 32-bit integers) in file order; one batch at a time."""
    import pyarrow as pa

    store, path = _open(uri)
    with store.open_input_file(path + ".docs") as f:
        docs = iter(pa.ipc.open_file(f).read_all().column("doc_id").to_pylist())
    reader, n, crc = open_file(uri), 0, 0
    for k in range(reader.num_record_batches):
        rows = reader.get_batch(k)
        ids, mask, ends = (rows.column(c).values.to_numpy(zero_copy_only=c == "ids") for c in ("ids", "mask", "ends"))
        ids, at = ids[: int(mask.sum())].astype("<u4"), 0
        for stop in (np.flatnonzero(ends) + 1).tolist():
            yield next(docs), n + stop - at, zlib.crc32(ids[at:stop], crc)
            n, crc, at = 0, 0, stop
        n, crc = n + len(ids) - at, zlib.crc32(ids[at:], crc)


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, text: str = "text", doc_id: str = "doc_id") -> list[tuple]:
    """Writes the files; returns (number in doc_id order, uri, documents, ids) of each."""
    t = F.col(f"`{text}`")
    keys = [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(t).alias("key"), F.monotonically_increasing_id().alias("salt")]
    small_batches(docs)
    sized = fixed(docs.select(*keys, (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(FEWEST, total // FILE_BYTES)
    splitters, ranges = choose_splitters(sized, KEYS, "size", n, total)
    id_kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *keys, ids_column(t, vocabulary, end).alias("ids"))
    rows = rows.withColumn("range", range_column([F.col(k) for k in KEYS], splitters)).select("range", "id", "key", "doc_id", "ids")
    rows = rows.repartitionById(len(ranges), F.col("range")).sortWithinPartitions("range", "id", "key", "ids")

    def run(batches):
        import pyarrow as pa

        dtype = encoder(_path(vocabulary)).dtype
        stream = ((b.schema.field("doc_id").type, *r) for b in batches for r in zip(b.column("range").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True))
        for number, group in itertools.groupby(stream, lambda r: r[1]):
            uri = f"{path}/ids-{number:06d}-{uuid.uuid4().hex}.arrow"
            out = FileWriter(uri, dtype)
            for kind, _, doc, ids in group:
                out.add(doc, ids)
            out.close(kind)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([number], [uri], [len(out.docs)], [out.total])], ["number", "uri", "docs", "ids"])

    written = rows.select("range", "doc_id", "ids").mapInArrow(run, "number long, uri string, docs long, ids long")
    return sorted((tuple(r) for r in written.collect()), key=lambda r: r[0])  # one row per file


def read_token_files(spark: SparkSession, files: list[tuple], id_kind: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files."""
    starts = itertools.accumulate((f[3] for f in files), initial=0)
    listed = [(k, f[1], s) for k, (f, s) in enumerate(zip(files, starts, strict=False))]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                docs, n, crc = zip(*read_documents(uri), strict=True)
                ends = start + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - np.array(n)), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame(listed, "number int, uri string, start long").repartitionById(max(1, len(listed)), F.col("number"))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def drop_token_files(spark: SparkSession, path: str) -> None:
    """Deletes the files under a path once nothing reads them any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "ids")
    rows = fixed(read_token_files(spark, write_token_files(docs, path)))
    drop_token_files(spark, path)
    return rows


QUERIES = {"op6_token_files": op6}
