"""Files as tables: scanning, classifying, and one generator per format.

A file table has file_id and content (binary). Generators run in Python on Arrow
batches, one file after another, and never raise for a file: what can't be read
gives no rows, or an error where a table has that column (errors=True). All that
follows is SQL.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cfb, documents, formats, ovba

#: Arrow batches that Python gets: setting, Spark's usual value, ours. Files are large beside the rows that Spark's values suit.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}
#: Bytes of files, and rows, that one output batch gathers: rows of a few numbers are small in Arrow, not in Python.
BATCH, ROWS = 8 << 20, 10_000


def scan_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """file_id (the path), length, modified, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("file_id"), "length", F.col("modificationTime").alias("modified"), "content")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out over the cores, if their input has fewer splits than there are cores (one file of one row group, large files beside each other); else as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def small_batches(rows: DataFrame) -> DataFrame:
    """rows; its session's Arrow batches get bounds that suit files, where Spark's usual ones stand: a worker's memory doesn't grow with its task's rows."""
    conf = rows.sparkSession.conf
    for name, (usual, bound) in BATCHES.items():
        if conf.get(name) == usual:
            conf.set(name, bound)
    return rows


def container_type() -> Column:
    """What a file is, by its first bytes or by what stands anywhere in it, in order of precedence."""
    c = F.col("content")
    text = F.decode(c, "ISO-8859-1")  # a sign per byte
    low = F.lower(text)
    xml = text.rlike(r"\A(\xEF\xBB\xBF)?\s*<")  # mail may quote a namespace too
    start = lambda x: F.hex(F.substring(c, 1, len(x) // 2)) == x.upper()
    near = F.abs(F.locate("mime", low) - F.locate("version", low)) < 20
    return (
        F.when(start("D0CF11E0A1B11AE1"), F.when(F.contains(F.lower(F.decode(c, "ISO-8859-1")), F.lit("p\0o\0w\0e\0r\0p\0o\0i\0n\0t\0 \0d\0o\0c\0u\0m\0e\0n\0t\0")), "PPT").otherwise("OLE"))
        .when(start("504B0304"), "OpenXML")
        .when(xml & F.contains(text, F.lit(formats.WORD_2003.decode())), "Word2003_XML")
        .when(xml & F.contains(text, F.lit(formats.FLAT_OPC.decode())), "FlatOPC_XML")
        .when(F.contains(low, F.lit("mime")) & F.contains(low, F.lit("version")) & F.contains(low, F.lit("multipart")) & near, "MHTML")
        .when(start("7B5C7274"), "RTF")
        .when(start("4944"), "SLK")
        .when(start("89504E470D0A1A0A"), "PNG")
        .when(start("E4525C7B8CD8A74DAEB15378D02996D3"), "OneNote")
        .when(start("4D5A"), "PE")
        .when(F.octet_length(c) == 0, "Unknown")
        .when(F.contains(F.decode(c, "ISO-8859-1"), F.lit("\0")), "Unknown")
        .otherwise("Text")
    )


def is_rtf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == "7B5C7274"


def generate(files: DataFrame, read: Callable[[bytes], Iterator[tuple]], schema: str, key: str = "file_id", content: str = "content", errors: bool = False) -> DataFrame:
    """key and the rows that read(content) yields, for each file.

    errors: one more column, error (name and message); a file that can't be read on gives the rows read so far, and a row
    of nulls with the error. Without it such a file gives the rows read so far."""
    kind = files.schema[key].dataType.simpleString()
    failures = (ValueError, IndexError, KeyError, OverflowError, ArithmeticError, EOFError, RecursionError, struct.error, zipfile.BadZipFile, zlib.error)
    width = len(_arrow(schema))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            held, size = [], 0
            types = pa.schema([(key, b.schema.field(key).type), *_arrow(schema), *([("error", pa.string())] if errors else [])])
            last = (None,) if errors else ()
            for k, data in zip(b.column(key).to_pylist(), b.column(content), strict=True):
                data = data.as_py()
                if data is None:
                    continue
                try:
                    for row in read(data):
                        held.append((k, *row, *last))
                        size += _length(row)
                        if size > BATCH or len(held) >= ROWS:
                            yield _batch(held, types)
                            held, size = [], 0
                except failures as e:
                    if errors:
                        held.append((k, *[None] * width, f"{type(e).__name__}: {e}"))
            if held:
                yield _batch(held, types)

    return small_batches(files).select(key, content).mapInArrow(run, f"{key} {kind}, {schema}" + (", error string" if errors else ""))


def _length(x) -> int:
    """Of bytes and texts, in lists too."""
    return len(x) if isinstance(x, (bytes, str)) else sum(map(_length, x)) if isinstance(x, (list, tuple)) else 0


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return [(name, kinds[kind]) for name, kind in (f.strip().split(" ", 1) for f in schema.replace("map<string,string>", "map<string;string>").split(", ") for f in [f.replace(";", ",")])]


# --- compound files ----------------------------------------------------------------------


def ole_streams(files: DataFrame) -> DataFrame:
    """file_id, sid, path (null for orphans), size, content."""
    return generate(files, lambda d: ((e.sid, e.path, len(c), c) for e, c in cfb.CompoundFile(d).streams()), "sid long, path string, size long, stream binary")


def ole_entries(files: DataFrame) -> DataFrame:
    """Directory entries with their status, links, CLSID and times (100 ns since 1601)."""

    def read(data):
        for e in cfb.CompoundFile(data).entries:
            status = "unused" if e.kind == 0 else "ORPHAN" if e.path is None else "<Used>"
            yield e.sid, status, cfb.KINDS.get(e.kind, "?"), e.name, e.path, *[None if x == cfb.FREE else x for x in (e.left, e.right, e.child)], e.start, e.size, e.clsid or None, e.created or None, e.modified or None

    return generate(files, read, "sid long, status string, kind string, name string, path string, left_sid long, right_sid long, child_sid long, first_sector long, size long, clsid string, created long, modified long")


def ole_header(files: DataFrame) -> DataFrame:
    """file_id, attribute, value of the header."""
    return generate(files, lambda d: ((k, v) for k, v in cfb.CompoundFile(d).header.items()), "attribute string, value long")


def ole_fat(files: DataFrame, mini: bool = False) -> DataFrame:
    """file_id, sector, type, offset, next of the (mini) allocation table."""
    names = {cfb.FREE: "Free", cfb.END: "End of Chain", cfb.FAT_SECTOR: "FAT Sector", cfb.DIFAT_SECTOR: "DIFAT Sector"}

    def read(data):
        f = cfb.CompoundFile(data)
        for i, x in enumerate(f.mini_fat if mini else f.fat):
            yield i, names.get(x, "<Data>"), None if mini else f.sector * (i + 1), None if x in names else x

    return generate(files, read, "sector long, type string, offset long, next long")


def ole_metadata(files: DataFrame) -> DataFrame:
    """file_id, property, value of the summary information."""

    def read(data):
        for e, content in cfb.CompoundFile(data).streams(orphans=False):
            if e.path == "\x05SummaryInformation":
                for k, v in formats.property_set(content).items():
                    if k in formats.SUMMARY:
                        yield formats.SUMMARY[k], str(v)

    return generate(files, read, "property string, value string")


def encrypted(files: DataFrame) -> DataFrame:
    """file_id, encrypted, decryption: of files of any kind; decryption says that this library detects, and does not decrypt."""
    rows = generate(files, lambda d: [(documents.is_encrypted(d),)], "encrypted boolean")
    return rows.withColumn("decryption", F.when(F.col("encrypted"), "UnsupportedEncryptionError"))


def _project_modules(data: bytes) -> Iterator[tuple]:
    f = cfb.CompoundFile(data)
    by_path = {e.path: c for e, c in f.streams(orphans=False)}
    used = set()
    n = 0
    for path in list(by_path):
        root, _, last = path.rpartition("/")
        if last.lower() != "dir" or root.rpartition("/")[2].upper() != "VBA":
            continue
        above = root.rpartition("/")[0]
        inside = {p[len(root) + 1 :].lower(): c for p, c in by_path.items() if p.startswith(f"{root}/")}
        project = by_path.get(f"{above}/PROJECT" if above else "PROJECT")
        if "_vba_project" not in inside or project is None:
            continue
        for m in ovba.modules(by_path[path], inside, project):
            used.add(f"{root}/{m['stream']}".lower())
            yield n, f"{root}/{m['stream']}", m["file"], m["code"]
            n += 1
    import re

    for e, c in f.streams():  # compressed code that no project lists
        if (e.path or "").lower() in used or (e.path or "").lower().endswith(("/dir", "/_vba_project")):
            continue
        for m in re.finditer(rb"\x00Attribut[^e]", c):
            try:
                yield n, e.path or e.name, "", ovba.decompress(c[m.start() - 3 :]).decode("cp1252", "replace")
                n += 1
            except ValueError:
                continue


MACROS = "ordinal long, stream_path string, vba_filename string, code string"


def vba_modules(files: DataFrame) -> DataFrame:
    """file_id, ordinal, stream_path, vba_filename, code of compound files."""
    return generate(files, _project_modules, MACROS)


inner_ole = formats.inner_ole


def container_of(data: bytes) -> str:
    """container_type() of a file's bytes."""
    if data.startswith(cfb.MAGIC):
        return "PPT" if "powerpoint document".encode("utf-16-le") in data.lower() else "OLE"
    if data.startswith(b"PK\x03\x04"):
        return "OpenXML"
    if formats.is_xml(data) and formats.WORD_2003 in data:
        return "Word2003_XML"
    if formats.is_xml(data) and formats.FLAT_OPC in data:
        return "FlatOPC_XML"
    if formats.is_mhtml(data):
        return "MHTML"
    for start, kind in ((b"{\\rt", "RTF"), (b"ID", "SLK"), (bytes.fromhex("89504E470D0A1A0A"), "PNG"), (bytes.fromhex("E4525C7B8CD8A74DAEB15378D02996D3"), "OneNote"), (b"MZ", "PE")):
        if data.startswith(start):
            return kind
    return "Unknown" if not data or b"\0" in data else "Text"


def file_modules(data: bytes) -> Iterator[tuple]:
    """ordinal, stream_path, vba_filename and code of a file of any kind: modules of compound files in it, a text as it is, the macros of a SYLK sheet."""
    kind = container_of(data)
    if kind == "Text":
        yield 0, "", "", data.decode("utf-8", "replace")
    elif kind == "SLK":
        from ..operators.dde import sylk_lines

        lines = sylk_lines(data.decode("latin-1"))
        if lines:
            yield 0, "", "xlm_macro.txt", "\n".join(lines)
    yield from inner_modules(data)


def inner_modules(data: bytes) -> Iterator[tuple]:
    n = 0
    for inner in inner_ole(data):
        for _, *rest in _project_modules(inner):
            yield n, *rest
            n += 1


def macros(files: DataFrame, errors: bool = False) -> DataFrame:
    """file_id, ordinal, stream_path, vba_filename, code of all modules of compound files in files of any kind."""
    return generate(files, inner_modules, MACROS, errors=errors)


def sources(files: DataFrame, errors: bool = False) -> DataFrame:
    """macros(), and texts and SYLK sheets as code of their own."""
    return generate(files, file_modules, MACROS, errors=errors)


def all_code(modules: DataFrame) -> DataFrame:
    """file_id and the code of all modules, each with a line end, in order."""
    rows = modules.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "code"))).alias("m"))
    return rows.select("file_id", F.array_join(F.transform("m", lambda m: F.concat(m["code"], F.lit("\n"))), "").alias("code"))


# --- other formats ----------------------------------------------------------------------------


def rtf_objects(files: DataFrame) -> DataFrame:
    names = "start end is_ole is_package format_id class_name oledata_size filename src_path temp_path raw_md5 ole_md5 package_md5 clsid tags urls data".split()

    def read(data):
        for i, o in enumerate(formats.rtf_objects(data)):
            yield i, *[o[n] for n in names]

    return generate(files, read, "ordinal long, start long, end long, is_ole boolean, is_package boolean, format_id long, class_name string, oledata_size long, filename string, src_path string, temp_path string, raw_md5 string, ole_md5 string, package_md5 string, clsid string, tags array<string>, urls array<string>, data binary")


def rtf_fields(files: DataFrame) -> DataFrame:
    """file_id, ordinal, field of field instructions."""

    def read(data):
        found = [h for w, _, _, _, h in formats.rtf_destinations(data) if w == b"fldinst"]
        for i, h in enumerate(found):
            yield i, h.replace(b"\r", b"").replace(b"\n", b"").decode("ascii", "replace").strip()

    return generate(files, read, "ordinal long, field string")


def zip_parts(files: DataFrame) -> DataFrame:
    return generate(files, lambda d: formats.zip_parts(d), "part string, data binary, encrypted boolean, error string")


def xml_elements(files: DataFrame, tags: str | None = None) -> DataFrame:
    """file_id, seq, depth, tag, attributes, text; tags are chosen while reading."""
    return generate(files, lambda d: ((s, n, t, list(a.items()), x) for s, n, t, a, x in formats.xml_elements(d, tags)), "seq long, depth long, tag string, attributes map<string,string>, text string")


def docx_fields(files: DataFrame) -> DataFrame:
    """Fields of Word packages, Word XML files or single Word parts."""
    return generate(files, lambda d: enumerate(documents.word_xml_fields(d)), "ordinal long, field string")


def word_fields(streams: DataFrame) -> DataFrame:
    """DDE fields of Word streams. streams: file_id, stream."""
    return generate(streams.select("file_id", F.col("stream").alias("content")), lambda d: enumerate(formats.word_fields(d)), "ordinal long, field string")


def records(files: DataFrame, kind: str) -> DataFrame:
    """file_id, depth, pos, type, size, data of 'xls', 'xlsb' or 'ppt' records."""
    flat = {"xls": formats.biff8_records, "xlsb": formats.biff12_records}

    def read(data):
        if kind == "ppt":
            yield from ((d, p, t, s, b) for d, p, t, s, _, _, b in formats.ppt_records(data))
        else:
            yield from ((0, p, t, s, b) for p, t, s, b in flat[kind](data))

    return generate(files, read, "depth long, pos long, type long, size long, data binary")


def supbook_links(files: DataFrame) -> DataFrame:
    def read(data):
        for i, (_, kind, _, body) in enumerate(formats.biff8_records(data)):
            if kind == 430 and (x := formats.supbook_link(body)):
                yield i, *x

    return generate(files, read, "ordinal long, kind string, link string")


def flash(files: DataFrame) -> DataFrame:
    return generate(files, lambda d: formats.flash_objects(d), "pos long, signature string, version long, size long")


def mail_parts(files: DataFrame) -> DataFrame:
    return generate(files, lambda d: ((i, n, t, b, hashlib.md5(b).hexdigest()) for i, (n, t, b) in enumerate(formats.mail_parts(d))), "ordinal long, name string, content_type string, data binary, md5 string")


def packages(files: DataFrame) -> DataFrame:
    """file_id, name, src_path, temp_path, is_link, size, md5 of packages in compound files."""

    def read(data):
        for inner in inner_ole(data):
            for e, c in cfb.CompoundFile(inner).streams():
                if (e.path or e.name).rpartition("/")[2].lower() == "\x01ole10native":
                    p = formats.native_package(c)
                    yield p["filename"], p["src_path"], p["temp_path"], p["is_link"], len(p["data"]), hashlib.md5(p["data"]).hexdigest()

    return generate(files, read, "name string, src_path string, temp_path string, is_link boolean, size long, md5 string")


# --- whole files ------------------------------------------------------------------------------


def document_types(files: DataFrame) -> DataFrame:
    """file_id, document_type, is_xls, is_ppt."""

    def read(data):
        ole = cfb.CompoundFile(data) if data.startswith(cfb.MAGIC) else None
        yield documents.document_type(data), ole is not None and documents.is_excel_ole(ole), ole is not None and documents.is_powerpoint_ole(ole)

    return generate(files, read, "document_type string, is_xls boolean, is_ppt boolean")


def dde_links(files: DataFrame, mode: str = "exclude harmless", errors: bool = False) -> DataFrame:
    """file_id, ordinal, source, link: DDE links and fields of files of any kind. mode is for fields of Word packages and RTF."""
    from ..operators import dde

    rows = generate(files, lambda d: ((i, *x) for i, x in enumerate(documents.dde_links(d))), "ordinal long, source string, link string", errors=errors)
    if mode not in dde.MODES:
        raise ValueError(f"mode must be one of {dde.MODES}")
    fields = F.col("source").isin("docx", "rtf")
    keep = F.lit(True) if mode == "all" else dde.is_dde_field(F.col("link")) if mode == "dde" else ~dde.is_harmless_field(F.trim("link"))
    return rows.where(F.coalesce(~fields, F.lit(True)) | keep)


def external_relationships(files: DataFrame) -> DataFrame:
    """file_id, part, type, mode, target of packages, for operators.dde.relationships()."""
    rows = generate(files, documents.external_relationships, "part string, type string, target string")
    return rows.select("file_id", "part", "type", F.lit("External").alias("mode"), "target")


def embedded_objects(files: DataFrame, most: int = 255) -> DataFrame:
    """file_id, ordinal, out_name (the best safe name), is_link, size, md5, data, error of embedded files: to be saved as they are."""

    def read(data):
        for i, (name, source, temp, is_link, c, error) in enumerate(documents.embedded_objects(data)):
            yield i, formats.name_candidates(name, source, temp, most, i)[0], is_link, len(c), hashlib.md5(c).hexdigest(), c, error

    return generate(files, read, "ordinal long, out_name string, is_link boolean, size long, md5 string, data binary, error string")


def save_objects(rows: DataFrame, path: str) -> None:
    """Writes objects (file_id, ordinal, out_name, data) as Parquet, one folder for each first letter of a hash of their file."""
    rows.select("file_id", "ordinal", "out_name", "data", F.substring(F.md5(F.col("file_id").cast("string").cast("binary")), 1, 1).alias("shelf")).write.partitionBy("shelf").parquet(path)


def rtf_saved(objects: DataFrame) -> DataFrame:
    """file_id, ordinal, out_name, data: what saving RTF objects writes, one file an object. objects: of rtf_objects()."""
    at = F.upper(F.lpad(F.hex("start"), 8, "0"))
    ending = F.when(F.col("is_package"), F.lit(None)).when(F.col("is_ole"), F.when(F.hex(F.substring("data", 1, 8)) == "D0CF11E0A1B11AE1", ".doc").otherwise(".bin")).otherwise(".raw")
    safe = F.regexp_replace("filename", "[^a-zA-Z0-9._-]", "_")
    return objects.select("file_id", "ordinal", F.when(F.col("is_package"), F.concat_ws("_", F.lit("object"), at, safe)).otherwise(F.concat(F.lit("object_"), at, ending)).alias("out_name"), "data")


def persist_objects(files: DataFrame) -> DataFrame:
    """file_id, persist_id, offset of presentations."""
    return generate(files, lambda d: sorted(documents.persist_directory(cfb.CompoundFile(d)).items()), "persist_id long, offset long")


def storage_tree(files: DataFrame) -> DataFrame:
    """file_id, place, sid, depth, path, name, size, clsid of the root and all streams and storages, by path."""
    return generate(files, lambda d: ((i, *r) for i, r in enumerate(documents.storage_tree(d))), "place long, sid long, depth long, path string, name string, size long, clsid string")


def filetime_text(ticks: Column) -> Column:
    """100 ns since 1601 as 'yyyy-MM-dd HH:mm:ss'; null for null and 0."""
    seconds = (ticks - F.pmod(ticks, F.lit(10_000_000))) / 10_000_000 - 11_644_473_600
    return F.when(ticks > 0, F.date_format(F.timestamp_seconds(seconds.cast("long")), "yyyy-MM-dd HH:mm:ss"))


def macro_presence(files: DataFrame) -> DataFrame:
    """file_id, has_vba, has_xlm."""
    return generate(files, lambda d: [(documents.has_vba(d), documents.has_xlm(d))], "has_vba boolean, has_xlm boolean")


def form_strings(files: DataFrame) -> DataFrame:
    """file_id, storage, ordinal, string: of storages with both streams of a form."""

    def read(data):
        streams = {e.path: c for inner in inner_ole(data) for e, c in cfb.CompoundFile(inner).streams(orphans=False)}
        for storage in formats.form_storages(list(streams)):
            o = next(c for p, c in streams.items() if p.lower() == f"{storage}/o".lower())
            for i, text in enumerate(formats.form_strings(o)):
                yield storage, i, text

    return generate(files, read, "storage string, ordinal long, string string")


def flash_in_streams(files: DataFrame) -> DataFrame:
    """file_id, source, pos, signature, version, size, md5 of Flash objects in streams of compound files and in RTF objects."""

    def read(data):
        sources = [(e.path or e.name, c) for e, c in cfb.CompoundFile(data).streams()] if data.startswith(cfb.MAGIC) else [(f"object {i}", o["data"]) for i, o in enumerate(formats.rtf_objects(data))] if data[:4] == b"{\\rt" else [("", data)]
        for name, c in sources:
            for pos, signature, version, size in formats.flash_objects(c):
                yield name, pos, signature, version, size, hashlib.md5(c[pos : pos + size]).hexdigest()

    return generate(files, read, "source string, pos long, signature string, version long, size long, md5 string")


def zip_scan(files: DataFrame, password: str | None = None, pattern: str = "*") -> DataFrame:
    """file_id (archive and member), container, name, content, error of the members that fit a glob: files to scan further."""
    from fnmatch import fnmatch

    rows = generate(files, lambda d: ((n, c, e) for n, c, _, e in formats.zip_parts(d, password) if fnmatch(n, pattern)), "name string, content binary, error string")
    return rows.select(F.concat_ws("/", F.col("file_id").cast("string"), "name").alias("file_id"), F.col("file_id").cast("string").alias("container"), "name", "content", "error")
