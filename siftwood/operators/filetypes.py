"""File types by root CLSID, main part's content type or first bytes; other joins with small fixed tables."""

from __future__ import annotations

import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..sources import cfb, formats, tables


def file_type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.file_types(), "file_type string, long_name string, container string, application string, may_hold_macros string, key_kind string, key string")


def type_key(data: bytes) -> tuple[str, str]:
    """Container and the key that tells a file's type: the root's CLSID, or the main part's content type (by part, else by extension)."""
    if data.startswith(cfb.MAGIC):
        entries = cfb.CompoundFile(data.ljust(1536, b"\0")).entries
        return "OLE", (entries[0].clsid if entries else "")
    parts = {n: c for n, c, _, _ in formats.zip_parts(data, names={"_rels/.rels", "[Content_Types].xml"})}
    if not (parts.get("_rels/.rels") and parts.get("[Content_Types].xml")):
        return "Zip", ""
    targets = [a.get("Target", "") for _, _, _, a, _ in formats.xml_elements(parts["_rels/.rels"], "Relationship") if a.get("Type", "").endswith(("/officeDocument", "/fixedrepresentation"))]
    main = "/" + targets[0].lstrip("/") if targets else ""
    overrides, defaults = formats.content_types(parts["[Content_Types].xml"])
    return "OpenXML", overrides.get(main) or defaults.get(main.rpartition(".")[2].lower(), "")


_BY_KEY = {r[6]: r for r in V.file_types() if r[5] != "first bytes"}
_BY_START = [(bytes.fromhex(r[6]), r) for r in V.file_types() if r[5] == "first bytes"]
#: A type of one container whose key is not known.
GENERIC = {"OLE": ("Generic OLE", "Generic OLE file", "OLE", "unknown"), "OpenXML": ("Generic OpenXML", "Generic OpenXML file", "OpenXML", "unknown"), "Zip": ("Zip", "Zip archive", "Zip", "unknown")}


def type_of(data: bytes) -> tuple[str, str, str, str]:
    """Short name, long name, container and application of a file."""
    if data.startswith((cfb.MAGIC, b"PK\x03\x04")):
        try:
            container, key = type_key(data)
        except (ValueError, IndexError, struct.error, zipfile.BadZipFile):
            container, key = ("OLE" if data.startswith(cfb.MAGIC) else "Zip"), ""
        return _BY_KEY[key][:4] if key in _BY_KEY else GENERIC[container]
    return next((r[:4] for start, r in _BY_START if data.startswith(start)), ("unknown", "Unknown file type", "unknown", "unknown"))


def file_keys(files: DataFrame) -> DataFrame:
    """file_id, container and key of compound files and packages."""
    return tables.generate(files, lambda d: [type_key(d)] if d.startswith((cfb.MAGIC, b"PK\x03\x04")) else [], "container string, key string")


def predicates(types: DataFrame) -> DataFrame:
    """types (of file_types()) with is_ole, is_openxml, is_word, is_excel and is_powerpoint."""
    app = lambda name: F.coalesce(F.col("application") == name, F.lit(False))
    of = lambda name: F.coalesce(F.col("container") == name, F.lit(False))
    return types.withColumns({"is_ole": of("OLE"), "is_openxml": of("OpenXML"), "is_word": app("Word"), "is_excel": app("Excel"), "is_powerpoint": app("PowerPoint")})


def described_clsids(rows: DataFrame, known: DataFrame, clsid: str = "clsid") -> DataFrame:
    """rows with description of their CLSID (in any case; null if not known) and is_exploited (its description names a CVE). known: clsid, description, a small table."""
    small = F.broadcast(known.select(F.upper("clsid").alias("_known"), "description"))
    out = rows.join(small, F.upper(F.col(clsid)) == F.col("_known"), "left").drop("_known")
    return out.withColumn("is_exploited", F.coalesce(F.contains("description", F.lit("CVE")), F.lit(False)))


def code_pages(rows: DataFrame, names: DataFrame, code_page: str = "codepage") -> DataFrame:
    """rows with code_page_name ('Unknown code page' if not known) of a small table: codepage, name."""
    small = F.broadcast(names.select(F.col("codepage").alias("_page"), F.col("name").alias("code_page_name")))
    out = rows.join(small, F.col(code_page) == F.col("_page"), "left").drop("_page")
    return out.withColumn("code_page_name", F.coalesce("code_page_name", F.lit("Unknown code page")))


def file_types(files: DataFrame) -> DataFrame:
    """file_id, file_type, long_name, container, application, may_hold_macros; type 'unknown' where nothing tells."""
    types = F.broadcast(file_type_table(files.sparkSession))  # 25 rows
    by_key = types.where("key_kind <> 'first bytes'").drop("key_kind", "container")
    magic = types.where("key_kind = 'first bytes'").select("file_type", "long_name", "container", "application", "may_hold_macros", F.col("key").alias("magic"))
    inner = file_keys(files).join(by_key, "key", "left").select("file_id", F.coalesce("file_type", F.lit("unknown")).alias("file_type"), "long_name", "container", "application", "may_hold_macros")
    first = F.hex(F.substring("content", 1, 16))
    heads = files.where(~first.startswith("D0CF11E0A1B11AE1") & ~first.startswith("504B0304")).select("file_id", first.alias("first"))
    outer = heads.join(magic, F.col("first").startswith(F.col("magic")), "left").select("file_id", F.coalesce("file_type", F.lit("unknown")).alias("file_type"), "long_name", "container", "application", "may_hold_macros")
    return inner.unionByName(outer)


def named_records(rows: DataFrame, names: dict[int, str]) -> DataFrame:
    """records() with their types' names."""
    table = rows.sparkSession.createDataFrame(list(names.items()), "type long, type_name string")
    return rows.join(F.broadcast(table), "type", "left")


def stomped(code: DataFrame, pcode: DataFrame) -> DataFrame:
    """file_id, stomped: whether some name or string of the p-code text is missing from the source. code: file_id, code; pcode: file_id, pcode (a dump's text)."""
    lines = pcode.select("file_id", F.explode(F.split("pcode", "\r\n|\r|\n")).alias("line")).where(F.col("line").startswith("\t"))
    words = lines.select("file_id", F.regexp_extract("line", r"^\s*(\S+)", 1).alias("op"), F.trim(F.regexp_extract("line", r"^\s*\S+\s+(.*)$", 1)).alias("args"))
    name = F.regexp_extract(F.regexp_replace("args", r"^\(Call\) ", ""), r"^(\S+)", 1)
    text = F.regexp_extract("args", r"^\S+\s+(.*)$", 1)
    quoted = F.concat(F.lit('"'), F.replace(F.expr("substring(t, 2, length(t) - 2)"), F.lit('"'), F.lit('""')), F.lit('"'))
    keys = words.withColumn("t", text).select("file_id", F.when(F.col("op").isin("ArgsCall", "ArgsLd", "St", "Ld", "MemSt", "Label"), name).when((F.col("op") == "LitStr") & (F.length("t") >= 2), quoted).alias("key"))
    keys = keys.where("key <> '' and not startswith(key, 'id_')").groupBy("file_id").agg(F.collect_set(F.lower("key")).alias("keys"))  # a file's names, once
    low = F.lower("code")
    return code.join(keys, "file_id", "left").select("file_id", F.coalesce(F.exists("keys", lambda k: ~F.contains(low, k)), F.lit(False)).alias("stomped"))
