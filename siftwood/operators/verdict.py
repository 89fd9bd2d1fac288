"""Verdicts over files: indicators with risks, the worst result of many, return codes of a run."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import macro_text as M
from ..sources import cfb, documents, formats, tables
from . import filetypes


def worst(verdicts: DataFrame) -> DataFrame:
    """exit_code, verdict, n_files: the worst of all. verdicts: of flag_verdicts()."""
    return verdicts.agg(F.max("exit_code").cast("int").alias("exit_code"), F.max_by("verdict", "exit_code").alias("verdict"), F.count("*").alias("n_files"))


def batch_code(codes: DataFrame) -> DataFrame:
    """return_code of a run over files, from file_id, ordinal and return_code of each: the first that is not OK, or that of several errors."""
    bad = F.col("return_code") != V.RETURN_CODES["OK"]
    found = codes.agg(F.count_if(bad).alias("n"), F.min_by(F.when(bad, F.col("return_code")), F.when(bad, F.col("ordinal"))).alias("first"))
    return found.select(F.when(F.col("n") == 0, V.RETURN_CODES["OK"]).when(F.col("n") == 1, F.col("first")).otherwise(V.RETURN_CODES["SEVERAL_ERRORS"]).cast("int").alias("return_code"))


def object_code(objects: DataFrame) -> DataFrame:
    """file_id and bits: whether objects or external links were found, whether a stream failed. objects: of embedded_objects()."""
    bit = F.when(F.col("error").isNotNull(), V.STREAM_ERROR).otherwise(V.SAVED)
    return objects.groupBy("file_id").agg(F.bit_or(bit).cast("int").alias("return_code"))


PROFILE = "ftype string, container string, is_ole boolean, appname string, codepage long, author string, encrypted boolean, has_vba boolean, code string, has_xlm boolean, ext_rels long, ext_types array<string>, object_pool boolean, flash long"


def _profile(data: bytes):
    short, long_name, container, app = filetypes.type_of(data)
    kind = tables.container_of(data)
    ole = cfb.CompoundFile(data) if data.startswith(cfb.MAGIC) else None
    streams = ole.streams(orphans=False) if ole else []
    try:
        meta = next((formats.property_set(c) for e, c in streams if e.path == "\x05SummaryInformation"), {})
    except (ValueError, struct.error):
        meta = {}
    text = lambda k: meta[k] if isinstance(meta.get(k), str) else None
    code = None
    if kind != "RTF":
        rows = list(tables.file_modules(data))
        code = "".join(r[3] + "\n" for r in rows) if rows or documents.has_vba(data) else None
    known = {t.rpartition("/")[2] for t in V.RELATIONSHIP_TYPES}
    outer = [t.rpartition("/")[2] for _, t, _ in documents.external_relationships(data)]
    outer = [t for t in outer if t in known]
    flash = sum(len(formats.flash_objects(c)) for _, c in streams)
    pool = any((e.path or "") == "ObjectPool" or (e.path or "").startswith("ObjectPool/") for e in ole.entries) if ole else False
    yield long_name, kind, ole is not None, text(18), meta.get(1) if isinstance(meta.get(1), int) else None, text(4), documents.is_encrypted(data), code is not None, code, app == "Excel" and documents.has_xlm(data), len(outer), sorted(set(outer)), pool, flash


def profiles(files: DataFrame) -> DataFrame:
    """file_id and PROFILE: all that the indicators need, read in one pass over each file."""
    return tables.generate(files, _profile, PROFILE)


def indicators(files: DataFrame, code_page_names: DataFrame | None = None) -> DataFrame:
    """file_id, id, value, risk: what a file is and holds, one row each; application, code page and author for compound files alone. Nothing is shuffled. code_page_names: codepage, name, a small table."""
    rows = profiles(files).withColumn("suspicious", F.when(F.col("has_vba"), M.is_suspicious(F.col("code"))))
    rows = filetypes.code_pages(rows, code_page_names) if code_page_names is not None else rows.withColumn("code_page_name", F.lit("Unknown code page"))
    s = F.col("suspicious")

    def one(name, value, risk):
        return F.struct(F.lit(name).alias("id"), value.cast("string").alias("value"), (F.lit(risk) if isinstance(risk, str) else risk).alias("risk"))

    own = F.array(one("appname", F.col("appname"), "info"), one("codepage", F.concat("codepage", F.lit(": "), "code_page_name"), "info"), one("author", F.col("author"), "info"))
    each = F.concat(
        F.array(one("ftype", F.col("ftype"), "info"), one("container", F.col("container"), "info")),
        F.when(F.col("is_ole"), own).otherwise(F.array().cast("array<struct<id:string,value:string,risk:string>>")),
        F.array(
            one("encrypted", F.col("encrypted"), F.when(F.col("encrypted"), "low").otherwise("none")),
            one("vba", F.when(s, "Yes, suspicious").when(F.col("has_vba"), "Yes").otherwise("No"), F.when(s, "HIGH").when(F.col("has_vba"), "Medium").otherwise("none")),
            one("xlm", F.when(F.col("has_xlm"), "Yes").otherwise("No"), F.when(F.col("has_xlm"), "Medium").otherwise("none")),
            one("ext_rels", F.col("ext_rels"), F.when(F.col("ext_rels") > 0, "HIGH").otherwise("none")),
            one("ObjectPool", F.col("object_pool"), F.when(F.col("object_pool"), "low").otherwise("none")),
            one("flash", F.col("flash"), F.when(F.col("flash") > 0, "Medium").otherwise("none")),
        ),
    )
    return rows.select("file_id", F.inline(each))


#: Indicators that are shown whatever their value.
ALWAYS = ("encrypted", "vba", "xlm", "ext_rels")


def shown(rows: DataFrame) -> DataFrame:
    """Indicators without those that say nothing: null, false or 0, unless they are always shown."""
    return rows.where(F.col("id").isin(*ALWAYS) | F.coalesce(~F.col("value").isin("false", "0", ""), F.lit(False)))


def external_types(rows: DataFrame) -> DataFrame:
    """file_id, n, types (sorted, distinct) of external relationships. rows: of operators.dde.relationships()."""
    return rows.groupBy("file_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("rel_type")).alias("types"))
