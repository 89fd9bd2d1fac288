"""Reports of a scan: a JSON document and a text for each file, coloured code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import macro_text as M
from . import macro_scan as S

#: What stands for signs that can't be shown, as hex of their code points.
UNSHOWN = r"[^\x20-\x7E\t\n\r\x0B\x0C]"


def scanned(modules: DataFrame, kinds: DataFrame, deobfuscate: bool = False, show_all: bool = False) -> DataFrame:
    """file_id, type, macros (array of vba_filename, ole_stream and code without leading attributes), code, findings (array of type, keyword, description), code_deobfuscated. modules: of tables.macros(); kinds: file_id, container."""
    one = F.struct("ordinal", F.col("vba_filename"), F.col("stream_path").alias("ole_stream"), "code")
    files = modules.groupBy("file_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    code = F.array_join(F.transform("m", lambda m: F.concat(m["code"], F.lit("\n"))), "")
    rows = S.decode_strings(files.select("file_id", "m", code.alias("code")), deobfuscate)
    found = F.transform(S.findings_in_rows(show_all), lambda x: F.struct(x["category"].alias("type"), x["keyword"].alias("keyword"), x["description"].alias("description")))
    macros = F.transform("m", lambda m: F.struct(m["vba_filename"].alias("vba_filename"), m["ole_stream"].alias("ole_stream"), F.trim(M.drop_attributes(m["code"])).alias("code")))
    revealed = S.revealed_code() if deobfuscate else F.lit(None).cast("string")
    out = rows.select("file_id", macros.alias("macros"), "code", found.alias("findings"), revealed.alias("code_deobfuscated"))
    return kinds.select("file_id", F.col("container").alias("type")).join(out, "file_id", "left")


def json_documents(rows: DataFrame, deobfuscate: bool = False) -> DataFrame:
    """file_id and json: file, type, json_conversion_successful, analysis, macros, code_deobfuscated, do_deobfuscate. rows: of scanned()."""
    none = F.array().cast("array<struct<vba_filename:string,ole_stream:string,code:string>>")
    document = F.struct(
        F.col("file_id").cast("string").alias("file"),
        F.lit(True).alias("json_conversion_successful"),
        F.col("findings").alias("analysis"),
        F.col("code_deobfuscated"),
        F.lit(deobfuscate).alias("do_deobfuscate"),
        F.col("type"),
        F.coalesce("macros", none).alias("macros"),
    )
    return rows.select("file_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def printable(text: Column) -> Column:
    """The text; if it has signs that can't be shown, all of it in quotes with those as code points."""
    escaped = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s)({UNSHOWN}|[^\\x00]|\\x00)"), F.lit(0)), lambda c: F.when(c.rlike(UNSHOWN), F.concat(F.lit("\\x"), F.lower(F.hex(F.encode(c, "UTF-8"))))).otherwise(c)), "")
    return F.when(M.is_printable(text), text).otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))


def analysis_text(rows: DataFrame) -> DataFrame:
    """file_id and analysis: a line for each finding, or that there is none. rows: of scanned()."""
    cell = lambda c, n: F.rpad(c, n, " ")
    lines = F.transform("findings", lambda x: F.concat(F.lit("|"), cell(x["type"], 14), F.lit("|"), printable(x["keyword"]), F.lit("|"), printable(x["description"])))
    return rows.select("file_id", F.when(F.size("findings") > 0, F.array_join(lines, "\n")).otherwise("No suspicious keyword or IOC found.").alias("analysis"))


def detailed(rows: DataFrame) -> DataFrame:
    """file_id and report: the file, its type, each module's code, and the findings. rows: of scanned()."""
    module = lambda m: F.concat(F.lit("VBA MACRO "), m["vba_filename"], F.lit(" \nin file: - OLE stream: "), m["ole_stream"], F.lit("\n"), F.when(m["code"] == "", "(empty macro)").otherwise(m["code"]))
    text = F.concat_ws("\n", F.concat(F.lit("FILE: "), F.col("file_id").cast("string")), F.concat(F.lit("Type: "), F.col("type")), F.when(F.size("macros") > 0, F.array_join(F.transform("macros", module), "\n")).otherwise("No VBA or XLM macros found."), F.col("analysis"))
    own = rows.select("file_id", "type", "macros", "findings")
    lines = F.transform("findings", lambda x: F.concat_ws(" | ", x["type"], printable(x["keyword"]), printable(x["description"])))
    return own.withColumn("analysis", F.when(F.size("findings") > 0, F.array_join(lines, "\n")).otherwise("No suspicious keyword or IOC found.")).select("file_id", text.alias("report"))


def coloured(code: Column, findings: Column) -> Column:
    """The code with colour marks around the keywords found; an escape sign is written out, so that code can't change the screen."""
    some = F.filter(findings, lambda x: x["type"].isin(*V.COLOURS))
    colour = F.create_map(*[F.lit(x) for pair in V.COLOURS.items() for x in pair])

    def mark(text: Column, x: Column) -> Column:
        c = F.try_element_at(colour, x["type"])
        return F.replace(F.replace(text, F.lit("\x1b"), F.lit("\\e")), x["keyword"], F.concat(F.lit("{auto"), c, F.lit("}"), x["keyword"], F.lit("{/"), c, F.lit("}")))

    return F.aggregate(some, code, mark)
