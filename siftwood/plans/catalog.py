"""The registered queries of the document operators, and their SQL.

Macro code, fields, cells and files are built from whole tables by the same rule on
both sides, so that DuckDB can work out the results from the tables alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import macro_text as M
from ..operators import dde, filetypes, verdict
from ..operators import macro_scan as S
from ..sources import cfb, formats, ovba, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived macro code -----------------------------------------------------------------

#: One module per part, in SQL of both engines; {b64} and {hex} stand for their functions' names.
CODE = """
'Attribute VB_Name = "Module1"' || chr(10) ||
CASE p_partkey % 7 WHEN 0 THEN 'Sub AutoOpen()' WHEN 1 THEN 'Sub Document_Open()' WHEN 2 THEN 'Private Sub ' || replace(p_name, ' ', '_') || '_Click()' WHEN 3 THEN 'Sub workbook_open()' ELSE 'Sub ' || replace(p_name, ' ', '_') || '()' END || chr(10) ||
CASE p_partkey % 5 WHEN 0 THEN ' Shell "' || replace(p_name, ' ', '_') || '.exe", vbHide' WHEN 1 THEN ' Open "' || p_name || '" _' || chr(10) || ' For Output As #1' WHEN 2 THEN ' Set o = CreateObject("WScript.Shell")' WHEN 3 THEN ' u = "http://' || replace(p_name, ' ', '-') || '.example.com:8080/x?id=' || p_partkey || '"' ELSE ' x = 1' END || chr(10) ||
CASE p_partkey % 4 WHEN 0 THEN ' h = "' || {hex} || '"' WHEN 1 THEN ' b = "' || {b64} || '"' WHEN 2 THEN ' ip = "10.' || p_size || '.0.1"' ELSE ' Print #1, 2' END || chr(10) ||
CASE p_partkey % 11 WHEN 0 THEN ' s = StrReverse("' || reverse(p_name) || '") & Chr(' || (65 + p_partkey % 26) || ')' ELSE ' s = "' || p_type || '"' END || chr(10) || 'End Sub'
"""
SPARK_CODE = CODE.format(hex="hex(p_brand || ' Kill Auto_Open')", b64="base64(cast(rpad('powershell ' || p_type, 19, '.') as binary))")
DUCK_CODE = CODE.format(hex="hex(p_brand || ' Kill Auto_Open')", b64="base64(rpad('powershell ' || p_type, 19, '.')::BLOB)")
DUCK_PARTS = f"SELECT p_partkey AS file_id, {DUCK_CODE} AS code FROM part"


def part_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("file_id"), F.expr(SPARK_CODE).alias("code"))


def document_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("code"))


DUCK_DOCUMENTS = "SELECT doc_id AS file_id, coalesce(text, '') AS code FROM documents"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _keyword_values() -> str:
    rows = []
    for category, keywords in (("AutoExec", M.AUTOEXEC), ("Suspicious", M.SUSPICIOUS)):
        for i, (description, pattern) in enumerate(keywords):
            p = pattern.replace("(?iU)", "(?i)").replace("\\ ", " ").replace("(?<!Could contain following functions: )", "")
            rows.append(f"({_q(category)}, {i}, {_q(p)}, {_q(description)})")
    return ", ".join(rows)


def _duck_pattern(p: str) -> str:
    return _q(p.replace("(?iU)", "(?i)"))


def raw_findings_sql(code: str) -> str:
    """CTEs up to raw(file_id, category, variant, ord, keyword, description) of files without Dridex strings."""
    hexes = f"SELECT file_id, unnest(regexp_extract_all(code, {_q(V.HEX_STRING)})) AS e, unnest(range(len(regexp_extract_all(code, {_q(V.HEX_STRING)})))) AS i FROM src"
    b64 = _q(f'"({V.BASE64_STRING})"')
    base = f"SELECT file_id, unnest(regexp_extract_all(code, {b64}, 1)) AS e, unnest(range(len(regexp_extract_all(code, {b64}, 1)))) AS i FROM src"
    white = ", ".join(_q(w) for w in V.BASE64_NOT)
    iocs = " UNION ALL ".join(f"SELECT file_id, variant, note, {k} AS kind, {_q(name)} AS pt, unnest(regexp_extract_all(code, {_duck_pattern(p)})) AS v, unnest(range(len(regexp_extract_all(code, {_duck_pattern(p)})))) AS i FROM vars" for k, (name, p) in enumerate(V.IOC_PATTERNS))
    noted = " UNION ALL ".join(f"SELECT DISTINCT file_id, 'Suspicious' AS category, 7 AS variant, {i} AS ord, {_q(word)} AS keyword, {_q(text)} AS description FROM {t}" for i, ((_, word, text), t) in enumerate(zip(S.DETECTED[:2], ("hx", "bs"), strict=True)))
    return f"""
src AS ({code}),
hx AS (SELECT file_id, e, min(i) AS i, try(decode(unhex(e))) AS d FROM ({hexes}) GROUP BY file_id, e),
bs AS (SELECT file_id, e, min(i) AS i, try(decode(from_base64(e))) AS d FROM ({base}) WHERE regexp_matches(e, {_q(V.NOT_HEX)}) AND lower(e) NOT IN ({white}) GROUP BY file_id, e),
vars AS (
  SELECT file_id, 0 AS variant, '' AS note, code FROM src WHERE code <> ''
  UNION ALL SELECT file_id, 1, ' (obfuscation: Hex)', string_agg(chr(10) || d, '' ORDER BY i) FROM hx GROUP BY file_id
  UNION ALL SELECT file_id, 2, ' (obfuscation: Hex+StrReverse)', string_agg(chr(10) || reverse(d), '' ORDER BY i) FROM hx JOIN src USING (file_id) WHERE lower(code) LIKE '%strreverse%' GROUP BY file_id
  UNION ALL SELECT file_id, 3, ' (obfuscation: StrReverse+Hex)', string_agg(chr(10) || try(decode(unhex(reverse(e)))), '' ORDER BY i) FROM hx JOIN src USING (file_id) WHERE lower(code) LIKE '%strreverse%' GROUP BY file_id
  UNION ALL SELECT file_id, 4, ' (obfuscation: Base64)', string_agg(chr(10) || d, '' ORDER BY i) FROM bs GROUP BY file_id
),
kw AS (SELECT * FROM (VALUES {_keyword_values()}) t(category, ord, pattern, description)),
ioc0 AS ({iocs}),
ioc1 AS (SELECT *, row_number() OVER (PARTITION BY file_id, variant ORDER BY kind, i) AS place, row_number() OVER (PARTITION BY file_id, variant, v ORDER BY kind, i) AS nth FROM ioc0 WHERE NOT starts_with(v, {_q(V.EXCLUDED_URLS[0])}) AND NOT starts_with(v, {_q(V.EXCLUDED_URLS[1])})),
raw AS (
  SELECT file_id, category, variant, ord, regexp_extract(code, pattern) AS keyword, description || note AS description FROM vars, kw WHERE regexp_matches(code, pattern)
  UNION ALL SELECT file_id, 'IOC', variant, place, v, pt || note FROM ioc1 WHERE nth = 1
  UNION ALL {noted}
)"""


FINDINGS_TAIL = """
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY rank, variant, ord)::INT AS ordinal, category AS type, keyword, description FROM (
  SELECT file_id, category, variant, ord, keyword, description, CASE category WHEN 'AutoExec' THEN 0 WHEN 'Suspicious' THEN 1 ELSE 2 END AS rank,
    row_number() OVER (PARTITION BY file_id, category, keyword ORDER BY variant, ord) AS nth FROM raw
  UNION ALL SELECT file_id, 'Hex String', 8, i, d, e, 3, 1 FROM hx WHERE NOT regexp_matches(d, '[^\\x20-\\x7E\\t\\n\\r\\x0B\\x0C]')
  UNION ALL SELECT file_id, 'Base64 String', 9, i, d, e, 3, 1 FROM bs WHERE NOT regexp_matches(d, '[^\\x20-\\x7E\\t\\n\\r\\x0B\\x0C]')
) WHERE nth = 1
"""
SUMMARY_TAIL = """
SELECT file_id, coalesce(h, 0)::BIGINT AS n_hex, coalesce(b, 0)::BIGINT AS n_base64, 0::BIGINT AS n_dridex, 0::BIGINT AS n_vba,
  coalesce(a, 0)::BIGINT AS n_autoexec, coalesce(s, 0)::BIGINT AS n_suspicious, coalesce(o, 0)::BIGINT AS n_iocs,
  'TXT:M' || CASE WHEN a > 0 THEN 'A' ELSE '-' END || CASE WHEN s > 0 THEN 'S' ELSE '-' END || CASE WHEN o > 0 THEN 'I' ELSE '-' END || CASE WHEN h > 0 THEN 'H' ELSE '-' END || CASE WHEN b > 0 THEN 'B' ELSE '-' END || '--' AS flags
FROM src LEFT JOIN (SELECT file_id, count(*) AS h FROM hx GROUP BY file_id) USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS b FROM bs GROUP BY file_id) USING (file_id)
LEFT JOIN (SELECT file_id, count(*) FILTER (WHERE category = 'AutoExec') AS a, count(*) FILTER (WHERE category = 'Suspicious') AS s, count(*) FILTER (WHERE category = 'IOC') AS o FROM raw GROUP BY file_id) USING (file_id)
"""


@query("t8_findings", f"WITH {raw_findings_sql(DUCK_PARTS)} {FINDINGS_TAIL}")
def t8_findings(spark, sf_dir):
    return S.findings(S.decode_strings(part_code(spark, sf_dir)))


@query("t9_summary", f"WITH {raw_findings_sql(DUCK_PARTS)} {SUMMARY_TAIL}")
def t9_summary(spark, sf_dir):
    return S.triage(S.decode_strings(part_code(spark, sf_dir)))


@query("k3_triage")
def k3_triage(spark, sf_dir):
    """Triage of every document's text as macro source. DuckDB's word bounds know ASCII alone; a test holds this against Python's."""
    return S.triage(S.decode_strings(document_code(spark, sf_dir)))


def _keywords_sql(category: str) -> str:
    return f"WITH src AS ({DUCK_PARTS}), kw AS (SELECT * FROM (VALUES {_keyword_values()}) t(category, ord, pattern, description)) SELECT file_id, ord::INT AS ord, regexp_extract(code, pattern) AS keyword, description FROM src, kw WHERE category = '{category}' AND regexp_matches(code, pattern)"


@query("t1_autoexec", _keywords_sql("AutoExec"))
def t1_autoexec(spark, sf_dir):
    return part_code(spark, sf_dir).select("file_id", F.inline(M.find_autoexec(F.col("code"), None, M.plain_tokens(F.col("code")))))


@query("t2_suspicious", _keywords_sql("Suspicious"))
def t2_suspicious(spark, sf_dir):
    return part_code(spark, sf_dir).select("file_id", F.inline(M.find_suspicious(F.col("code"), None, None, M.plain_tokens(F.col("code")))))


def _iocs_sql(src: str) -> str:
    each = " UNION ALL ".join(f"SELECT file_id, {k} AS kind, {_q(name)} AS pt, unnest(regexp_extract_all(code, {_duck_pattern(p)})) AS v, unnest(range(len(regexp_extract_all(code, {_duck_pattern(p)})))) AS i FROM src" for k, (name, p) in enumerate(V.IOC_PATTERNS))
    return f"WITH src AS ({src}), a AS ({each}), b AS (SELECT *, row_number() OVER (PARTITION BY file_id, v ORDER BY kind, i) AS nth FROM a WHERE NOT starts_with(v, {_q(V.EXCLUDED_URLS[0])}) AND NOT starts_with(v, {_q(V.EXCLUDED_URLS[1])})) SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY kind, i) - 1)::INT AS ord, v AS keyword, pt AS description FROM b WHERE nth = 1"


@query("t3_iocs", _iocs_sql(DUCK_DOCUMENTS))
def t3_iocs(spark, sf_dir):
    return document_code(spark, sf_dir).select("file_id", F.inline(M.find_iocs(F.col("code"))))


@query("t4_hex_strings", f"SELECT doc_id AS file_id, e AS encoded FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {_q(V.HEX_STRING)})) AS e FROM documents)")
def t4_hex(spark, sf_dir):
    return document_code(spark, sf_dir).select("file_id", F.inline(M.hex_strings(F.col("code")))).select("file_id", "encoded")


_B64 = _q(f'"({V.BASE64_STRING})"')


@query("t5_base64_strings", f"SELECT page_id AS file_id, e AS encoded FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, {_B64}, 1)) AS e FROM pages) WHERE regexp_matches(e, {_q(V.NOT_HEX)}) AND lower(e) NOT IN ({', '.join(_q(w) for w in V.BASE64_NOT)})")
def t5_base64(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.inline(M.base64_strings(F.coalesce("html", F.lit("")))))
    return pages.select("file_id", "encoded")


@query("t6_dridex_strings", "SELECT s_suppkey AS file_id, 'C3iY1epSRGe6q8g15xStVesdG717MAlg2H4hmV1vkL6Glnf0cknj' AS encoded, 'TMP' AS decoded FROM supplier")
def t6_dridex(spark, sf_dir):
    code = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit('x = "C3iY1epSRGe6q8g15xStVesdG717MAlg2H4hmV1vkL6Glnf0cknj" \' '), "s_name").alias("code"))
    return code.select("file_id", F.inline(M.dridex_strings(F.col("code"))))


EXPRESSION = "'x = Chr(' || (65 + p_partkey % 26) || ') & \"' || p_name || '\" & Chr(' || (97 + p_size % 26) || ' + 0)'"


@query("t7_expressions", f"SELECT p_partkey AS file_id, substr({EXPRESSION}, 5) AS encoded, chr((65 + p_partkey % 26)::INT) || p_name || chr((97 + p_size % 26)::INT) AS decoded FROM part")
def t7_expressions(spark, sf_dir):
    code = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.expr(EXPRESSION).alias("code"))
    return code.select("file_id", F.inline(S.expression_strings(F.col("code"))))


@query("t12_reveal", "SELECT p_partkey AS file_id, 'x = \"' || chr((65 + p_partkey % 26)::INT) || p_name || chr((97 + p_size % 26)::INT) || '\"' AS code FROM part")
def t12_reveal(spark, sf_dir):
    code = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.expr(EXPRESSION).alias("code"))
    return S.reveal(S.decode_strings(code, deobfuscate=True))


_A, _W, _X = (_duck_pattern(p) for p in (V.FLAG_AUTOEXEC, V.FLAG_WRITE, V.FLAG_EXECUTE))
_FLAGS = f"""SELECT file_id, a AS autoexec, w AS writes, x AS executes, CASE WHEN a <> '' THEN 'A' ELSE '-' END || CASE WHEN w <> '' THEN 'W' ELSE '-' END || CASE WHEN x <> '' THEN 'X' ELSE '-' END AS flags,
  a <> '' AND (w <> '' OR x <> '') AS suspicious, CASE WHEN a <> '' AND (w <> '' OR x <> '') THEN 'SUSPICIOUS' ELSE 'Macro OK' END AS verdict, CASE WHEN a <> '' AND (w <> '' OR x <> '') THEN 20 ELSE 2 END AS exit_code
FROM (SELECT file_id, regexp_extract(code, {_A}) AS a, regexp_extract(code, {_W}) AS w, regexp_extract(code, {_X}) AS x FROM ({DUCK_PARTS}))"""


@query("t13_flags", _FLAGS)
def t13_flags(spark, sf_dir):
    return S.flag_verdicts(part_code(spark, sf_dir))


@query("a3_global_verdict", f"SELECT max(exit_code)::INT AS exit_code, arg_max(verdict, exit_code) AS verdict, count(*)::BIGINT AS n_files FROM ({_FLAGS})")
def a3_global_verdict(spark, sf_dir):
    return verdict.worst(S.flag_verdicts(part_code(spark, sf_dir)))


@query("p1_drop_attributes", f"SELECT file_id, regexp_replace(code, '^(Attribute VB_[^:\\n]*\\n)+', '') AS code FROM ({DUCK_PARTS})")
def p1_drop_attributes(spark, sf_dir):
    return part_code(spark, sf_dir).select("file_id", M.drop_attributes(F.col("code")).alias("code"))


@query("p2_collapse_lines", f"SELECT file_id, replace(code, ' _' || chr(10), ' ') AS code FROM ({DUCK_PARTS})")
def p2_collapse_lines(spark, sf_dir):
    return part_code(spark, sf_dir).select("file_id", M.collapse_long_lines(F.col("code")).alias("code"))


@query("p3_printable", "SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '[^\\x20-\\x7E\\t\\n\\r\\x0B\\x0C]') AS printable FROM documents")
def p3_printable(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.is_printable(F.coalesce("text", F.lit(""))).alias("printable"))


@query("g43_hexdump", "SELECT c_custkey, (i * 16)::INT AS \"offset\", hex(substr(c_name, i * 16 + 1, 16)) AS hex, substr(c_name, i * 16 + 1, 16) AS shown FROM (SELECT c_custkey, c_name, unnest(range((length(c_name) + 15) // 16)) AS i FROM customer)")
def g43_hexdump(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(M.hexdump(F.col("c_name"))))


@query("k2_json", f"SELECT file_id, '{{\"file_id\":' || file_id || ',\"verdict\":\"' || verdict || '\",\"flags\":\"' || flags || '\"}}' AS json FROM ({_FLAGS})")
def k2_json(spark, sf_dir):
    return S.flag_verdicts(part_code(spark, sf_dir)).select("file_id", F.to_json(F.struct("file_id", "verdict", "flags")).alias("json"))


# --- fields, cells, SYLK ---------------------------------------------------------------------

FIELD = """CASE c_custkey % 8 WHEN 0 THEN 'DATE \\@ "dd MM" \\h' WHEN 1 THEN 'DDEAUTO c:\\cmd.exe "/k ' || c_name || '"' WHEN 2 THEN 'AUTHOR ' || c_mktsegment || ' \\* Upper' WHEN 3 THEN 'PAGE \\# 0 \\x' WHEN 4 THEN 'TITLE a b' WHEN 5 THEN ' dde excel ' || c_name WHEN 6 THEN 'SEQ ' || c_mktsegment || ' \\h' ELSE 'MACROBUTTON ' || c_name END"""
_DUCK_FIELD = f"SELECT c_custkey AS file_id, {FIELD} AS field FROM customer"


def fields(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.expr(FIELD.replace("\\", "\\\\")).alias("field"))


@query("p10_dde_fields", f"SELECT * FROM ({_DUCK_FIELD}) WHERE regexp_matches(field, {_q(V.FIELD_DDE)})")
def p10_dde_fields(spark, sf_dir):
    return dde.filter_fields(fields(spark, sf_dir), mode="dde")


@query("p11_harmless_fields", f"SELECT file_id, field, file_id % 8 IN (0, 2, 6) AS harmless FROM ({_DUCK_FIELD})")
def p11_harmless_fields(spark, sf_dir):
    return fields(spark, sf_dir).withColumn("harmless", dde.is_harmless_field(F.col("field")))


@query("p9_filter_fields", f"SELECT file_id, field FROM ({_DUCK_FIELD}) WHERE file_id % 8 NOT IN (0, 2, 6)")
def p9_filter_fields(spark, sf_dir):
    return dde.filter_fields(fields(spark, sf_dir))


@query("p12_unquote", "SELECT c_custkey AS file_id, chr((65 + c_custkey % 26)::INT) || chr(33) || 'x' AS plain FROM customer")
def p12_unquote(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), dde.unquote(F.concat(F.lit("QUOTE "), (65 + F.col("c_custkey") % 26).cast("string"), F.lit(" 33 x"))).alias("plain"))


CELL = "CASE s_suppkey % 3 WHEN 0 THEN '=cmd|' || chr(39) || '/k ' || s_name || chr(39) || '!A0' WHEN 1 THEN '@SUM(1+9)*cmd|' || chr(39) || '/c calc' || chr(39) || '!A' || s_suppkey ELSE s_name END"
_LINK = "regexp_matches(cell, '^\\s*\"?[=+-@](.+)[|](.+)!(.*)\\s*')"


@query("p15_formula_links", f"SELECT file_id, regexp_extract(cell, '^\\s*\"?[=+-@](.+)[|](.+)!(.*)\\s*', 1) || ' ' || regexp_extract(cell, '^\\s*\"?[=+-@](.+)[|](.+)!(.*)\\s*', 2) AS link FROM (SELECT s_suppkey AS file_id, {CELL} AS cell FROM supplier) WHERE {_LINK}")
def p15_formula_links(spark, sf_dir):
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.expr(CELL).alias("cell"))
    return cells.select("file_id", dde.formula_link(F.col("cell")).alias("link")).where("link is not null")


@query("g25_csv_dde", "SELECT s_suppkey AS file_id, 0 AS ordinal, 'cmd ''/k ' || s_name || '''' AS link FROM supplier")
def g25_csv_dde(spark, sf_dir):
    text = F.concat(F.lit("name,cell,note\nalpha,=cmd|'/k "), F.col("s_name"), F.lit("'!A0,one\nbeta,1,two\n"))
    return dde.csv_dde(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), text.alias("text")))


@query("s12_sylk", "SELECT s_suppkey AS file_id, n::INT AS ordinal, CASE n WHEN 1 THEN 'Named cell: Auto_open' WHEN 2 THEN 'Formula or Macro: EXEC(\"' || s_name || '\")' ELSE 'Formula or Macro: HALT()' END AS macro FROM supplier, range(1, 4) t(n) WHERE s_suppkey % 2 = 0")
def s12_sylk(spark, sf_dir):
    s = F.col("s_name")
    text = F.concat(F.lit("ID;P\r\nC;X9;Y9;EIGNORED()\r\n"), F.when(F.col("s_suppkey") % 2 == 0, "O;E\r\n").otherwise("O;L\r\n"), F.lit('NN;NAuto_open;ER1C1\r\nC;X1;Y1;EEXEC("'), s, F.lit('")\rC;X1;Y2;EHALT()\nE\n'))
    return dde.sylk_macros(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), text.alias("text")))


_RELS = "SELECT o_orderkey AS file_id, 'http://schemas.openxmlformats.org/officeDocument/2006/relationships/' || CASE o_orderkey % 3 WHEN 0 THEN 'oleObject' WHEN 1 THEN 'image' ELSE 'hyperlink' END AS type, CASE o_orderkey % 2 WHEN 0 THEN 'External' ELSE 'Internal' END AS mode, CASE o_orderkey % 5 WHEN 0 THEN 'MHTML:http://a' ELSE 'http://b/' || o_orderkey END AS target FROM orders"


@query("p7_relationships", f"SELECT file_id, regexp_extract(type, '[^/]*$') AS rel_type, target, CASE WHEN lower(target) LIKE 'mhtml:%' THEN 'CVE-2021-40444' END AS tag FROM ({_RELS}) WHERE mode = 'External' AND regexp_extract(type, '[^/]*$') IN ('oleObject', 'hyperlink')")
def p7_relationships(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("siftwood_orders")
    return dde.relationships(spark.sql(_RELS.replace("FROM orders", "FROM siftwood_orders")))


# --- files ---------------------------------------------------------------------------------------


def _files(rows: DataFrame, key: str, text: str, build: Callable[[int, str], bytes]) -> DataFrame:
    """file_id and content: one file per row, made by build(key, text)."""

    @F.arrow_udf("binary")
    def run(keys, texts):
        import pyarrow as pa

        return pa.array([build(k, t or "") for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True)], pa.binary())

    return tables.small_batches(rows).select(F.col(key).alias("file_id"), run(F.col(key), F.col(text)).alias("content"))


def document_files(spark, sf_dir, build):
    return _files(tables.spread(table(spark, sf_dir, "documents")), "doc_id", "text", build)


def part_files(spark, sf_dir, build):
    rows = part_code(spark, sf_dir)
    return _files(rows, "file_id", "code", build)


def supplier_files(spark, sf_dir, build):
    return _files(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", build)


@query("s5_ole_streams", "SELECT doc_id AS file_id, unnest(['A/text', 'copy']) AS path, strlen(coalesce(text, ''))::BIGINT AS size, md5(coalesce(text, '')) AS md5 FROM documents")
def s5_ole_streams(spark, sf_dir):
    files = document_files(spark, sf_dir, lambda k, t: cfb.write({"A/text": t.encode(), "copy": t.encode()}))
    return tables.ole_streams(files).select("file_id", "path", "size", F.md5("stream").alias("md5"))


@query("g37_ole_entries", "SELECT doc_id AS file_id, unnest(['Root', 'Storage', 'Stream', 'Stream']) AS kind, unnest(['<Used>', '<Used>', '<Used>', 'ORPHAN']) AS status, unnest(['Root Entry', 'A', 'text', 'lost']) AS name FROM documents")
def g37_ole_entries(spark, sf_dir):
    files = document_files(spark, sf_dir, lambda k, t: cfb.write({"A/text": t.encode(), "lost": b"x"}, orphans=("lost",)))
    return tables.ole_entries(files).where("kind <> 'Empty'").select("file_id", "kind", "status", "name")


@query("g39_ole_header", "SELECT s_suppkey AS file_id, 3::BIGINT AS major_version, 9::BIGINT AS sector_shift, 4096::BIGINT AS mini_cutoff FROM supplier")
def g39_ole_header(spark, sf_dir):
    rows = tables.ole_header(supplier_files(spark, sf_dir, lambda k, t: cfb.write({"a": t.encode()})))
    one = lambda n: F.max(F.when(F.col("attribute") == n, F.col("value"))).alias(n)
    return rows.groupBy("file_id").agg(one("major_version"), one("sector_shift"), one("mini_cutoff"))


@query("g40_ole_fat", "SELECT file_id, (s + 126) // 127 AS n_fat, s + (s + 126) // 127 AS n_used FROM (SELECT doc_id AS file_id, (greatest(strlen(coalesce(text, '')), 4096) + 511) // 512 + 1 AS s FROM documents)")
def g40_ole_fat(spark, sf_dir):
    files = document_files(spark, sf_dir, lambda k, t: cfb.write({"a": t.encode().ljust(4096, b" ")}))
    return tables.ole_fat(files).groupBy("file_id").agg(F.count_if(F.col("type") == "FAT Sector").alias("n_fat"), F.count_if(F.col("type") != "Free").alias("n_used"))


@query("g41_ole_metadata", "SELECT s_suppkey AS file_id, unnest(['codepage', 'title', 'num_pages']) AS property, unnest(['65001', s_name, s_nationkey::VARCHAR]) AS value FROM supplier")
def g41_ole_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("both", F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")))

    def build(k, t):
        name, _, n = t.rpartition("|")
        return cfb.write({"\x05SummaryInformation": formats.write_property_set({1: 65001, 2: name, 14: int(n)})})

    return tables.ole_metadata(_files(rows, "s_suppkey", "both", build))


@query("c3_ole_encrypted", "SELECT s_suppkey AS file_id, s_suppkey % 3 <> 0 AS encrypted FROM supplier")
def c3_ole_encrypted(spark, sf_dir):
    def build(k, t):
        return cfb.write([{"\x05SummaryInformation": b"x", "a": b"y"}, {"EncryptionInfo": b"x"}, {"WordDocument": bytes(11) + b"\x01" + bytes(20)}][k % 3])

    return tables.encrypted(supplier_files(spark, sf_dir, build)).drop("decryption")


def vba_file(k: int, code: str) -> bytes:
    return cfb.write(ovba.write_project({"Module1": code}))


@query("g4_vba_modules", f"SELECT file_id, 'Module1.bas' AS vba_filename, 'VBA/Module1' AS stream_path, code FROM ({DUCK_PARTS})")
def g4_vba_modules(spark, sf_dir):
    return tables.vba_modules(part_files(spark, sf_dir, vba_file)).select("file_id", "vba_filename", "stream_path", "code")


def office_file(k: int, code: str) -> bytes:
    """Macros in one of five kinds of containers."""
    import base64
    import io
    import zipfile

    ole = vba_file(k, code)
    if k % 5 == 0:
        return ole
    if k % 5 == 1:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("word/vbaProject.bin", ole)
        return out.getvalue()
    mime = base64.b64encode(formats.write_active_mime(ole)).decode()
    if k % 5 == 2:
        return f'<?xml version="1.0"?><w:wordDocument xmlns:w="http://schemas.microsoft.com/office/word/2003/wordml"><w:docSuppData><w:binData w:name="editdata.mso">{mime}</w:binData></w:docSuppData></w:wordDocument>'.encode()
    if k % 5 == 3:
        return f'<?xml version="1.0"?><pkg:package xmlns:pkg="http://schemas.microsoft.com/office/2006/xmlPackage"><pkg:part pkg:name="/word/vbaProject.bin" pkg:contentType="application/vnd.ms-office.vbaProject"><pkg:binaryData>{base64.b64encode(ole).decode()}</pkg:binaryData></pkg:part></pkg:package>'.encode()
    lines = "\n".join(mime[i : i + 76] for i in range(0, len(mime), 76))
    return f'MIME-Version: 1.0\nContent-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: application/x-mso\nContent-Transfer-Encoding: base64\nContent-Location: file:///C:/editdata.mso\n\n{lines}\n--b--\n'.encode()


@query("s4_container_types", f"SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'OLE' WHEN 1 THEN 'OpenXML' WHEN 2 THEN 'Word2003_XML' WHEN 3 THEN 'FlatOPC_XML' ELSE 'MHTML' END AS container FROM ({DUCK_PARTS})")
def s4_container_types(spark, sf_dir):
    return part_files(spark, sf_dir, office_file).select("file_id", tables.container_type().alias("container"))


@query("g9_all_code", f"SELECT file_id, code || chr(10) AS code FROM ({DUCK_PARTS})")
def g9_all_code(spark, sf_dir):
    """Macro code out of compound files, packages, Word XML, Flat OPC and MHTML."""
    return tables.all_code(tables.macros(part_files(spark, sf_dir, office_file)))


@query("t11_analyze_files", f"WITH {raw_findings_sql(DUCK_PARTS.replace(' AS code FROM', ' || chr(10) AS code FROM'))} {FINDINGS_TAIL}")
def t11_analyze_files(spark, sf_dir):
    """From files of five kinds to findings."""
    return S.findings(S.decode_strings(tables.all_code(tables.macros(part_files(spark, sf_dir, office_file)))))


def rtf_file(k: int, t: str) -> bytes:
    return formats.write_rtf_object(formats.write_ole1_object("Package", formats.write_package(f"f{k}.exe", f"C:\\f{k}.exe", f"C:\\t\\f{k}.tmp", t.encode(), sized=False)))


@query("g16_rtf_objects", "SELECT doc_id AS file_id, 'f' || doc_id || '.exe' AS filename, 'Package' AS class_name, md5(coalesce(text, '')) AS package_md5, 'EXECUTABLE FILE,MODIFIED FILE EXTENSION' AS tags FROM documents")
def g16_rtf_objects(spark, sf_dir):
    return tables.rtf_objects(document_files(spark, sf_dir, rtf_file)).select("file_id", "filename", "class_name", "package_md5", F.array_join("tags", ",").alias("tags"))


@query("g24_rtf_fields", "SELECT s_suppkey AS file_id, 0::BIGINT AS ordinal, 'DDEAUTO ' || s_name AS field FROM supplier")
def g24_rtf_fields(spark, sf_dir):
    return tables.rtf_fields(supplier_files(spark, sf_dir, lambda k, t: b"{\\rtf1 {\\field{\\*\\fldinst DDEAUTO\r\n " + t.encode() + b"}}}"))


@query("g18_packages", "SELECT doc_id AS file_id, 'f.exe' AS name, strlen(coalesce(text, ''))::BIGINT AS size, md5(coalesce(text, '')) AS md5 FROM documents")
def g18_packages(spark, sf_dir):
    files = document_files(spark, sf_dir, lambda k, t: cfb.write({"ObjectPool/_1/\x01Ole10Native": formats.write_package("f.exe", "a", "b", t.encode())}))
    return tables.packages(files).select("file_id", "name", "size", "md5")


@query("s6_zip_parts", "SELECT doc_id AS file_id, 'word/document.xml' AS part, md5(coalesce(text, '')) AS md5 FROM documents")
def s6_zip_parts(spark, sf_dir):
    def build(k, t):
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", t)
        return out.getvalue()

    return tables.zip_parts(document_files(spark, sf_dir, build)).select("file_id", "part", F.md5("data").alias("md5"))


@query("s15_xml_elements", "SELECT s_suppkey AS file_id, unnest([1, 2]) - 1 AS seq, 2 - 1 AS depth, '{urn:x}p' AS tag, unnest(['a', 'b']) AS id, unnest([s_name, 'k' || s_suppkey]) AS text FROM supplier")
def s15_xml_elements(spark, sf_dir):
    files = supplier_files(spark, sf_dir, lambda k, t: f'<d xmlns="urn:x"><p id="a">{t}</p><p id="b">k{k}</p><q/></d>'.encode())
    return tables.xml_elements(files, "p").select("file_id", F.col("seq").cast("int").alias("seq"), F.col("depth").cast("int").alias("depth"), "tag", F.col("attributes")["id"].alias("id"), "text")


@query("g22_docx_fields", "SELECT s_suppkey AS file_id, unnest([0::BIGINT, 1::BIGINT]) AS ordinal, unnest(['DDE ' || s_name, 'DATE']) AS field FROM supplier")
def g22_docx_fields(spark, sf_dir):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    files = supplier_files(spark, sf_dir, lambda k, t: f'<w:p {w}><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>DDE </w:instrText></w:r><w:r><w:instrText>{t}</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:fldSimple w:instr="DATE"/></w:p>'.encode())
    return tables.docx_fields(files)


@query("g20_word_fields", "SELECT s_suppkey AS file_id, 0::BIGINT AS ordinal, 'DDEAUTO ' || s_name || ' ' AS field FROM supplier")
def g20_word_fields(spark, sf_dir):
    files = supplier_files(spark, sf_dir, lambda k, t: b"text\x13DDEAUTO " + t.encode() + b" \x14result\x15 and \x13DATE\x15")
    return tables.word_fields(files.withColumnRenamed("content", "stream"))


@query("g28_biff8_records", "SELECT s_suppkey AS file_id, unnest([0::BIGINT, 20::BIGINT, (29 + length(s_name))::BIGINT]) AS pos, unnest([2057::BIGINT, 430::BIGINT, 10::BIGINT]) AS type FROM supplier")
def g28_biff8_records(spark, sf_dir):
    return tables.records(supplier_files(spark, sf_dir, xls_stream), "xls").select("file_id", "pos", "type")


def xls_stream(k: int, t: str) -> bytes:
    import struct

    book = struct.pack("<HHB", 0, len(t), 0) + t.encode("latin-1")
    return struct.pack("<HH", 2057, 16) + bytes(16) + struct.pack("<HH", 430, len(book)) + book + struct.pack("<HH", 10, 0)


@query("g21_supbook_links", "SELECT s_suppkey AS file_id, 'ole/dde' AS kind, s_name AS link FROM supplier")
def g21_supbook_links(spark, sf_dir):
    return tables.supbook_links(supplier_files(spark, sf_dir, xls_stream)).select("file_id", "kind", "link")


@query("g29_biff12_records", "SELECT s_suppkey AS file_id, unnest([129::BIGINT, 360::BIGINT]) AS type, unnest([0::BIGINT, (length(s_name) + 200)::BIGINT]) AS size FROM supplier")
def g29_biff12_records(spark, sf_dir):
    def build(k, t):
        n = len(t) + 200
        return bytes([0x81, 0x01, 0]) + bytes([0x80 | 360 & 0x7F, 360 >> 7, 0x80 | n & 0x7F, n >> 7]) + bytes(n)

    return tables.records(supplier_files(spark, sf_dir, build), "xlsb").select("file_id", "type", "size")


@query("g31_ppt_records", "SELECT s_suppkey AS file_id, unnest([0::BIGINT, 1::BIGINT]) AS depth, unnest([1000::BIGINT, 4022::BIGINT]) AS type, unnest([(length(s_name) + 8)::BIGINT, length(s_name)::BIGINT]) AS size FROM supplier")
def g31_ppt_records(spark, sf_dir):
    def build(k, t):
        import struct

        inner = struct.pack("<HHL", 0, 4022, len(t)) + t.encode()
        return struct.pack("<HHL", 15, 1000, len(inner)) + inner

    return tables.records(supplier_files(spark, sf_dir, build), "ppt").select("file_id", "depth", "type", "size")


@query("s11_ppt_macros", f"SELECT file_id, code FROM ({DUCK_PARTS})")
def s11_ppt_macros(spark, sf_dir):
    def build(k, t):
        import struct
        import zlib

        ole = vba_file(k, t)
        body = ole if k % 2 else struct.pack("<L", len(ole)) + zlib.compress(ole)
        record = struct.pack("<HHL", 0 if k % 2 else 0x10, 0x1011, len(body)) + body
        return cfb.write({"PowerPoint Document": b"lead" * 1100 + record, "Current User": b"x"})

    return tables.macros(part_files(spark, sf_dir, build)).select("file_id", "code")


@query("g35_flash", "SELECT s_suppkey AS file_id, 5::BIGINT AS pos, 'FWS' AS signature, (s_suppkey % 20)::BIGINT AS version, 1024::BIGINT AS size FROM supplier")
def g35_flash(spark, sf_dir):
    import struct

    return tables.flash(supplier_files(spark, sf_dir, lambda k, t: b"text:FWS" + bytes([k % 20]) + struct.pack("<l", 1024) + bytes(1100)))


@query("st1_mail_parts", "SELECT s_suppkey AS file_id, 'a.doc' AS name, md5(s_name) AS md5 FROM supplier")
def st1_mail_parts(spark, sf_dir):
    import base64

    files = supplier_files(spark, sf_dir, lambda k, t: f'From: a@example.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nhello\n--b\nContent-Type: application/msword\nContent-Disposition: attachment; filename="a.doc"\nContent-Transfer-Encoding: base64\n\n{base64.b64encode(t.encode()).decode()}\n--b--\n'.encode())
    return tables.mail_parts(files).where("name <> ''").select("file_id", "name", "md5")


@query("file_indicators", f"""WITH r AS ({_FLAGS}) SELECT file_id, unnest(['container', 'encrypted', 'vba', 'flash', 'object_pool']) AS id,
  unnest([CASE file_id % 5 WHEN 0 THEN 'OLE' WHEN 1 THEN 'OpenXML' WHEN 2 THEN 'Word2003_XML' WHEN 3 THEN 'FlatOPC_XML' ELSE 'MHTML' END, 'false', CASE WHEN suspicious THEN 'Yes, suspicious' ELSE 'Yes' END, '0', 'false']) AS value,
  unnest(['info', 'none', CASE WHEN suspicious THEN 'HIGH' ELSE 'Medium' END, 'none', 'none']) AS risk FROM r""")
def file_indicators(spark, sf_dir):
    rows = verdict.indicators(part_files(spark, sf_dir, office_file)).where(F.col("id").isin("container", "encrypted", "vba", "flash", "ObjectPool"))
    return rows.withColumn("id", F.when(F.col("id") == "ObjectPool", "object_pool").otherwise(F.col("id")))


def package(parts: dict[str, str | bytes], flag: bool = False) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    data = bytearray(out.getvalue())
    if flag:  # marks the first member as encrypted, in both of its headers
        data[6] |= 1
        data[data.find(b"PK\x01\x02") + 8] |= 1
    return bytes(data)


@query("s3_file_types", """SELECT p_partkey AS file_id, CASE p_partkey % 6 WHEN 0 THEN 'Word97' WHEN 1 THEN 'DOCM' WHEN 2 THEN 'XLSX' WHEN 3 THEN 'RTF' WHEN 4 THEN 'EXE' ELSE 'unknown' END AS file_type,
  CASE p_partkey % 6 WHEN 0 THEN 'OLE' WHEN 1 THEN 'OpenXML' WHEN 2 THEN 'OpenXML' WHEN 3 THEN 'RTF' WHEN 4 THEN 'PE' END AS container, CASE p_partkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'no' WHEN 4 THEN 'no' END AS may_hold_macros FROM part""")
def s3_file_types(spark, sf_dir):
    rels = '<Relationships><Relationship Id="1" Type="http://x/officeDocument" Target="{}"/></Relationships>'

    def build(k, t):
        kind = k % 6
        if kind == 0:
            return cfb.write({"WordDocument": t.encode()}, clsid=bytes.fromhex("0609020000000000C000000000000046"))
        if kind == 1:
            return package({"_rels/.rels": rels.format("word/document.xml"), "[Content_Types].xml": '<Types><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.ms-word.document.macroEnabled.main+xml"/></Types>'})
        if kind == 2:
            return package({"_rels/.rels": rels.format("/xl/workbook.xml"), "[Content_Types].xml": '<Types><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>'})
        return [b"{\\rtf1 ", b"MZ", b"none "][kind - 3] + t.encode()

    files = _files(table(spark, sf_dir, "part"), "p_partkey", "p_name", build)
    return filetypes.file_types(files).select("file_id", "file_type", "container", "may_hold_macros")


@query("j11_record_names", "SELECT s_suppkey AS file_id, unnest(['BOF', 'SupBook', 'EOF']) AS type_name FROM supplier")
def j11_record_names(spark, sf_dir):
    return filetypes.named_records(tables.records(supplier_files(spark, sf_dir, xls_stream), "xls"), formats.BIFF8_NAMES).select("file_id", "type_name")


@query("g14_stomping", "SELECT s_suppkey AS file_id, s_suppkey % 2 = 1 AS stomped FROM supplier")
def g14_stomping(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), "s_name")
    code = base.select("file_id", F.concat(F.lit('Sub A()\nMsgBox "say ""'), "s_name", F.lit('"""\n'), F.when(F.col("file_id") % 2 == 0, "Shell x\n").otherwise("")).alias("code"))
    pcode = base.select("file_id", F.concat(F.lit('Line #1:\n\tLitStr 0x0005 "say "'), "s_name", F.lit('""\n\tArgsCall (Call) MsgBox 0x1\n\tArgsCall Shell 0x0001\n\tLd id_FFFF\n')).alias("pcode"))
    return filetypes.stomped(code, pcode)


@query("c2_zip_encrypted", "SELECT s_suppkey AS file_id, 'a.xml' AS part, s_suppkey % 2 = 0 AS encrypted, s_suppkey % 2 = 1 AS readable FROM supplier")
def c2_zip_encrypted(spark, sf_dir):
    rows = tables.zip_parts(supplier_files(spark, sf_dir, lambda k, t: package({"a.xml": t}, flag=k % 2 == 0)))
    return rows.select("file_id", "part", "encrypted", F.col("data").isNotNull().alias("readable"))


@query("g23_xlsx_links", "SELECT s_suppkey AS file_id, 0::BIGINT AS ordinal, 'cmd ' || s_name AS link FROM supplier")
def g23_xlsx_links(spark, sf_dir):
    files = supplier_files(spark, sf_dir, lambda k, t: f'<externalLink xmlns="urn:x"><ddeLink ddeService="cmd" ddeTopic="{t}"/></externalLink>'.encode())
    return tables.generate(files, lambda d: enumerate(formats.xlsx_links(d)), "ordinal long, link string")


@query("g11_form_strings", "SELECT s_suppkey AS file_id, 0::BIGINT AS ordinal, s_name AS string FROM supplier")
def g11_form_strings(spark, sf_dir):
    files = supplier_files(spark, sf_dir, lambda k, t: cfb.write({"Macros/UserForm1/o": b"\0\1Tahoma\0\2" + t.encode() + b"\0abc\0", "Macros/UserForm1/f": b"x"}))
    o = tables.ole_streams(files).where(F.col("path").endswith("/o"))
    return tables.generate(o.select("file_id", F.col("stream").alias("content")), lambda d: enumerate(formats.form_strings(d)), "ordinal long, string string")


@query("document_variables", "SELECT s_suppkey AS file_id, 'v' || s_suppkey AS name, s_name AS value FROM supplier")
def document_variables(spark, sf_dir):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    files = supplier_files(spark, sf_dir, lambda k, t: f'<w:settings {w}><w:docVars><w:docVar w:name="v{k}" w:val="{t}"/></w:docVars></w:settings>'.encode())
    return tables.generate(files, formats.document_variables, "name string, value string")


@query("f14_file_names", "SELECT s_suppkey AS file_id, unnest([0::BIGINT, 1::BIGINT]) AS place, unnest([replace(s_name, '#', '_') || '.exe', 'x.longer']) AS name FROM supplier")
def f14_file_names(spark, sf_dir):
    rows = tables.generate(supplier_files(spark, sf_dir, lambda k, t: t.encode()), lambda d: enumerate(formats.name_candidates("", f"C:\\dir\\{d.decode()}.exe", "/tmp/x.longer", 128, 1)), "place long, name string")
    return rows.where("place < 2")


@query("p8_custom_ui", "SELECT s_suppkey AS file_id, s_name AS on_load, 'CVE-2021-42292' AS tag FROM supplier")
def p8_custom_ui(spark, sf_dir):
    files = supplier_files(spark, sf_dir, lambda k, t: f'<customUI xmlns="http://schemas.microsoft.com/office/2006/01/customui" onLoad="{t}"><ribbon/></customUI>'.encode())
    return tables.xml_elements(files, "customUI").where("attributes['onLoad'] is not null").select("file_id", F.col("attributes")["onLoad"].alias("on_load"), F.lit("CVE-2021-42292").alias("tag"))


def queries() -> dict:
    from . import file_catalog  # noqa: F401  (registers its queries)

    return dict(QUERIES)


def oracle_sql() -> dict:
    from . import file_catalog  # noqa: F401

    return dict(ORACLE)
