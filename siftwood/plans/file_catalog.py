"""Registered queries over whole files of many layouts, and their SQL. Files are built from whole tables by one rule on both sides."""

from __future__ import annotations

import base64
import struct

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import dde, filetypes, report, verdict
from ..operators import macro_scan as S
from ..sources import cfb, formats, ovba, tables
from ..streaming import mail
from .catalog import _files, package, query, table, vba_file

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{}</Types>'
OVERRIDE = '<Override PartName="/{}" ContentType="{}"/>'
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
EXCEL_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
POWER_TYPE = "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"


def customer_files(spark, sf_dir, build):
    return _files(tables.spread(table(spark, sf_dir, "customer")), "c_custkey", "c_name", build)


def _field(text: str, n: int) -> str:
    run = lambda x: f"<w:r>{x}</w:r>"
    mark = lambda k: run(f'<w:fldChar w:fldCharType="{k}"/>')
    inner = mark("begin") + run(f"<w:instrText>QUOTE 68 68 {n} x</w:instrText>") + mark("end")
    return f"<w:p>{mark('begin')}{run(f'<w:instrText>DDE {text} </w:instrText>')}{inner}{mark('end')}</w:p>"


def _supbook(text: str) -> bytes:
    body = struct.pack("<HHB", 0, len(text), 0) + text.encode("latin-1")
    return struct.pack("<HH", 2057, 16) + bytes(16) + struct.pack("<HH", 430, len(body)) + body + struct.pack("<HH", 10, 0)


def _supbook12(*texts: str) -> bytes:
    body = struct.pack("<H", 1) + b"".join(struct.pack("<L", len(t)) + t.encode("utf-16-le") for t in texts)
    return bytes([0x80 | 360 & 0x7F, 360 >> 7, len(body) & 0x7F | 0x80, len(body) >> 7]) + body


def dde_file(k: int, t: str) -> bytes:
    kind = k % 9
    if kind == 0:  # the inner field's 8364 is a euro sign
        return package({"[Content_Types].xml": TYPES.format(OVERRIDE.format("word/document.xml", WORD_TYPE)), "word/document.xml": f'<w:document {WORD}>{_field(t, 8364)}<w:p><w:fldSimple w:instr="DATE"/></w:p></w:document>'})
    if kind == 1:
        return package({"[Content_Types].xml": TYPES.format(OVERRIDE.format("xl/workbook.xml", EXCEL_TYPE)), "xl/externalLinks/externalLink1.xml": f'<externalLink xmlns="urn:x"><ddeLink ddeService="cmd" ddeTopic="{t}"/></externalLink>'})
    if kind == 2:
        return package({"[Content_Types].xml": TYPES.format(OVERRIDE.format("xl/workbook.bin", "application/vnd.ms-excel.sheet.binary.macroEnabled.main")), "xl/externalLinks/externalLink1.bin": b"\x81\x01\x00" + _supbook12("cmd", t)})
    if kind == 3:
        return cfb.write({"Workbook": _supbook(f"cmd\x03{t}")})
    if kind == 4:
        return cfb.write({"WordDocument": b"text\x13DDEAUTO " + t.encode() + b" \x14result\x15", "1Table": b"x"})
    if kind == 5:
        return b"{\\rtf1 {\\field{\\*\\fldinst DDEAUTO " + t.encode() + b"}}{\\field{\\*\\fldinst DATE }}}"
    if kind == 6:
        return f'<?xml version="1.0"?><?mso-application progid="Excel.Sheet"?><Workbook xmlns="urn:s" xmlns:ss="urn:s"><Cell ss:Formula="=cmd|{t}!A0"/><Cell ss:Formula="=SUM(A1)"/></Workbook>'.encode()
    if kind == 7:
        return f'<?xml version="1.0"?><?mso-application progid="Word.Document"?><w:wordDocument xmlns:w="http://schemas.microsoft.com/office/word/2003/wordml">{_field(t, 33)}</w:wordDocument>'.encode()
    return f"name,cell,note\nalpha,=cmd|'/k {t}'!A0,one\nbeta,1,two\n".encode()


@query("g27_dde_files", """SELECT c_custkey AS file_id, CASE c_custkey % 9 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'xls' WHEN 4 THEN 'doc' WHEN 5 THEN 'rtf' WHEN 6 THEN 'excel-xml' WHEN 7 THEN 'word-xml' ELSE 'csv' END AS source,
  CASE c_custkey % 9 WHEN 0 THEN 'DDE ' || c_name || ' DD' || chr(8364) || 'x' WHEN 1 THEN 'cmd ' || c_name WHEN 2 THEN 'cmd ' || c_name WHEN 3 THEN 'cmd ' || c_name WHEN 4 THEN 'DDEAUTO ' || c_name || ' ' WHEN 5 THEN 'DDEAUTO ' || c_name WHEN 6 THEN 'cmd ' || c_name WHEN 7 THEN 'DDE ' || c_name || ' DD!x' ELSE 'cmd ''/k ' || c_name || '''' END AS link FROM customer""")
def g27_dde_files(spark, sf_dir):
    """Nine kinds of files; harmless fields are left out."""
    return tables.dde_links(customer_files(spark, sf_dir, dde_file)).select("file_id", "source", "link")


@query("g26_excel_xml_dde", "SELECT c_custkey AS file_id, 0::BIGINT AS ordinal, 'cmd ' || c_name AS link FROM customer WHERE c_custkey % 2 = 0")
def g26_excel_xml_dde(spark, sf_dir):
    build = lambda k, t: f'<?mso-application progid="Excel.Sheet"?><Workbook><Cell formula="{"=" if k % 2 == 0 else ""}cmd|{t}!A0"/></Workbook>'.encode()
    return tables.dde_links(customer_files(spark, sf_dir, build)).select("file_id", "ordinal", "link")


@query("s14_document_types", "SELECT c_custkey AS file_id, CASE c_custkey % 8 WHEN 0 THEN 'word' WHEN 1 THEN 'excel' WHEN 2 THEN 'powerpoint' WHEN 3 THEN 'mixed' WHEN 4 THEN 'none' WHEN 5 THEN 'word-xml' WHEN 6 THEN 'excel-xml' END AS document_type FROM customer")
def s14_document_types(spark, sf_dir):
    def build(k, t):
        some = {0: [WORD_TYPE], 1: [EXCEL_TYPE, "image/png"], 2: [POWER_TYPE], 3: [WORD_TYPE, POWER_TYPE], 4: ["image/png"]}.get(k % 8)
        if some:
            return package({"[Content_Types].xml": TYPES.format("".join(OVERRIDE.format("a", x) for x in some)), "a": t})
        return [f'<?mso-application progid="Word.Document"?><d>{t}</d>', f'<?mso-application progid="Excel.Sheet"?><d>{t}</d>', f"no markup {t}"][k % 8 - 5].encode()

    return tables.document_types(customer_files(spark, sf_dir, build)).select("file_id", "document_type")


def ppt_file(k: int, t: str, edits: int = 2) -> bytes:
    """A presentation with a chain of edits: the older one places object 1 too, and object 2 alone."""
    record = lambda version, kind, body: struct.pack("<HHL", version, kind, len(body)) + body
    main = record(15, 0x03E8, record(0, 4022, t.encode()))
    last = 0
    for i in range(edits):
        directory = len(main)
        entries = struct.pack("<LL", 1 | 1 << 20, 100 * i + k) if i else struct.pack("<LLL", 1 | 2 << 20, 50 + k, 60 + k)
        main += record(0, 0x1772, entries)
        at = len(main)
        main += record(0, 0x0FF5, struct.pack("<LHBBLLLLHH", 256, 0, 0, 3, last, directory, 1, 3, 1, 0))
        last = at
    return cfb.write({"PowerPoint Document": main, "Current User": record(0, 0x0FF6, struct.pack("<LLL", 20, 0xE391C05F, last) + bytes(20))})


@query("s24_is_xls_ppt", "SELECT c_custkey AS file_id, c_custkey % 3 = 0 AS is_xls, c_custkey % 3 = 1 AS is_ppt FROM customer")
def s24_is_xls_ppt(spark, sf_dir):
    build = lambda k, t: cfb.write({"Book" if k % 2 else "Workbook": _supbook(t)}) if k % 3 == 0 else ppt_file(k, t) if k % 3 == 1 else cfb.write({"PowerPoint Document": t.encode()})
    return tables.document_types(customer_files(spark, sf_dir, build)).select("file_id", "is_xls", "is_ppt")


@query("j5_persist_objects", "SELECT c_custkey AS file_id, unnest([1, 2])::BIGINT AS persist_id, unnest([50 + c_custkey, 60 + c_custkey])::BIGINT AS \"offset\" FROM customer")
def j5_persist_objects(spark, sf_dir):
    """The chain of edits is followed from the newest; what is read later counts."""
    return tables.persist_objects(customer_files(spark, sf_dir, ppt_file))


KEYS = [r for r in V.FILE_TYPES if r[5] == "clsid"] + [r for r in V.FILE_TYPES if r[5] == "content type"] + [r for r in V.FILE_TYPES if r[5] == "first bytes"]


def typed_file(k: int, t: str) -> bytes:
    """A file of each known type in turn."""
    _, _, _, _, _, how, key = KEYS[k % len(KEYS)]
    if how == "clsid":
        a, b, c, d, e = key.split("-")
        return cfb.write({"a": t.encode()}, clsid=struct.pack("<LHH", int(a, 16), int(b, 16), int(c, 16)) + bytes.fromhex(d + e))
    if how == "content type":
        rels = '<Relationships><Relationship Id="1" Type="http://x/officeDocument" Target="main.bin"/></Relationships>'
        return package({"_rels/.rels": rels, "[Content_Types].xml": TYPES.format(OVERRIDE.format("main.bin", key)), "main.bin": t})
    return bytes.fromhex(key) + t.encode()


_TYPE_VALUES = ", ".join(f"({i}, '{r[0]}', '{r[2]}', '{r[3]}')" for i, r in enumerate(KEYS))


@query("s3f_predicates", f"SELECT c_custkey AS file_id, name AS file_type, container = 'OLE' AS is_ole, container = 'OpenXML' AS is_openxml, app = 'Word' AS is_word, app = 'Excel' AS is_excel, app = 'PowerPoint' AS is_powerpoint FROM customer JOIN (VALUES {_TYPE_VALUES}) v(i, name, container, app) ON c_custkey % {len(KEYS)} = i")
def s3f_predicates(spark, sf_dir):
    """Every known type."""
    rows = filetypes.predicates(filetypes.file_types(customer_files(spark, sf_dir, typed_file)))
    return rows.select("file_id", "file_type", "is_ole", "is_openxml", "is_word", "is_excel", "is_powerpoint")


# --- RTF and embedded objects ------------------------------------------------------------


def tagged_rtf(k: int, t: str) -> bytes:
    kind = k % 6
    if kind < 4:
        name, temp = [("a.txt", "C:\\t\\a.exe"), ("noext", "C:\\t\\noext2"), ("b.gadget", "C:\\t\\b.gadget"), ("c.TXT", "C:\\t\\c.txt")][kind]
        return formats.write_rtf_object(formats.write_ole1_object("Package", formats.write_package(name, "C:\\x", temp, t.encode(), sized=False)))
    if kind == 4:
        return formats.write_rtf_object(formats.write_ole1_object("OLE2Link", b"\x01\x02" + f"http://b/{t}".encode("utf-16-le") + b"\0\0\1\1" + "http://a/x".encode("utf-16-le") + b"\0\0\1\1" + "other".encode("utf-16-le")))
    return formats.write_rtf_object(formats.write_ole1_object("Equation.3x", t.encode()))


@query("t15_rtf_tags", """SELECT c_custkey AS file_id, CASE c_custkey % 6 WHEN 0 THEN 'EXECUTABLE FILE,MODIFIED FILE EXTENSION' WHEN 1 THEN '' WHEN 2 THEN 'EXECUTABLE FILE' WHEN 3 THEN 'MODIFIED FILE EXTENSION' WHEN 4 THEN 'CVE-2017-0199' ELSE 'CVE-2017-11882' END AS tags,
  CASE WHEN c_custkey % 6 = 4 THEN 'http://a/x,http://b/' || c_name ELSE '' END AS urls FROM customer""")
def t15_rtf_tags(spark, sf_dir):
    rows = tables.rtf_objects(customer_files(spark, sf_dir, tagged_rtf))
    return rows.select("file_id", F.array_join("tags", ",").alias("tags"), F.array_join("urls", ",").alias("urls"))


@query("k7_rtf_saved", "SELECT c_custkey AS file_id, 'object_' || upper(lpad(to_hex(53), 8, '0')) || CASE WHEN c_custkey % 2 = 0 THEN '_f_' || c_custkey || '.txt' ELSE '.bin' END AS out_name, md5(c_name) AS md5 FROM customer")
def k7_rtf_saved(spark, sf_dir):
    def build(k, t):
        own = formats.write_package(f"f {k}.txt", "s", "t", t.encode(), sized=False) if k % 2 == 0 else t.encode()
        return formats.write_rtf_object(formats.write_ole1_object("Package" if k % 2 == 0 else "Other", own))

    return tables.rtf_saved(tables.rtf_objects(customer_files(spark, sf_dir, build))).select("file_id", "out_name", F.md5("data").alias("md5"))


@query("k8_embedded_saved", "SELECT c_custkey AS file_id, CASE c_custkey % 3 WHEN 0 THEN 'f_' || c_custkey || '.exe' WHEN 1 THEN 'src.doc' ELSE 'tmp.js' END AS out_name, length(c_name)::BIGINT AS size, md5(c_name) AS md5 FROM customer")
def k8_embedded_saved(spark, sf_dir):
    names = lambda k: [(f"f#{k}.exe", "C:\\a\\src.doc", "tmp.js"), (" ", "C:\\a\\src.doc", "tmp.js"), ("", "C:\\longer", "C:\\t/tmp.js")][k % 3]
    build = lambda k, t: cfb.write({"ObjectPool/_1/\x01Ole10Native": formats.write_package(*names(k), t.encode())})
    return tables.embedded_objects(customer_files(spark, sf_dir, build)).select("file_id", "out_name", "size", "md5")


@query("a5_object_codes", "SELECT c_custkey AS file_id, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 END AS return_code FROM customer")
def a5_object_codes(spark, sf_dir):
    good = lambda t: formats.write_package("a.txt", "b", "c", t.encode())
    build = lambda k, t: cfb.write([{"x/\x01Ole10Native": good(t)}, {"x/\x01Ole10Native": b"\xff" * 3000}, {"x/\x01Ole10Native": good(t), "y/\x01Ole10Native": b"\xff" * 3000}][k % 3])
    return verdict.object_code(tables.embedded_objects(customer_files(spark, sf_dir, build)))


@query("a6_external_types", "SELECT c_custkey AS file_id, 2::BIGINT AS n, 'attachedTemplate,oleObject' AS types FROM customer WHERE c_custkey % 2 = 0")
def a6_external_types(spark, sf_dir):
    rel = '<Relationship Type="http://x/{}" TargetMode="{}" Target="http://h/{}"/>'
    build = lambda k, t: package({"word/_rels/document.xml.rels": f'<Relationships>{rel.format("oleObject", "External" if k % 2 == 0 else "Internal", t)}{rel.format("image", "External", t)}</Relationships>', "_rels/.rels": f'<Relationships>{rel.format("attachedTemplate", "External" if k % 2 == 0 else "Internal", t)}</Relationships>'})
    out = verdict.external_types(dde.relationships(tables.external_relationships(customer_files(spark, sf_dir, build))))
    return out.select("file_id", "n", F.array_join("types", ",").alias("types"))


# --- encryption, errors, archives ------------------------------------------------------------


@query("c1_encrypted_files", "SELECT c_custkey AS file_id, c_custkey % 6 < 4 AS encrypted, CASE WHEN c_custkey % 6 < 4 THEN 'UnsupportedEncryptionError' END AS decryption FROM customer")
def c1_encrypted_files(spark, sf_dir):
    """By the summary's security bit, by streams, by Word's flag, by a package's member; and two that are not."""

    def build(k, t):
        kind = k % 6
        if kind == 3:
            return package({"a.xml": t}, flag=True)
        if kind == 4:
            return package({"a.xml": t})
        return cfb.write([{"\x05SummaryInformation": formats.write_property_set({1: 1252, 19: 1})}, {"EncryptionInfo": t.encode()}, {"WordDocument": bytes(11) + b"\x01" + bytes(20)}, {}, {}, {"\x05SummaryInformation": formats.write_property_set({1: 1252, 19: 2}), "WordDocument": bytes(40)}][kind])

    return tables.encrypted(customer_files(spark, sf_dir, build))


@query("c5_errors", "SELECT c_custkey AS file_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS code, CASE WHEN c_custkey % 2 = 1 THEN 'ValueError' END AS error FROM customer")
def c5_errors(spark, sf_dir):
    """A file that can't be read gives a row with its error."""
    build = lambda k, t: vba_file(k, t) if k % 2 == 0 else cfb.MAGIC + t.encode()
    rows = tables.macros(customer_files(spark, sf_dir, build), errors=True)
    return rows.select("file_id", "code", F.substring_index("error", ":", 1).alias("error"))


@query("s2_zip_scan", "SELECT c_custkey || '/in/a.doc' AS file_id, 'VBA/Module1' AS stream_path, c_name AS code FROM customer")
def s2_zip_scan(spark, sf_dir):
    """Members of archives that fit a glob, as files to scan."""
    build = lambda k, t: package({"in/a.doc": vba_file(k, t), "in/b.txt": t, "c/": ""})
    return tables.macros(tables.zip_scan(customer_files(spark, sf_dir, build), pattern="*.doc")).select("file_id", "stream_path", "code")


# --- macros ------------------------------------------------------------------------------------


@query("s13_text_sources", """SELECT c_custkey AS file_id, CASE c_custkey % 3 WHEN 1 THEN 'xlm_macro.txt' ELSE '' END AS vba_filename, CASE c_custkey % 3 WHEN 0 THEN 'Sub AutoOpen() ' || chr(39) || ' ' || c_name WHEN 1 THEN 'Named cell: Auto_open' || chr(10) || 'Formula or Macro: EXEC("' || c_name || '")' END AS code FROM customer WHERE c_custkey % 3 < 2""")
def s13_text_sources(spark, sf_dir):
    """Plain text and SYLK sheets as macro sources; other bytes give none."""
    build = lambda k, t: [f"Sub AutoOpen() ' {t}".encode(), f'ID;P\r\nO;E\r\nNN;NAuto_open;ER1C1\r\nC;X1;Y1;EEXEC("{t}")\r\nE\r\n'.encode(), b"\0\1" + t.encode()][k % 3]
    return tables.sources(customer_files(spark, sf_dir, build)).select("file_id", "vba_filename", "code")


def sheet_file(k: int, t: str) -> bytes:
    sheet = lambda name, kind: struct.pack("<HH", 133, 8 + len(name)) + struct.pack("<LBBBB", 0, 0, kind, len(name), 0) + name.encode()
    return cfb.write({"Workbook": struct.pack("<HH", 2057, 16) + bytes(16) + sheet("Sheet1", 0) + sheet(t, k % 2) + struct.pack("<HH", 10, 0)}, clsid=bytes.fromhex("2008020000000000C000000000000046"))


@query("g10_macro_presence", "SELECT c_custkey AS file_id, c_custkey % 5 IN (2, 3) AS has_vba, c_custkey % 5 = 4 OR c_custkey % 5 = 0 AND c_custkey % 2 = 1 AS has_xlm FROM customer")
def g10_macro_presence(spark, sf_dir):
    def build(k, t):
        kind = k % 5
        if kind == 4:
            return package({"[Content_Types].xml": TYPES.format(OVERRIDE.format("xl/macrosheets/sheet1.xml", "application/vnd.ms-excel.macrosheet+xml"))})
        return sheet_file(k, t) if kind == 0 else cfb.write({"a": t.encode()}) if kind == 1 else vba_file(k, t) if kind == 2 else cfb.write({"lost": b"Attribut\0e VB_Name " + t.encode()}, orphans=("lost",))

    return tables.macro_presence(customer_files(spark, sf_dir, build))


@query("j9_form_storages", "SELECT c_custkey AS file_id, 'Macros/Form1' AS storage, 0::BIGINT AS ordinal, c_name || chr(233) AS string FROM customer WHERE c_custkey % 2 = 0")
def j9_form_storages(spark, sf_dir):
    """Only storages with both streams, o and f; strings are UTF-8."""
    text = lambda t: b"\0\1Tahoma\0\2" + t.encode() + "\u00e9".encode() + b"\0abc\0"
    build = lambda k, t: cfb.write({"Macros/Form1/o": text(t), **({"Macros/Form1/f": b"x"} if k % 2 == 0 else {}), "Other/o": text("other text")})
    return tables.form_strings(customer_files(spark, sf_dir, build))


@query("g36_flash_in_streams", "SELECT c_custkey AS file_id, CASE WHEN c_custkey % 2 = 0 THEN 'pics/a' ELSE 'object 0' END AS source, 3::BIGINT AS pos, (c_custkey % 20)::BIGINT AS version FROM customer")
def g36_flash_in_streams(spark, sf_dir):
    swf = lambda k, t: b"abcFWS" + bytes([k % 20]) + struct.pack("<l", 1024) + t.encode().ljust(1100, b"\0")
    build = lambda k, t: cfb.write({"pics/a": swf(k, t), "b": b"FWS"}) if k % 2 == 0 else formats.write_rtf_object(formats.write_ole1_object("Any", swf(k, t)))
    return tables.flash_in_streams(customer_files(spark, sf_dir, build)).select("file_id", "source", "pos", "version")


@query("f2_f4_calls", """SELECT c_custkey AS file_id, CASE c_custkey % 3 WHEN 0 THEN 'StrReverse("' || c_name || '")' WHEN 1 THEN 'Environ("' || c_name || '")' ELSE 'Chr(Asc("B") + 1) & "' || c_name || '"' END AS encoded,
  CASE c_custkey % 3 WHEN 0 THEN reverse(c_name) WHEN 1 THEN '%' || c_name || '%' ELSE 'C' || c_name END AS decoded FROM customer""")
def f2_f4_calls(spark, sf_dir):
    call = F.expr("""CASE c_custkey % 3 WHEN 0 THEN 'StrReverse("' || c_name || '")' WHEN 1 THEN 'Environ("' || c_name || '")' ELSE 'Chr(Asc("B") + 1) & "' || c_name || '"' END""")
    code = tables.spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("x = "), call).alias("code"))
    return code.select("file_id", F.inline(S.expression_strings(F.col("code"))))


# --- trees, times, descriptions -----------------------------------------------------------------


@query("g38_storage_tree", "SELECT c_custkey AS file_id, unnest([0, 1, 2, 3, 4])::BIGINT AS place, unnest([0, 1, 2, 2, 1])::BIGINT AS depth, unnest(['', 'A', 'A/b', 'A/c', 'd']) AS path, unnest([-1, -1, length(c_name), 1, 2])::BIGINT AS size FROM customer")
def g38_storage_tree(spark, sf_dir):
    build = lambda k, t: cfb.write({"d": b"xy", "A/c": b"x", "A/b": t.encode()})
    return tables.storage_tree(customer_files(spark, sf_dir, build)).select("file_id", "place", "depth", "path", F.coalesce("size", F.lit(-1)).cast("long").alias("size"))


@query("g42_times", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS text FROM events")
def g42_times(spark, sf_dir):
    """File times (100 ns since 1601) as text, without fractions."""
    ticks = (F.unix_micros(F.col("ts").cast("timestamp")) + F.lit(11_644_473_600_000_000)) * 10
    return table(spark, sf_dir, "events").select("event_id", tables.filetime_text(ticks).alias("text"))


@query("j1_clsid_descriptions", f"SELECT c_custkey AS file_id, name AS description, CASE WHEN i = 0 THEN true ELSE false END AS is_exploited FROM customer JOIN (VALUES {', '.join(f'''({i}, '{('CVE-2017-0000 ' if i == 0 else '') + r[1].replace(chr(39), chr(39) * 2)}')''' for i, r in enumerate(KEYS[:6]))}) v(i, name) ON c_custkey % 6 = i")
def j1_clsid_descriptions(spark, sf_dir):
    known = spark.createDataFrame([(r[6], ("CVE-2017-0000 " if i == 0 else "") + r[1]) for i, r in enumerate(KEYS[:6])], "clsid string, description string")
    build = lambda k, t: typed_file(k % 6, t)
    rows = tables.storage_tree(customer_files(spark, sf_dir, build)).where("place = 0").withColumn("clsid", F.lower("clsid"))
    return filetypes.described_clsids(rows, known).select("file_id", "description", "is_exploited")


@query("j12_code_pages", "SELECT c_custkey AS file_id, '1252' AS value, CASE WHEN c_custkey % 2 = 0 THEN 'Western' ELSE 'Unknown code page' END AS code_page_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '1251', 'Unknown code page' FROM customer WHERE c_custkey % 2 = 1")
def j12_code_pages(spark, sf_dir):
    build = lambda k, t: cfb.write({"\x05SummaryInformation": formats.write_property_set({1: 1252 - k % 2, 2: t})})
    rows = tables.ole_metadata(customer_files(spark, sf_dir, build)).where("property = 'codepage'").withColumn("codepage", F.col("value").cast("long"))
    return filetypes.code_pages(rows, spark.createDataFrame([(1252, "Western")], "codepage long, name string")).select("file_id", "value", "code_page_name")


# --- indicators, reports, mail --------------------------------------------------------------------

AUTO = 'Sub AutoOpen()\nShell "{}"\nEnd Sub\n'


def indicated_file(k: int, t: str) -> bytes:
    kind = k % 4
    if kind == 0:
        swf = b"FWS\x05" + struct.pack("<l", 1024) + bytes(1100)
        own = ovba.write_project({"Module1": AUTO.format(t)})
        return cfb.write({**own, "ObjectPool/_1/x": swf, "pic": swf, "\x05SummaryInformation": formats.write_property_set({1: 1252, 4: t, 18: "Word", 19: 1})}, clsid=bytes.fromhex("0609020000000000C000000000000046"))
    if kind == 1:
        rel = '<Relationship Id="{0}" Type="http://x/{1}" TargetMode="External" Target="http://h/{0}"/>'
        return package({"_rels/.rels": '<Relationships><Relationship Id="1" Type="http://x/officeDocument" Target="word/document.xml"/></Relationships>', "[Content_Types].xml": TYPES.format(OVERRIDE.format("word/document.xml", WORD_TYPE)), "word/document.xml": "<d/>", "word/_rels/document.xml.rels": f"<Relationships>{rel.format(1, 'attachedTemplate')}{rel.format(2, 'image')}{rel.format(3, 'oleObject')}</Relationships>"})
    return sheet_file(1, t) if kind == 2 else b"{\\rtf1 " + t.encode() + b"}"


_EACH = {
    0: [("ftype", "'MS Word 97-2003 Document or Template'", "info"), ("container", "'OLE'", "info"), ("appname", "'Word'", "info"), ("codepage", "'1252: Unknown code page'", "info"), ("author", "c_name", "info"), ("encrypted", "'true'", "low"), ("vba", "'Yes, suspicious'", "HIGH"), ("xlm", "'No'", "none"), ("ext_rels", "'0'", "none"), ("ObjectPool", "'true'", "low"), ("flash", "'2'", "Medium")],
    1: [("ftype", "'MS Word 2007+ Document (.docx)'", "info"), ("container", "'OpenXML'", "info"), ("encrypted", "'false'", "none"), ("vba", "'No'", "none"), ("xlm", "'No'", "none"), ("ext_rels", "'2'", "HIGH"), ("ObjectPool", "'false'", "none"), ("flash", "'0'", "none")],
    2: [("ftype", "'MS Excel 97-2003 Workbook or Template'", "info"), ("container", "'OLE'", "info"), ("appname", "NULL", "info"), ("codepage", "NULL", "info"), ("author", "NULL", "info"), ("encrypted", "'false'", "none"), ("vba", "'No'", "none"), ("xlm", "'Yes'", "Medium"), ("ext_rels", "'0'", "none"), ("ObjectPool", "'false'", "none"), ("flash", "'0'", "none")],
    3: [("ftype", "'Rich Text Format'", "info"), ("container", "'RTF'", "info"), ("encrypted", "'false'", "none"), ("vba", "'No'", "none"), ("xlm", "'No'", "none"), ("ext_rels", "'0'", "none"), ("ObjectPool", "'false'", "none"), ("flash", "'0'", "none")],
}
_INDICATORS = " UNION ALL ".join(f"SELECT c_custkey AS file_id, '{name}' AS id, {value}::VARCHAR AS value, '{risk}' AS risk FROM customer WHERE c_custkey % 4 = {k}" for k, rows in _EACH.items() for name, value, risk in rows)


@query("i_indicators", _INDICATORS)
def i_indicators(spark, sf_dir):
    """All indicators of four kinds of files."""
    return verdict.indicators(customer_files(spark, sf_dir, indicated_file))


@query("p6_shown_indicators", f"SELECT * FROM ({_INDICATORS}) WHERE id IN ('encrypted', 'vba', 'xlm', 'ext_rels') OR value NOT IN ('false', '0', '')")
def p6_shown_indicators(spark, sf_dir):
    return verdict.shown(verdict.indicators(customer_files(spark, sf_dir, indicated_file)))


@query("a4_batch_code", "SELECT CASE WHEN count(*) FILTER (WHERE c_custkey % 100 = 7) = 0 THEN 0 WHEN count(*) FILTER (WHERE c_custkey % 100 = 7) = 1 THEN 9 ELSE 7 END AS return_code FROM customer")
def a4_batch_code(spark, sf_dir):
    build = lambda k, t: cfb.write({"EncryptionInfo": t.encode()} if k % 100 == 7 else {"a": t.encode()})
    rows = tables.encrypted(customer_files(spark, sf_dir, build))
    code = F.when(F.col("encrypted"), V.RETURN_CODES["ENCRYPTED"]).otherwise(V.RETURN_CODES["OK"])
    return verdict.batch_code(rows.select(F.col("file_id").alias("ordinal"), code.alias("return_code")))


def reported(spark, sf_dir):
    files = customer_files(spark, sf_dir, lambda k, t: cfb.write(ovba.write_project({"Module1": f"Sub AutoOpen()\nx = \"{t.replace('0', 'o')}\"\n"})) if k % 2 == 0 else cfb.write({"a": t.encode()}))
    return report.scanned(tables.sources(files), files.select("file_id", tables.container_type().alias("container")))


_OPENED = "Runs when the Word document is opened"


@query("k2_document", f"""SELECT c_custkey AS file_id, '{{"file":"' || c_custkey || '","json_conversion_successful":true,"analysis":' || CASE WHEN c_custkey % 2 = 0 THEN '[{{"type":"AutoExec","keyword":"AutoOpen","description":"{_OPENED}"}}]' ELSE 'null' END || ',"code_deobfuscated":null,"do_deobfuscate":false,"type":"OLE","macros":' || CASE WHEN c_custkey % 2 = 0 THEN '[{{"vba_filename":"Module1.bas","ole_stream":"VBA/Module1","code":"Sub AutoOpen()\\nx = \\"' || replace(c_name, '0', 'o') || '\\""}}]' ELSE '[]' END || '}}' AS json FROM customer""")
def k2_document(spark, sf_dir):
    return report.json_documents(reported(spark, sf_dir))


@query("k1_report", f"""SELECT c_custkey AS file_id, 'FILE: ' || c_custkey || chr(10) || 'Type: OLE' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'VBA MACRO Module1.bas ' || chr(10) || 'in file: - OLE stream: VBA/Module1' || chr(10) || 'Sub AutoOpen()' || chr(10) || 'x = "' || replace(c_name, '0', 'o') || '"' || chr(10) || 'AutoExec | AutoOpen | {_OPENED}' ELSE 'No VBA or XLM macros found.' || chr(10) || 'No suspicious keyword or IOC found.' END AS report FROM customer""")
def k1_report(spark, sf_dir):
    return report.detailed(reported(spark, sf_dir))


@query("k5_analysis", f"SELECT c_custkey AS file_id, CASE WHEN c_custkey % 2 = 0 THEN '|AutoExec      |AutoOpen|{_OPENED}' ELSE 'No suspicious keyword or IOC found.' END AS analysis FROM customer")
def k5_analysis(spark, sf_dir):
    return report.analysis_text(reported(spark, sf_dir))


@query("k6_coloured", """SELECT c_custkey AS file_id, 'Sub {autoyellow}AutoOpen{/yellow}()' || chr(10) || '\\e {autored}Shell{/red} "' || c_name || '"' AS code FROM customer""")
def k6_coloured(spark, sf_dir):
    code = F.concat(F.lit('Sub AutoOpen()\n\x1b Shell "'), F.col("c_name"), F.lit('"'))
    rows = S.decode_strings(tables.spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("file_id"), code.alias("code")))
    found = rows.select("file_id", "code", F.transform(S.findings_in_rows(), lambda x: F.struct(x["category"].alias("type"), x["keyword"].alias("keyword"))).alias("findings"))
    return found.select("file_id", report.coloured(F.col("code"), F.col("findings")).alias("code"))


def mailed(k: int, t: str) -> bytes:
    """Attachments without names too: suspicious; harmless; two harmless ones whose code together would be suspicious; no office file."""
    part = lambda data, name="": f'--b\nContent-Type: application/octet-stream\n{f"Content-Disposition: attachment; filename={name}" if name else "X-None: 1"}\nContent-Transfer-Encoding: base64\n\n{base64.b64encode(data).decode()}\n'
    own = {0: [part(vba_file(k, AUTO.format(t)))], 1: [part(vba_file(k, f"Sub A()\n' {t}\n"), "a.doc")], 2: [part(vba_file(k, "Sub AutoOpen()\n"), "a.doc"), part(vba_file(k, 'Shell "x"\n'), "b.doc")], 3: [part(t.encode(), "a.txt")]}[k % 4]
    return ('From: a@example.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n' + "".join(own) + "--b--\n").encode()


@query("st3_mail_actions", "SELECT c_custkey AS file_id, (CASE c_custkey % 4 WHEN 2 THEN 2 ELSE 1 END)::BIGINT AS attachments, CASE WHEN c_custkey % 4 = 0 THEN 'REPLACE' ELSE 'ACCEPT' END AS action, c_custkey % 4 = 0 AS has_note FROM customer")
def st3_mail_actions(spark, sf_dir):
    rows = mail.actions(customer_files(spark, sf_dir, mailed))
    return rows.select("file_id", "attachments", "action", F.contains(F.col("message").cast("string"), F.lit(V.REMOVED)).alias("has_note"))


@query("st3_attachments", "SELECT c_custkey AS file_id, place, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 3 THEN 'a.txt' ELSE CASE place WHEN 0 THEN 'a.doc' ELSE 'b.doc' END END AS name, CASE c_custkey % 4 WHEN 0 THEN 'SUSPICIOUS' WHEN 3 THEN 'not office' ELSE 'Macro OK' END AS verdict FROM customer, (SELECT unnest([0, 1])::BIGINT AS place) WHERE place = 0 OR c_custkey % 4 = 2")
def st3_attachments(spark, sf_dir):
    return mail.attachments(customer_files(spark, sf_dir, mailed)).select("file_id", "place", "name", "verdict")


@query("f14_all_names", "SELECT s_suppkey AS file_id, unnest([0, 1, 3])::BIGINT AS place, unnest(['a.b_' || s_suppkey || '.exe', 'x.longer', 'oleobj_001']) AS name FROM supplier")
def f14_all_names(spark, sf_dir):
    """Candidates for an embedded file's name, but for those made of a hash; these are held against Python in a test."""
    files = _files(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", lambda k, t: str(k).encode())
    rows = tables.generate(files, lambda d: enumerate(formats.name_candidates(" ", f"C:\\dir\\a..b#{d.decode()}.exe", "/tmp/x.longer", 14, 1)), "place long, name string")
    return rows.where("not (place > 1 and not startswith(name, 'oleobj_'))").withColumn("place", F.least("place", F.lit(3)))
