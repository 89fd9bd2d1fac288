"""DataFrame operators on small tables, and every query against its SQL at the smallest size."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwood.functions import fixed_values as V
from siftwood.functions import macro_text as M
from siftwood.operators import dde, verdict
from siftwood.operators import macro_scan as S
from siftwood.plans import catalog
from siftwood.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda x: sorted(map(str, x[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_triage_equals_python(spark):
    rows = {r.file_id: r for r in catalog.k3_triage(spark, SF).collect()}
    for r in catalog.document_code(spark, SF).collect():
        for table, column in ((M.AUTOEXEC, "n_autoexec"), (M.SUSPICIOUS, "n_suspicious")):
            n = sum(1 for _, p in table if re.search(p.replace("(?iU)", "(?i)"), r.code))
            got = rows[r.file_id][column] - (column == "n_suspicious") * sum(rows[r.file_id][c] > 0 for c in ("n_hex", "n_base64", "n_dridex"))
            if not rows[r.file_id].n_hex + rows[r.file_id].n_base64:
                assert got == n


def test_keywords_with_and_without_guard(spark):
    samples = ["Sub AutoOpen()", "x_click", "Print #1", "Print # 1", "a.Variables", "EnumDateFormatsExEx EnumSystemLanguageGroups", "HKCU\\Environment", "execlp system", "\u00e9open", "open\u00e9", "OPEN", "Could contain following functions: EXEC", "c:\\FILE.exe", "", "\b", "KILL \u017fhell"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "file_id int, code string")
    code, tokens = F.col("code"), M.plain_tokens(F.col("code"))
    both = df.select("code", M.find_suspicious(code).alias("a"), M.find_suspicious(code, None, None, tokens).alias("b"), M.find_autoexec(code).alias("c"), M.find_autoexec(code, None, tokens).alias("d")).collect()
    for r in both:
        assert r.a == r.b and r.c == r.d
        assert [x.ord for x in r.a if x.ord < len(M.SUSPICIOUS)] == [i for i, (_, p) in enumerate(M.SUSPICIOUS) if re.search(p.replace("(?iU)", "(?i)"), r.code)], r.code


def test_findings_of_one_file(spark):
    code = 'Sub AutoOpen()\nShell "' + b"Kill x".hex() + '" \' StrReverse\nu = "http://a.example.com/x.exe"\n'
    rows = S.findings(S.decode_strings(spark.createDataFrame([(1, code)], "file_id int, code string"), deobfuscate=True)).orderBy("ordinal").collect()
    got = [(r.type, r.keyword) for r in rows]
    assert got[0] == ("AutoExec", "AutoOpen")
    assert ("Suspicious", "Kill") in got and ("Suspicious", "Hex Strings") in got and ("IOC", "http://a.example.com/x.exe") in got and ("Hex String", "Kill x") in got
    assert [r.ordinal for r in rows] == list(range(1, len(rows) + 1))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "file_id int, code string")
    assert S.findings(S.decode_strings(df)).count() == 0
    assert S.triage(S.decode_strings(df)).count() == 0
    files = spark.createDataFrame([], "file_id int, content binary")
    assert tables.macros(files).count() == 0 and tables.rtf_objects(files).count() == 0


def test_unreadable_files_give_no_rows(spark):
    files = spark.createDataFrame([(1, bytearray(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")), (2, bytearray(b"PK\x03\x04broken")), (3, bytearray(b"")), (4, None)], "file_id int, content binary")
    for f in (tables.macros, tables.ole_streams, tables.zip_parts, tables.rtf_objects, tables.xml_elements):
        assert f(files).count() == 0


def test_harmless_fields(spark):
    yes = ["DATE", 'DATE \\@ "dd"', "AUTHOR x \\* Upper", "PAGE \\# 0", 'TC "a" \\n', "SEQ a b \\h", "QUOTE 12", "toc \\o x \\h", "TIME \\* MERGEFORMAT"]
    no = ["", " ", "DATE x", "DATE \\q", "TITLE a b", "DDE a", "DDEAUTO c", "PAGE \\", "AUTHOR \\* Other", "MACROBUTTON x", "DOCPROPERTY", "DATE \\h x"]
    df = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "field string, want boolean")
    assert df.where(dde.is_harmless_field(F.col("field")) != F.col("want")).collect() == []


def test_field_modes(spark):
    df = spark.createDataFrame([("DATE",), (" ddeauto x",), ("other",)], "field string")
    assert [dde.filter_fields(df, mode=m).count() for m in dde.MODES] == [3, 1, 2]
    with pytest.raises(ValueError):
        dde.filter_fields(df, mode="none")


def test_worst_verdict(spark):
    df = spark.createDataFrame([(1, "Macro OK", 2), (2, "SUSPICIOUS", 20)], "file_id int, verdict string, exit_code int")
    assert verdict.worst(df).first().verdict == "SUSPICIOUS"


def test_drop_attributes(spark):
    code = 'Attribute VB_Name = "a"\r\nAttribute VB_B = 1: Shell\r\nSub A()\r\nAttribute VB_C\r\n'
    got = spark.createDataFrame([(code,)], "code string").select(M.drop_attributes(F.col("code"))).first()[0]
    assert got == 'Attribute VB_B = 1: Shell\nSub A()\nAttribute VB_C'


def test_exit_codes():
    assert V.VERDICT_CODES["SUSPICIOUS"] > V.VERDICT_CODES["ERROR"] > V.VERDICT_CODES["Macro OK"]


def test_mail_stream(spark, tmp_path):
    import base64

    from siftwood.plans.catalog import vba_file
    from siftwood.streaming.mail import actions, message_stream

    for name, code in (("bad", "Sub AutoOpen()\nShell 1\nEnd Sub"), ("good", "Sub A()\nEnd Sub")):
        body = base64.encodebytes(vba_file(1, code)).decode()
        (tmp_path / f"{name}.eml").write_text(f'MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: application/msword\nContent-Disposition: attachment; filename="a.doc"\nContent-Transfer-Encoding: base64\n\n{body}\n--b--\n')
    (tmp_path / "odd.eml").write_bytes(b"\xff\xfe no mail")
    q = actions(message_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("mail_actions").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {os.path.basename(r.file_id): r.action for r in spark.sql("SELECT * FROM mail_actions").collect()}
    assert got == {"bad.eml": "REPLACE", "good.eml": "ACCEPT", "odd.eml": "ACCEPT"}
    batch = {os.path.basename(r.file_id): r.action for r in actions(tables.scan_files(spark, str(tmp_path), "*.eml")).collect()}
    assert batch == got


def test_entry_points_import():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_container_marks_behind_the_first_4096_bytes(spark):
    from siftwood.plans.catalog import office_file
    from siftwood.streaming import mail

    code, pad = "Sub AutoOpen()\nShell \"x\", 1\nOpen \"f\" For Output As #1\nEnd Sub", "p" * 5000
    word, flat, mht = (office_file(k, code) for k in (2, 3, 4))
    declared = b'<?xml version="1.0"?>'
    commented = declared + f"<!-- {pad} -->".encode()
    namespace = b"http://schemas.microsoft.com/office/word/2003/wordml"
    far = {
        "Word2003_XML": word.replace(declared, commented),
        "FlatOPC_XML": flat.replace(declared, commented),
        "MHTML": f"X-Pad: {pad}\n".encode() + mht,
        "MHTML that quotes a namespace": mht.replace(b"--b--\n", b"--b\nContent-Type: text/html\n\n<html xmlns:w='" + namespace + b"'>\n--b--\n"),
        "Text": pad.encode() + b" " + namespace,
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in far.items()], "file_id string, content binary")
    kinds = {r.file_id: r.container for r in files.select("file_id", tables.container_type().alias("container")).collect()}
    assert kinds == {k: k.split()[0] for k in far}
    found = {r.file_id: r.code for r in tables.macros(files).collect()}
    assert found == {k: code for k in far if k != "Text"}
    attached = b'Content-Type: multipart/mixed; boundary="m"\nMIME-Version: 1.0\n\n--m\nContent-Type: application/xml; name="a.xml"\nContent-Disposition: attachment; filename="a.xml"\n\n' + far["Word2003_XML"] + b"\n--m--\n"
    row = mail.actions(spark.createDataFrame([("m", bytearray(attached))], "file_id string, content binary")).collect()[0]
    assert (row.attachments, row.action) == (1, "REPLACE")
