"""Readers of whole files: names, fields, errors, mail, and bounds that show as errors."""

import hashlib

import pytest

from siftwood.functions import macro_text as M
from siftwood.operators import dde
from siftwood.plans import catalog
from siftwood.plans import file_catalog as C
from siftwood.sources import cfb, documents, formats, tables


@pytest.mark.parametrize(
    ("name", "most", "want"),
    [("a/b/c.txt", 255, "c.txt"), ("a..b  c.exe", 255, "a.b c.exe"), ("x" * 300 + ".exe", 20, "x" * 16 + ".exe"), ("é#.js", 255, "__.js"), ("longname", 4, "long"), ("a.longending", 5, "a.lon"), ("", 9, ""), ("keep.doc", 0, "keep.doc")],
)
def test_safe_names(name, most, want):
    assert formats.safe_name(name, most) == want


def test_name_candidates():
    got = formats.name_candidates("", "C:\\d\\a.exe", "/tmp/x.longer", 128, 7)
    letters = got[2].removesuffix(".exe")
    assert got == ["a.exe", "x.longer", f"{letters}.exe", letters, "oleobj_007"] and letters.isalpha() and len(letters) == 26
    assert formats.name_candidates("", "", "", 0, 3) == ["oleobj_003"]


@pytest.mark.parametrize(("name", "want"), [("a.txt", ".txt"), ("noext", ""), (".hidden", ""), ("a.b.GADGET", ".GADGET"), ("d.x/name", "")])
def test_endings(name, want):
    assert formats.ending(name) == want


@pytest.mark.parametrize(("field", "want"), [("QUOTE 68 68 69", "DDE"), ("QUOTE 8364 x", "€x"), ("QUOTE -5 99999999", "-599999999"), ("DATE 65", "DATE 65"), (" QUOTE 128512 ", "😀")])
def test_unquote(spark, field, want):
    assert documents.unquote(field) == want
    df = spark.createDataFrame([(field,)], "field string")
    assert df.select(dde.unquote(df.field)).first()[0] == want


def test_bounds_show_as_errors(spark, monkeypatch):
    """What inflates beyond the bound gives no rows, and says so."""
    monkeypatch.setattr(formats, "MOST", 1000)
    with pytest.raises(ValueError, match="more than 1000 bytes"):
        formats.active_mime(formats.write_active_mime(bytes(5000)))
    with pytest.raises(ValueError, match="more than 10 bytes"):
        formats.inflate(__import__("zlib").compress(bytes(5000)), 10)
    files = spark.createDataFrame([(1, bytearray(cfb.MAGIC + b"x")), (2, bytearray(C.vba_file(2, "Sub A()"))), (3, None)], "file_id int, content binary")
    got = {r.file_id: (r.code, r.error) for r in tables.macros(files, errors=True).collect()}
    assert got[2] == ("Sub A()", None) and got[1][0] is None and got[1][1].startswith("ValueError") and 3 not in got


def test_records_of_any_depth_and_properties_of_any_number():
    data = b"leaf"
    for _ in range(3000):
        data = b"\x0f\0\xe8\x03" + len(data).to_bytes(4, "little") + data
    assert max(r[0] for r in formats.ppt_records(data)) == 2999
    many = formats.property_set(formats.write_property_set({k: f"v{k}" for k in range(2, 3000)}))
    assert len(many) == 2998 and many[2999] == "v2999"


def test_every_layout_of_a_field():
    w = C.WORD
    run = lambda x: f"<w:r>{x}</w:r>"
    xml = f'<w:d {w}><w:p>{run("<w:instrText>outside </w:instrText>")}{run("<w:fldChar w:fldCharType=\'begin\'/>")}{run("<w:instrText>DATE</w:instrText>")}{run("<w:fldChar w:fldCharType=\'end\'/>")}{run("<w:fldChar w:fldCharType=\'begin\'/>")}{run("<w:fldChar w:fldCharType=\'end\'/>")}</w:p><w:fldSimple w:instr="PAGE"/></w:d>'
    assert list(documents.word_xml_fields(xml.encode())) == ["outside DATE", "", "PAGE"]


@pytest.mark.parametrize("kind", range(9))
def test_dde_of_damaged_files_never_raises_oddly(kind):
    data = C.dde_file(kind, "cmd.exe")
    for cut in range(0, len(data), max(1, len(data) // 40)):
        try:
            list(documents.dde_links(data[:cut]))
        except Exception as e:
            assert isinstance(e, (ValueError, IndexError, KeyError, EOFError, __import__("struct").error, __import__("zipfile").BadZipFile)), e


def test_mail_replaces_and_discards(spark):
    from siftwood.functions import fixed_values as V
    from siftwood.streaming import mail

    rows = [(k, bytearray(C.mailed(k, "x.exe"))) for k in range(4)]
    got = {r.file_id: r for r in mail.actions(spark.createDataFrame(rows, "file_id int, content binary")).collect()}
    assert [got[k].action for k in range(4)] == ["REPLACE", "ACCEPT", "ACCEPT", "ACCEPT"]
    parts = formats.mail_parts(bytes(got[0].message))
    assert [(c, b.decode()) for _, c, b in parts] == [("text/plain", V.REMOVED)]
    assert bytes(got[1].message) == bytes(rows[1][1])


def test_mail_archive(spark, tmp_path):
    from siftwood.streaming import mail

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(C.mailed(1, "x"))
    mail.archive(mail.message_stream(spark, str(tmp_path / "in")), str(tmp_path / "kept"), str(tmp_path / "marks")).awaitTermination()
    assert bytes(spark.read.parquet(str(tmp_path / "kept")).first().content) == C.mailed(1, "x")


def test_saved_objects(spark, tmp_path):
    files = spark.createDataFrame([(1, bytearray(cfb.write({"x/\x01Ole10Native": formats.write_package("a.exe", "b", "c", b"data")})))], "file_id int, content binary")
    tables.save_objects(tables.embedded_objects(files), str(tmp_path / "objects"))
    row = spark.read.parquet(str(tmp_path / "objects")).first()
    assert (row.out_name, bytes(row.data)) == ("a.exe", b"data") and row.shelf == hashlib.md5(b"1").hexdigest()[0]


def test_locked_archives(spark):
    files = spark.createDataFrame([("z", bytearray(C.package({"a.txt": "x"}, flag=True)))], "file_id string, content binary")
    row = tables.zip_scan(files, password="no").first()
    assert row.content is None and row.error and row.container == "z"


def test_triage_counts_equal_python(spark):
    """Every count of the triage of code with words in several scripts, against plain regular expressions."""
    import re

    from siftwood.operators import macro_scan as S

    codes = ["Sub AutoOpen()\nShell \"x\"", "größe Shellé Shell", "éShell", "x = \"687474703a2f2f61\" ' http://a.example.com/x and a@b.example.org 1.2.3.4 run.exe", "Print #1, wscript.shell", "my_Click() Image_Click", "Could contain following functions: EXEC", "EXEC(1) REGISTER", ""]
    df = spark.createDataFrame(list(enumerate(codes)), "file_id int, code string")
    got = {r.file_id: r for r in S.triage(S.decode_strings(df)).collect()}
    for i, code in enumerate(codes):
        decoded = [bytes.fromhex(h).decode("utf-8", "replace") for h in dict.fromkeys(re.findall(r"(?:[0-9A-Fa-f]{2}){4,}", code))]
        variants = [v for v in (code, "".join("\n" + d for d in decoded)) if v]
        count = lambda t: sum(bool(re.search(p.replace("(?iU)", "(?i)"), v)) for v in variants for _, p in t)  # noqa: E731, B023
        assert got[i].n_autoexec == count(M.AUTOEXEC), code
        assert got[i].n_suspicious == count(M.SUSPICIOUS) + bool(decoded), code
        assert got[i].n_hex == len(decoded) and got[i].n_base64 == 0 or '"' in code


def test_dridex_of_odd_strings():
    assert M.dridex_decode("C3iY1epSRGe6q8g15xStVesdG717MAlg2H4hmV1vkL6Glnf0cknj") == "TMP"
    for text in ("", "abc", "x" * 20, "1" * 40, "a1b2" * 12):
        out = M.dridex_decode(text)
        assert out is None or isinstance(out, str)


def rows_of_batches(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})


def test_workers_get_small_batches_of_files(spark):
    """However many rows a task has, in a session of Spark's usual settings: when files are built (their texts and they themselves), and when they are read."""
    one = spark.newSession().range(0, 5000, 1, 1).selectExpr("id", "'Sub AutoOpen()' AS code")
    files = catalog._files(one, "id", "code", lambda k, t: t.encode())
    assert [r.n for r in files.mapInArrow(rows_of_batches, "n long, bytes long").collect()] == [2000, 2000, 1000]
    given = spark.newSession().range(0, 30, 1, 1).selectExpr("id AS file_id", "cast(repeat('x', 1000000) AS binary) AS content")
    assert tables.generate(given, lambda d: [(len(d),)], "n long").where("n = 1000000").count() == 30
    assert max(r.bytes for r in given.mapInArrow(rows_of_batches, "n long, bytes long").collect()) < 10_000_000


@pytest.mark.parametrize("name", ["g10_macro_presence", "s2_zip_scan"])
def test_whole_results_over_many_batches(spark, tmp_path, monkeypatch, name):
    """The query itself binds its batches, here to 50 files, and gives what its SQL does."""
    import duckdb

    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setitem(tables.BATCHES, limit, ("10000", "50"))
    own, con = spark.newSession(), duckdb.connect()
    con.execute(f"CREATE TABLE customer AS SELECT i::BIGINT AS c_custkey, 'Customer#' || i AS c_name FROM range(2000) r(i); COPY customer TO '{tmp_path}/customer.parquet'")
    got = catalog.QUERIES[name](own, str(tmp_path))
    assert own.conf.get(limit) == "50"
    want = con.execute(catalog.ORACLE[name])
    assert sorted(map(tuple, got.select(*[c[0] for c in want.description]).collect())) == sorted(want.fetchall())


def test_small_rows_leave_in_small_batches(spark, monkeypatch):
    """A file of a few bytes that gives very many rows of numbers, or long texts within lists."""
    import pyarrow as pa

    steps = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", lambda self, run, schema: steps.append(run))
    files = spark.range(3).selectExpr("id AS file_id", "cast('x' AS binary) AS content")
    tables.generate(files, lambda d: ((i,) for i in range(45_000)), "n long")
    tables.generate(files, lambda d: (([("a", "x" * 1_000_000)],) for _ in range(30)), "attributes map<string,string>")
    given = [pa.RecordBatch.from_pydict({"file_id": [1, 2, 3], "content": [b"x"] * 3})]
    numbers = list(steps[0](given))
    assert max(b.num_rows for b in numbers) <= 10_000
    assert [tuple(r.values()) for b in numbers for r in b.to_pylist()] == [(k, i) for k in (1, 2, 3) for i in range(45_000)]
    lists = list(steps[1](given))
    assert max(b.nbytes for b in lists) < 10_000_000 and sum(b.num_rows for b in lists) == 90
