"""Round trips through our own writers, and damaged input."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwood.functions.expressions import expressions
from siftwood.functions.macro_text import dridex_decode
from siftwood.sources import cfb, formats, ovba, tables


@pytest.mark.parametrize("n", [0, 1, 63, 64, 4095, 4096, 4097, 70_000])
def test_compound_file_round_trip(n):
    d = os.urandom(n)
    f = cfb.CompoundFile(cfb.write({"a": d, "S/b": b"x" * n, "S/T/c": b"q", "lost": b"z"}, orphans=("lost",)))
    assert {e.path: c for e, c in f.streams()} == {"a": d, "S/b": b"x" * n, "S/T/c": b"q", None: b"z"}
    assert len(f.streams(orphans=False)) == 3


def test_large_compound_file_needs_difat():
    assert cfb.CompoundFile(cfb.write({"big": b"z" * 9_000_000})).streams()[0][1] == b"z" * 9_000_000


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_vba_compression_round_trip(d):
    assert ovba.decompress(ovba.compress(d)) == d


def test_vba_copy_tokens():
    assert ovba.decompress(bytes.fromhex("0103B002614500")) == b"a" * 73  # a, then a copy of 72 from 1 back: an example of the published specification


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 2000))
def test_damaged_compound_files_end(noise, at):
    good = bytearray(cfb.write({"a": b"x" * 5000, "S/b": b"y"}))
    good[at : at + len(noise)] = noise
    try:
        cfb.CompoundFile(bytes(good)).streams()
    except (ValueError, IndexError, OverflowError):
        pass


def test_modules():
    src = {"Module1": "Sub AutoOpen()\r\nEnd Sub\r\n" * 400, "ThisDocument": ""}
    rows = list(tables._project_modules(cfb.write(ovba.write_project(src, prefix=b"cache"))))
    assert [(r[1], r[3]) for r in rows] == [("VBA/Module1", src["Module1"]), ("VBA/ThisDocument", "")]


def test_orphan_code_is_found():
    code = 'Attribute VB_Name = "X"\r\nSub A()\r\n'
    rows = list(tables._project_modules(cfb.write({"Macros/x": b"junk" + ovba.compress(code.encode())})))
    assert rows and rows[0][3] == code


def test_rtf_object():
    p = formats.write_package("a.exe", "C:\\a.exe", "C:\\t\\a.tmp", b"hello", sized=False)
    (o,) = formats.rtf_objects(formats.write_rtf_object(formats.write_ole1_object("Package", p)))
    assert (o["filename"], o["tags"], o["is_package"]) == ("a.exe", ["EXECUTABLE FILE", "MODIFIED FILE EXTENSION"], True)


def test_rtf_object_over_odd_digits_and_open_groups():
    assert formats.rtf_objects(b"{\\rtf1{\\object{\\*\\objdata 0105 0000 0")[0]["raw_size"] == 4
    assert formats.rtf_objects(b"{\\rtf1 no objects}") == []


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_rtf_never_fails(d):
    formats.rtf_objects(b"{\\rtf" + d)


def test_native_package_link():
    p = formats.write_package("a", "b", "c", b"data")
    assert formats.native_package(p)["data"] == b"data"
    assert formats.native_package(p[: -len(b"data") - 4])["is_link"]


def test_name_candidates():
    names = formats.name_candidates("", "C:\\dir\\evil.exe", "x:\\tmp\\long.extension", 128, 3)
    assert names[:2] == ["evil.exe", "long.extension"] and names[-1] == "oleobj_003"
    assert formats.name_candidates("", "", "", 128, 7)[-1] == "oleobj_007"
    assert formats.safe_name("../../\u202e\n") == "__" or formats.safe_name("../../\u202e\n")


def test_active_mime():
    assert formats.active_mime(formats.write_active_mime(b"x" * 100)) == b"x" * 100
    with pytest.raises(ValueError):
        formats.active_mime(b"other")


def test_entities_are_refused():
    with pytest.raises(ValueError):
        list(formats.xml_elements(b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'))


def test_dridex():
    assert dridex_decode("C3iY1epSRGe6q8g15xStVesdG717MAlg2H4hmV1vkL6Glnf0cknj") == "TMP"
    assert dridex_decode("abc") is None


def test_expressions():
    code = 'x = Chr(72) & "i" & Chr(60+5)\ny = "alone"\nz = StrReverse("olleh")\nq = Environ("TEMP") & "\\x"\nw = Chr(10/3)\nv = f("68656c6c6f21")\nu = Chr(2*3+4*15-1)'
    assert [d for _, d in expressions(code)] == ["HiA", "hello", "%TEMP%\\x", "hello!", "A"]
    list(expressions("(" * 5000 + '"a"'))


def test_word_fields():
    assert formats.word_fields(b"a\x13DDEAUTO cmd \x14r\x15\x13PAGE\x15\x13 dde x\x15") == ["DDEAUTO cmd ", " dde x"]


def test_property_set():
    assert formats.property_set(formats.write_property_set({1: 65001, 2: "T\u00eftle", 14: 7})) == {1: 65001, 2: "T\u00eftle", 14: 7}


def test_csv_links():
    from siftwood.operators.dde import csv_links

    for delimiter in ",\t;|^":
        for quote in ("", '"'):
            if delimiter == "|" and not quote:  # the link itself would be cut
                continue
            cell = f"{quote}=cmd|'/k x'!A0{quote}"
            assert csv_links(f"a{delimiter}{cell}{delimiter}b\n"), (delimiter, quote)
    for innocent in ("a,b,c\n1,2,3\n", "", "=SUM(a1:a2)", "plain | text!"):
        assert csv_links(innocent) == []


def padded_package(ole, n=10_050):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(n):
            z.writestr(f"p{i}", b"")
        z.writestr("word/vbaProject.bin", ole)
    return out.getvalue()


def test_all_members_of_a_package_are_read(monkeypatch):
    ole = cfb.write({"a": b"x" * 5000})
    data = padded_package(ole)
    assert len(list(formats.zip_parts(data))) == 10_051
    assert list(tables.inner_ole(data)) == [ole]
    monkeypatch.setattr(formats, "MOST", 100)
    rows = {name: (part, error) for name, part, _, error in formats.zip_parts(padded_package(ole, 1))}
    assert rows == {"p0": (b"", None), "word/vbaProject.bin": (ole[:100], "longer than 100 bytes")}
    monkeypatch.setattr(formats, "MOST", len(ole))
    assert [e for *_, e in formats.zip_parts(padded_package(ole, 1))] == [None, None]


def test_active_mime_behind_many_decoys():
    import zlib

    head = b"ActiveMime" + bytes(0x232)
    for decoys in (b"x" * 5000, b"x\x9c" * 5000):
        assert formats.active_mime(head + decoys + zlib.compress(b"content")) == b"content"
    with pytest.raises(ValueError):
        formats.active_mime(head + b"x" * 5000)
