"""DDE links and fields: field filters, quoted fields, formulas in CSV cells, SYLK macro sheets.

Inputs are tables with file_id and a text column.
"""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V

MODES = ("all", "dde", "exclude harmless")
SMALL = 1024


def is_dde_field(field: Column) -> Column:
    return field.rlike(V.FIELD_DDE)


def is_harmless_field(field: Column) -> Column:
    """Whether a field is a call of a harmless command with fitting arguments and switches.

    The words of a field are quoted strings or runs without blanks. The state is the
    kind of the word expected: 0 a switch, 1 any argument, 2 a text format, 3 a text
    format of a string, -1 wrong."""
    words = F.regexp_extract_all(field, F.lit(r'"[^"]*"|\S+'), F.lit(0))
    table = V.field_table()
    grammar = F.create_map(*[x for k, (a, b, c, d, e) in table.items() for x in (F.lit(k), F.struct(F.lit(a).alias("least"), F.lit(a + b).alias("most"), F.lit(c).alias("with"), F.lit(d).alias("solo"), F.lit(e).alias("format")))])

    def check(words: Column, g: Column) -> Column:
        rest = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
        switches = F.filter(F.transform(rest, lambda w, i: F.when(w.startswith("\\"), i)), lambda i: i.isNotNull())
        n = F.coalesce(F.get(switches, F.lit(0)), F.size(rest))
        tail = F.slice(rest, n + 1, F.greatest(F.size(rest) - n, F.lit(0)))

        def step(state: Column, w: Column) -> Column:
            c = F.substring(w, 2, 1)
            fmt = g["format"]
            after_switch = (
                F.when(~w.rlike(r"(?U)^\\[\w#*@]$"), -1)
                .when(F.contains(g["solo"], c), 0)
                .when(F.contains(g["with"], c), 1)
                .when((c == "#") & F.contains(fmt, F.lit("numeric")), 1)
                .when((c == "@") & F.contains(fmt, F.lit("datetime")), 1)
                .when(c == "*", F.when(F.contains(fmt, F.lit("numeric")), 1).when(F.contains(fmt, F.lit("string")), 3).otherwise(2))
                .otherwise(-1)
            )
            general = w.isin("CHARFORMAT", "MERGEFORMAT")
            return (
                F.when(state == -1, -1)
                .when(state == 1, 0)
                .when(state == 2, F.when(general, 0).otherwise(-1))
                .when(state == 3, F.when(general | w.isin("Caps", "FirstCap", "Lower", "Upper"), 0).otherwise(-1))
                .otherwise(after_switch)
            )

        good = F.aggregate(tail, F.lit(0), step) != -1
        return (n >= g["least"]) & (n <= g["most"]) & good

    # try_element_at: a command outside the table has no grammar, and is not harmless
    g = F.try_element_at(grammar, F.lower(F.get(words, F.lit(0))))
    return F.coalesce(F.when(F.size(words) > 0, check(words, g)), F.lit(False))


def filter_fields(rows: DataFrame, field: str = "field", mode: str = "exclude harmless") -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    f = F.col(field)
    return rows if mode == "all" else rows.where(is_dde_field(f)) if mode == "dde" else rows.where(~is_harmless_field(f))


def unquote(field: Column) -> Column:
    """A QUOTE field's numbers as characters; other fields as they are."""
    parts = F.split(F.trim(field), " ")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    # F.char() knows 256 characters; a number is written as big-endian UTF-32 and read again.
    number = lambda p: F.when(p.rlike(r"^[+]?[0-9]{1,9}$"), p.cast("long"))
    wide = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    chars = F.transform(rest, lambda p: F.when(number(p) < 0x110000, wide(number(p))).otherwise(p))
    return F.when(F.contains(field, F.lit("QUOTE")), F.array_join(chars, "")).otherwise(field)


def formula_link(cell: Column) -> Column:
    """'program arguments' of a DDE formula; null if it is none."""
    p = rf"\A{V.CSV_DDE}"
    return F.when(cell.rlike(p), F.concat(F.regexp_extract(cell, p, 1), F.lit(" "), F.regexp_extract(cell, p, 2)))


_CSV_DDE = re.compile(V.CSV_DDE)


def csv_links(text: str) -> list[str]:
    """DDE links in the cells of CSV text: sniffed delimiter; for small texts without links other delimiters, then all as one cell."""

    def read(delimiters: str) -> tuple[list[str], str]:
        dialect = csv.Sniffer().sniff(text[:SMALL], delimiters=delimiters)
        dialect.strict = False
        out = []
        for row in csv.reader(io.StringIO(text, newline=""), dialect):
            out += [" ".join(m.groups()[:2]) for m in map(_CSV_DDE.match, row) if m]
        return out, dialect.delimiter

    links, used = [], ""
    try:
        links, used = read(V.CSV_DELIMITERS)
    except csv.Error:
        pass
    if links or len(text) >= SMALL:
        return links
    for d in V.CSV_DELIMITERS.replace(used, "") if used else V.CSV_DELIMITERS:
        try:
            links = read(d)[0]
        except csv.Error:
            continue
    if not links and (m := _CSV_DDE.match(text[:SMALL])):
        links = [" ".join(m.groups()[:2])]
    return links


def csv_dde(rows: DataFrame, text: str = "text") -> DataFrame:
    """file_id, ordinal, link. Texts without the signs of a formula never reach Python."""

    @F.arrow_udf("array<string>")
    def run(texts):
        import pyarrow as pa

        return pa.array([csv_links(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    t = F.col(text)
    some = rows.where(F.contains(t, F.lit("|")) & F.contains(t, F.lit("!")))
    return some.select("file_id", F.posexplode(run(t)).alias("ordinal", "link"))


def sylk_lines(text: str) -> list[str]:
    """sylk_macros() of one text."""
    out, sheet = [], False
    for line in re.split("\r\n|\r|\n", text):
        parts = line.split(";")
        sheet = sheet or line.startswith("O") and any(p.startswith("E") for p in parts)
        if sheet and line.startswith("NN"):
            out += [f"Named cell: {p[1:]}" for p in parts if p.startswith("N") and p.strip() != "NN"]
        elif sheet and line.startswith("C"):
            out += [f"Formula or Macro: {p[1:]}" for p in parts if p.startswith("E")]
    return out


def sylk_macros(rows: DataFrame, text: str = "text") -> DataFrame:
    """file_id, ordinal, macro: named cells and formulas behind a macro sheet's option row."""
    lines = rows.select("file_id", F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("seq", "line"))
    lines = lines.where(F.substring("line", 1, 1).isin("O", "N", "C"))  # other rows say nothing here
    parts = F.split("line", ";")
    option = F.col("line").startswith("O") & F.exists(parts, lambda p: p.startswith("E"))
    running = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    state = lines.withColumn("sheet", F.max(option.cast("int")).over(running) == 1).where("sheet")
    named = F.transform(F.filter(parts, lambda p: p.startswith("N") & (F.trim(p) != "NN")), lambda p: F.concat(F.lit("Named cell: "), F.substring(p, F.lit(2), F.length(p))))
    formula = F.transform(F.filter(parts, lambda p: p.startswith("E")), lambda p: F.concat(F.lit("Formula or Macro: "), F.substring(p, F.lit(2), F.length(p))))
    found = F.when(F.col("line").startswith("NN"), named).when(F.col("line").startswith("C"), formula)
    each = state.select("file_id", "seq", F.posexplode(found).alias("at", "macro"))
    order = Window.partitionBy("file_id").orderBy("seq", "at")
    return each.select("file_id", F.row_number().over(order).alias("ordinal"), "macro")


def relationships(rows: DataFrame) -> DataFrame:
    """External relationships of reported types: file_id, rel_type, target, tag. rows: file_id, type, mode, target."""
    kind = F.substring_index("type", "/", -1)
    out = rows.where((F.col("mode") == "External") & kind.isin(*V.RELATIONSHIP_TYPES)).select("file_id", kind.alias("rel_type"), "target")
    return out.withColumn("tag", F.when(F.lower("target").startswith("mhtml:"), "CVE-2021-40444"))
