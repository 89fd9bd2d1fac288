"""Macro scan: seven variants of the code, findings with their order, summaries and verdicts.

A code table has file_id and code. Each variant (as written; decoded hex; and so
on) is one element of an array in the file's row; each category's matches are built-in
expressions over it. A finding's place is (category, variant, order in its table);
of equal keywords in one category of a file the first stays. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import macro_text as M
from ..functions.expressions import expressions

VARIANTS = ("", "Hex", "Hex+StrReverse", "StrReverse+Hex", "Base64", "Dridex", "VBA expression")
PAIRS = "array<struct<encoded:string,decoded:string>>"
DETECTED = V.DETECTED
LABELS = {"hex": "Hex String", "base64": "Base64 String", "dridex": "Dridex string", "vba": "VBA string"}


def expression_strings(code: Column) -> Column:
    @F.arrow_udf(PAIRS)
    def run(codes):
        import pyarrow as pa

        rows = [[{"encoded": e, "decoded": d} for e, d in expressions(c or "")] for c in codes.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("encoded", pa.string()), ("decoded", pa.string())])))

    return run(code)


def decode_strings(rows: DataFrame, deobfuscate: bool = False) -> DataFrame:
    """rows with hex, base64, dridex and vba: arrays of (encoded, decoded)."""
    code = F.col("code")
    none = F.array().cast(PAIRS)
    # The decoder in Python is run only where its pattern occurs.
    maybe = rows.withColumn("hex", M.hex_strings(code)).withColumn("base64", M.base64_strings(code)).withColumn("dridex", F.when(code.rlike(V.DRIDEX_STRING), M.dridex_strings(code)).otherwise(none))
    return maybe.withColumn("vba", F.coalesce(expression_strings(code), none) if deobfuscate else none)


def _lines(pairs: Column, turn=lambda x: x["decoded"]) -> Column:
    """Each decoded string behind a line end, joined."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.lit("\n"), turn(x))), "")


def variants() -> Column:
    """Array of (variant, name, code) of the variants that have text. Of rows of decode_strings()."""
    turned = F.contains(F.lower("code"), F.lit("strreverse"))
    codes = [
        F.col("code"),
        _lines(F.col("hex")),
        F.when(turned, _lines(F.col("hex"), lambda x: F.reverse(x["decoded"]))).otherwise(""),
        F.when(turned, _lines(F.col("hex"), lambda x: M.utf8(F.unhex(F.reverse(x["encoded"]))))).otherwise(""),
        _lines(F.col("base64")),
        _lines(F.col("dridex")),
        _lines(F.col("vba")),
    ]
    each = [F.struct(F.lit(i).alias("variant"), F.lit(name).alias("name"), c.alias("code")) for i, (name, c) in enumerate(zip(VARIANTS, codes, strict=True))]
    return F.filter(F.array(*each), lambda x: x["code"] != "")


def _found(category: Column, variant: Column, ord_: Column, keyword: Column, description: Column) -> Column:
    rank = F.when(category == "AutoExec", 0).when(category == "Suspicious", 1).when(category == "IOC", 2).otherwise(3)
    return F.struct(rank.alias("rank"), variant.cast("int").alias("variant"), ord_.cast("int").alias("ord"), category.alias("category"), keyword.alias("keyword"), description.alias("description"))


def found_in_rows() -> Column:
    """Array of all findings of a row before any is dropped as a repetition. Of rows of decode_strings(). One pass over the code, and no shuffle."""

    def of_variant(v: Column) -> Column:
        note = F.when(v["name"] == "", "").otherwise(F.concat(F.lit(" (obfuscation: "), v["name"], F.lit(")")))

        def tagged(category: str, found: Column, suffix: Column | None = None) -> Column:
            return F.transform(found, lambda x: _found(F.lit(category), v["variant"], x["ord"], x["keyword"], x["description"] if suffix is None else F.concat(x["description"], suffix)))

        def search(tokens: Column) -> Column:
            return F.concat(tagged("AutoExec", M.find_autoexec(v["code"], note, tokens)), tagged("Suspicious", M.find_suspicious(v["code"], note, v["name"] == "", tokens)), tagged("IOC", M.find_iocs(v["code"]), note))

        return M.let(M.plain_tokens(v["code"]), search)

    noted = F.array(*[F.when(F.size(k) > 0, _found(F.lit("Suspicious"), F.lit(len(VARIANTS)), F.lit(i), F.lit(word), F.lit(text))) for i, (k, word, text) in enumerate(DETECTED)])
    return F.concat(F.flatten(F.transform(variants(), of_variant)), F.filter(noted, lambda x: x.isNotNull()))


def raw_findings(rows: DataFrame) -> DataFrame:
    """file_id, category, variant, ord, keyword, description of all findings before any is dropped as a repetition."""
    return rows.select("file_id", F.inline(found_in_rows())).drop("rank")


def decoded_in_rows(show_all: bool = False) -> Column:
    """Array of the decoded strings of a row as findings; only printable ones unless show_all."""

    def of_kind(place: int, kind: str, label: str) -> Column:
        own = F.transform(kind, lambda x, k: _found(F.lit(label), F.lit(len(VARIANTS) + 1 + place), k, x["decoded"], x["encoded"]))
        return own if show_all else F.filter(own, lambda x: M.is_printable(x["keyword"]))

    return F.concat(*[of_kind(i, kind, label) for i, (kind, label) in enumerate(LABELS.items())])


def findings_in_rows(show_all: bool = False) -> Column:
    """Array of what a scan reports of a row, in order; of equal keywords of a category the first."""
    once = M.let(F.sort_array(found_in_rows()), lambda x: M.first_of_each(x, lambda y: F.concat_ws("\0", y["category"], y["keyword"])))
    return F.concat(once, F.sort_array(decoded_in_rows(show_all)))


def findings(rows: DataFrame, show_all: bool = False) -> DataFrame:
    """file_id, ordinal, type, keyword, description: what a scan reports, in order. rows: of decode_strings(), one a file."""
    each = rows.select("file_id", F.posexplode(findings_in_rows(show_all)).alias("at", "x"))
    return each.select("file_id", (F.col("at") + 1).alias("ordinal"), F.col("x.category").alias("type"), "x.keyword", "x.description")


def summary(rows: DataFrame) -> DataFrame:
    """file_id and counts before repetitions are dropped."""
    return triage(rows).drop("flags")


def triage(rows: DataFrame, type_tag: str | Column = "TXT", macros: Column | None = None) -> DataFrame:
    """Counts and the flag string: a letter or '-' for macros, autoexec, suspicious, IOCs, hex, base64, Dridex and expressions. rows: of decode_strings(), one a file."""
    has = macros if macros is not None else F.lit(True)
    tag = F.lit(type_tag) if isinstance(type_tag, str) else type_tag
    kinds = rows.select("file_id", *LABELS, F.transform(found_in_rows(), lambda x: x["rank"]).alias("ranks"), has.alias("has"), tag.alias("tag"))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in LABELS]

    def of_rank(k: int) -> Column:
        return F.size(F.filter("ranks", lambda r: r == k)).cast("long")

    s = kinds.select("file_id", *sizes, *[of_rank(k).alias(f"n_{n}") for k, n in enumerate(("autoexec", "suspicious", "iocs"))], "has", "tag")
    letters = [F.when(F.col("has"), "M").otherwise("-")] + [F.when(F.col(c) > 0, x).otherwise("-") for x, c in zip("ASIHBDV", ("n_autoexec", "n_suspicious", "n_iocs", "n_hex", "n_base64", "n_dridex", "n_vba"), strict=True)]
    return s.withColumn("flags", F.concat(F.col("tag"), F.lit(":"), *letters)).drop("has", "tag")


def flag_verdicts(rows: DataFrame) -> DataFrame:
    """file_id, the three flags' first matches, flags, suspicious, verdict and exit_code."""
    a, w, x = M.flags(F.col("code"))
    out = rows.select("file_id", a.alias("autoexec"), w.alias("writes"), x.alias("executes"))
    out = out.withColumn("flags", F.concat(*[F.when(F.col(c) != "", letter).otherwise("-") for c, letter in (("autoexec", "A"), ("writes", "W"), ("executes", "X"))]))
    out = out.withColumn("suspicious", (F.col("autoexec") != "") & ((F.col("writes") != "") | (F.col("executes") != "")))
    out = out.withColumn("verdict", F.when(F.col("suspicious"), "SUSPICIOUS").otherwise("Macro OK"))
    return out.withColumn("exit_code", F.when(F.col("suspicious"), V.VERDICT_CODES["SUSPICIOUS"]).otherwise(V.VERDICT_CODES["Macro OK"]))


def revealed_code() -> Column:
    """The code with expressions replaced by what they evaluate to, longest first. Of rows of decode_strings(deobfuscate=True)."""
    code = M.drop_attributes(M.collapse_long_lines(F.col("code")))
    shown = F.filter("vba", lambda x: M.is_printable(x["decoded"]))
    indexed = F.transform(shown, lambda x, i: F.struct((-F.length(x["encoded"])).alias("k"), i.alias("i"), x["encoded"].alias("e"), x["decoded"].alias("d")))

    def quoted(x: Column) -> Column:
        q = F.concat(F.lit('"'), F.replace(x["d"], F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(x["e"].startswith("(") & x["e"].endswith(")"), F.concat(F.lit("("), q, F.lit(")"))).otherwise(q)

    return F.aggregate(F.array_sort(indexed), code, lambda acc, x: F.replace(acc, x["e"], quoted(x)))


def reveal(rows: DataFrame) -> DataFrame:
    """file_id and the revealed code. rows: of decode_strings(deobfuscate=True)."""
    return rows.select("file_id", revealed_code().alias("code"))
