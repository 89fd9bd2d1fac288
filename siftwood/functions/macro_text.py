"""Column functions over macro source text: clean-up, indicators, encoded strings, flags.

All but the Dridex and expression decoders are JVM expressions. Patterns get
(?U) where word characters are meant in the Unicode sense.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_long_lines(code: Column) -> Column:
    """Continuation marks and their line ends become one space."""
    return F.regexp_replace(code, " _(?:\r\n|\r|\n)", " ")


def drop_attributes(code: Column) -> Column:
    """Without the leading attribute lines (those with a colon stay), line ends as \\n, none at the end."""
    lines = F.regexp_replace(F.regexp_replace(code, "\r\n|\r|\x0b|\x0c|\x1c|\x1d|\x1e|\x85| | ", "\n"), "\n\\z", "")
    return F.regexp_replace(lines, "\\A(?:Attribute VB_[^:\n]*(?:\n|\\z))+", "")


def is_printable(text: Column) -> Column:
    return ~text.rlike("[^\\x20-\\x7E\\t\\n\\r\\x0B\\x0C]")


def utf8(data: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def _keywords(rows: list[tuple[str, str]], escaped: bool) -> list[tuple[str, str]]:
    return [(d, rf"(?iU)\b{re.escape(k) if escaped else k}\b") for d, k in rows]


AUTOEXEC = _keywords(V.keyword_table(V.AUTOEXEC_WORDS), True) + _keywords(V.keyword_table(V.AUTOEXEC_PATTERNS), False)
SUSPICIOUS = _keywords(V.keyword_table(V.SUSPICIOUS_WORDS), True) + _keywords(V.keyword_table(V.SUSPICIOUS_PATTERNS), False)
FOUND = "array<struct<ord:int,keyword:string,description:string>>"


def plain_tokens(code: Column) -> Column:
    """The distinct runs of word characters of the code, in the one case that a case-blind match compares."""
    low = F.lower(code)
    for odd, plain in (("\u017f", "s"), ("\u0131", "i"), ("i\u0307", "i")):
        low = F.replace(low, F.lit(odd), F.lit(plain))
    words = F.when(code.rlike(r"[^\x00-\x7F]"), F.split(low, r"(?U)\W+")).otherwise(F.split(low, r"\W+"))  # the Unicode classes are slow
    return F.array_distinct(words)


def _tables(table: list[tuple[str, str]]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows (ord, words, pattern, description) of keywords that are words, in fixed order or alone; of word endings; and of what takes a pattern in any case, with its words' beginnings."""
    words, endings, rest = [], [], []
    for i, (d, pattern) in enumerate(table):
        body = pattern.removeprefix(r"(?iU)\b").removesuffix(r"\b")
        if body.startswith(r"\w+_"):
            endings.append((i, [body[4:].lower()], pattern, d))
        elif re.fullmatch(r"(?:\w|\\\W|-)+", body):
            words.append((i, re.findall(r"\w+", re.sub(r"\\(\W)", r" \1", body).lower()), pattern, d))
        else:
            first = re.match(r"(?:\(\?<![^)]*\))?(?:\\\.\\s\*)?(\w+)", body)
            rest.append((i, [first[1].lower()[:-1] if body[first.end() :].startswith("?") else first[1].lower()], pattern, d))
    return words, endings, rest


def _rows(rows: list[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.array(*map(F.lit, w)).alias("words"), F.lit(p).alias("pattern"), F.lit(d).alias("description")) for i, w, p, d in rows])


def find_keywords(code: Column, table: list[tuple[str, str]], note: Column | None = None, tokens: Column | None = None) -> Column:
    """Array of (ord, keyword as found first, description) of the table's keywords in the code. tokens: plain_tokens().

    A keyword's pattern is looked for only where all of its words are among the tokens: these are intersected with the
    table's words once."""
    suffix = note if note is not None else F.lit("")
    words, endings, rest = _tables(table)

    def known(rows: list[tuple], have: Column) -> Column:
        every = F.array(*[F.lit(w) for w in dict.fromkeys(w for _, ws, _, _ in rows for w in ws)])

        def found(met: Column) -> Column:
            some = F.filter(_rows(rows), lambda r: F.forall(r["words"], lambda w: F.array_contains(met, w)))
            hits = F.transform(some, lambda r: F.struct(r["ord"].alias("ord"), F.call_function("regexp_extract", code, r["pattern"], F.lit(0)).alias("keyword"), F.concat(r["description"], suffix).alias("description")))
            return F.when(F.size(met) > 0, hits).otherwise(F.array().cast(FOUND))

        return let(F.array_intersect(have, every), found)

    def search(tokens: Column) -> Column:
        parts = [known(words, tokens)]
        if endings:
            parts.append(known(endings, F.transform(F.filter(tokens, lambda t: F.locate("_", t) > 1), lambda t: F.substring_index(t, "_", -1))))
        if rest:
            starts = "|".join(re.escape(w) for _, ws, _, _ in rest for w in ws)
            own = [F.struct(F.lit(i).alias("ord"), F.regexp_extract(code, p, 0).alias("keyword"), F.concat(F.lit(d), suffix).alias("description")) for i, _, p, d in rest]
            parts.append(F.when(F.exists(tokens, lambda t: t.rlike(f"^(?:{starts})")), F.array(*own)).otherwise(F.array().cast(FOUND)))
        return F.filter(F.concat(*parts), lambda x: x["keyword"] != "")

    return search(tokens) if tokens is not None else let(plain_tokens(code), search)


def find_autoexec(code: Column, note: Column | None = None, tokens: Column | None = None) -> Column:
    return find_keywords(code, AUTOEXEC, note, tokens)


def find_suspicious(code: Column, note: Column | None = None, plain: Column | None = None, tokens: Column | None = None) -> Column:
    """plain: whether the code is as it was written (a backspace counts only there)."""
    back = F.struct(F.lit(len(SUSPICIOUS)).alias("ord"), F.lit("\b").alias("keyword"), F.lit(V.BACKSPACE_NOTE).alias("description"))
    is_plain = plain if plain is not None else F.lit(True)
    return F.concat(find_keywords(code, SUSPICIOUS, note, tokens), F.when(is_plain & F.contains(code, F.lit("\b")), F.array(back)).otherwise(F.array().cast(FOUND)))


def find_iocs(code: Column) -> Column:
    """Array of (ord, keyword, description = kind): addresses and names, each value once over all kinds."""
    kinds = []
    signs = (F.contains(code, F.lit("://")), code.rlike(r"\d\.\d"), F.contains(code, F.lit("@")), code.rlike(rf"(?i)\.(?:{V.EXECUTABLES})"))  # what every match holds
    for (kind, pattern), sign in zip(V.IOC_PATTERNS, signs, strict=True):
        p = pattern if "(?i)" not in pattern else pattern.replace("(?i)", "(?iU)")
        kinds.append(F.when(sign, _tagged(F.regexp_extract_all(code, F.lit(p), F.lit(0)), kind)).otherwise(F.array().cast("array<struct<keyword:string,description:string>>")))
    every = F.filter(F.concat(*kinds), lambda x: ~(x["keyword"].startswith(V.EXCLUDED_URLS[0]) | x["keyword"].startswith(V.EXCLUDED_URLS[1])))
    first = let(every, lambda x: first_of_each(x, lambda y: y["keyword"]))
    return F.transform(first, lambda x, i: F.struct(i.cast("int").alias("ord"), x["keyword"].alias("keyword"), x["description"].alias("description")))


def first_of_each(rows: Column, key: Callable[[Column], Column]) -> Column:
    """An array without the elements whose key an element before has."""

    def some(keys: Column) -> Column:
        firsts = F.filter(rows, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), rows).otherwise(firsts)

    return let(F.transform(rows, key), some)


def _tagged(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("keyword"), F.lit(kind).alias("description")))


def hex_strings(code: Column) -> Column:
    """Array of (encoded, decoded), each encoded string once."""
    return F.transform(F.array_distinct(F.regexp_extract_all(code, F.lit(V.HEX_STRING), F.lit(0))), lambda v: F.struct(v.alias("encoded"), utf8(F.unhex(v)).alias("decoded")))


def base64_strings(code: Column) -> Column:
    quoted = F.regexp_extract_all(code, F.lit(f'"({V.BASE64_STRING})"'), F.lit(1))
    own = F.filter(F.array_distinct(quoted), lambda v: v.rlike(V.NOT_HEX) & ~F.lower(v).isin(*V.BASE64_NOT))
    return F.transform(own, lambda v: F.struct(v.alias("encoded"), utf8(F.unbase64(v)).alias("decoded")))


def dridex_decode(text: str) -> str | None:
    """The decoded string, or None. Four signs at either end are padding. In the middle of the rest stand two numbers of two
    signs, whose difference is the width of a group; in the middle of what is left, the divisor; each group of digits left,
    divided, is a character of 0 to 255. Letters in a number count as 0 in the first two, and are passed over elsewhere."""
    body = text[4:-4]
    at = len(body) // 2
    pair = body[at - 2 : at], body[at : at + 2]
    if not all(pair):
        return None
    low, high = (int(re.sub("[^0-9]", "0", x)) for x in pair)
    body, width = body[: at - 2] + body[at + 2 :], high - low
    from_, to = len(body) // 2 - width // 2, len(body) // 2 + width // 2
    groups = body[:from_] + body[to:]
    numbers = [re.sub("[^0-9]", "", x) for x in (body[from_:to], *(groups[i : i + width] for i in range(0, len(groups) if width else 0, width or 1)))]
    if not width or not all(numbers) or not int(numbers[0]):
        return None
    values = [int(x) // int(numbers[0]) for x in numbers[1:]]
    return None if any(v > 255 for v in values) else "".join(map(chr, values))


def dridex_strings(code: Column) -> Column:
    quoted = F.transform(F.array_distinct(F.regexp_extract_all(code, F.lit(V.DRIDEX_STRING), F.lit(0))), lambda v: F.substring(v, F.lit(2), F.length(v) - 2))
    own = F.filter(quoted, lambda v: v.rlike(V.NOT_HEX))

    @F.arrow_udf("array<struct<encoded:string,decoded:string>>")
    def decode(lists):
        import pyarrow as pa

        rows = [[{"encoded": x, "decoded": d} for x in xs or [] if (d := dridex_decode(x)) is not None] for xs in lists.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("encoded", pa.string()), ("decoded", pa.string())])))

    return decode(own)


def flags(code: Column) -> tuple[Column, Column, Column]:
    """First match of each: runs by itself, writes, executes ('' if none)."""
    return tuple(F.regexp_extract(code, p.replace("(?i)", "(?iU)"), 0) for p in (V.FLAG_AUTOEXEC, V.FLAG_WRITE, V.FLAG_EXECUTE))


def is_suspicious(code: Column) -> Column:
    """Runs by itself, and writes or executes."""
    a, w, x = (code.rlike(p.replace("(?i)", "(?iU)")) for p in (V.FLAG_AUTOEXEC, V.FLAG_WRITE, V.FLAG_EXECUTE))
    return a & (w | x)


def hexdump(text: Column) -> Column:
    """Array of (offset, hex, shown) of each 16 bytes."""
    data = text.cast("binary")
    n = F.octet_length(data)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(16))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(
            i.alias("offset"),
            F.hex(F.substring(data, i + 1, F.lit(16))).alias("hex"),
            F.regexp_replace(F.regexp_replace(F.decode(F.substring(data, i + 1, F.lit(16)), "ISO-8859-1"), "[^\\x20-\\x7E]", "."), "\u0000", ".").alias("shown"),
        ),
    )
