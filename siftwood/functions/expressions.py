"""Evaluator of constant string expressions in macro source, by recursive descent.

text    := term (('&' | '+') term)*
term    := quoted | function | '(' text ')' | number-valued function
integer := sums of products; here * binds tighter than /, / than -, - than +.

Only expressions count (more than a quoted string alone); what can't be evaluated
is skipped. Division must be exact.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"\r\n]|"")*")|(?P<hex>&[hH][0-9A-Fa-f]+[%&^]?)|(?P<oct>&[oO][0-7]+[%&^]?)|(?P<int>\d+[%&^]?)|(?P<name>[A-Za-z_]\w*\$?)|(?P<op>[-+*/&(),]))')
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{4})+(?:[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=|[A-Za-z0-9+/][AQgw]==)?\Z")
_HEX = re.compile(r"(?:[0-9A-Fa-f]{2})+\Z")
DEEPEST = 60


class _Stop(Exception):
    pass


class _Parser:
    def __init__(self, line: str):
        self.tokens: list[tuple[str, str, int, int]] = []
        at = 0
        while at < len(line):
            m = _TOKEN.match(line, at)
            if m is None:
                self.tokens.append(("bad", line[at], at, at + 1))
                at += 1
                continue
            kind = m.lastgroup
            self.tokens.append((kind, m[kind], m.start(kind), m.end()))
            at = m.end()
        self.at = 0
        self.depth = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at][:2] if self.at < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> str:
        kind, value = self.peek()
        if kind == "end" or text is not None and value != text:
            raise _Stop
        self.at += 1
        return value

    # integers: + over - over / over *
    def integer(self) -> int:
        return self._chain("+", lambda: self._chain("-", lambda: self._chain("/", lambda: self._chain("*", self._atom))))

    def _chain(self, op: str, inner) -> int:
        value = inner()
        while self.peek() == ("op", op):
            self.take()
            right = inner()
            if op == "/":
                if right == 0 or value % right:
                    raise _Stop
                value //= right
            else:
                value = value + right if op == "+" else value - right if op == "-" else value * right
        return value

    def _atom(self) -> int:
        kind, value = self.peek()
        if kind in ("int", "hex", "oct"):
            self.take()
            digits = value.rstrip("%&^")
            return int(digits, 10) if kind == "int" else int(digits[2:], 16 if kind == "hex" else 8)
        if value == "(":
            return self._nested(self.integer)
        if kind == "name" and value.lower() in ("asc", "val"):
            self.take()
            text = self._nested(self.text)
            try:
                return ord(text[0]) if value.lower() == "asc" else int(text.strip())
            except (IndexError, ValueError):
                raise _Stop from None
        raise _Stop

    def _nested(self, inner):
        self.take("(")
        self.depth += 1
        if self.depth > DEEPEST:
            raise _Stop
        value = inner()
        self.depth -= 1
        self.take(")")
        return value

    def text(self) -> str:
        value = self._text_term()
        while self.peek() in (("op", "&"), ("op", "+")):
            back = self.at
            try:
                self.take()
                value += self._text_term()
            except _Stop:
                self.at = back
                break
        return value

    def _text_term(self) -> str:
        kind, value = self.peek()
        if kind == "str":
            self.take()
            return value[1:-1].replace('""', '"')
        if value == "(":
            return self._nested(self.text)
        if kind != "name":
            raise _Stop
        name = value.lower().rstrip("$")
        self.take()
        if name in ("chr", "chrb", "chrw"):
            n = self._nested(self.integer)
            if not 0 <= n <= 0x10FFFF or 0xD800 <= n <= 0xDFFF:
                raise _Stop
            return chr(n)
        if name == "strreverse":
            return self._nested(self.text)[::-1]
        if name == "environ":
            return f"%{self._nested(self.text)}%"
        if self.peek()[1] == "(" and self.at + 2 < len(self.tokens) and self.tokens[self.at + 1][0] == "str" and self.tokens[self.at + 2][1] == ")":
            inner = self.tokens[self.at + 1][1][1:-1]
            data = binascii.unhexlify(inner) if _HEX.match(inner) else base64.b64decode(inner) if _BASE64.match(inner) else None
            if data is not None:  # some decoding function of a hex or base64 string
                self.at += 3
                return data.decode("utf-8", "replace")
        raise _Stop


def expressions(code: str) -> Iterator[tuple[str, str]]:
    """(encoded, decoded) of the string expressions of each line, each encoded text once."""
    seen: set[str] = set()
    for line in code.expandtabs().splitlines():
        parser = _Parser(line)
        start = 0
        while start < len(parser.tokens):
            parser.at, parser.depth = start, 0
            try:
                value = parser.text()
            except _Stop:
                start += 1
                continue
            first, last = parser.tokens[start], parser.tokens[parser.at - 1]
            encoded = line[first[2] : last[3]]
            alone = parser.at - start == 1  # a quoted string is no expression
            if not alone and encoded != value and encoded not in seen:
                seen.add(encoded)
                yield encoded, value
            start = parser.at
