"""Byte-level BPE vocabulary files, and the exact cutting of texts into pieces that encode apart.

A text is cut before each space that follows a character other than white space.
No pre-token of the byte-level pattern crosses such a place: a pre-token that
holds a space behind its first character consists of white space alone. So each
piece has the same tokens alone as in its text, and pieces can be remembered.
"""

from __future__ import annotations

import json
import re

SPACE_AFTER_SPACE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")
#: Most pieces: letters of the first three Latin blocks, then punctuation, and the like once more after a line end.
LATIN, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", re.escape("!\"#$%&()*+,-./:;=?@[]_{|}~")
PLAIN = re.compile(rf"( ?[{LATIN}]+)([{MARKS}]*)(?:(\n)([{LATIN}]+)([{MARKS}]*))?")
#: Longer pieces are not remembered.
LONG_PIECE = 64
#: Characters of texts that are taken together.
SLICE = 2_000_000


def pieces(text: str) -> list[str]:
    if not text:
        return []
    if SPACE_AFTER_SPACE.search(text) is None and text[0] != " ":
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]
    return CUT.split(text)


def byte_alphabet() -> dict[int, str]:
    """Byte to the character that stands for it in the file: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    return table | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class BpeFile:
    """vocab: token to id; merges: pairs in rank order; special: added strings to id; words(text): pre-tokens and special ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None
        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        to_char = byte_alphabet()
        self.to_byte = {c: b for b, c in to_char.items()}
        self._chars = {b: c for b, c in to_char.items() if chr(b) != c}

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; special strings are themselves."""
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        out = [b""] * size
        for token, i in self.vocab.items():
            out[i] = bytes(self.to_byte[c] for c in token)
        for token, i in self.special.items():
            out[i] = token.encode()
        return out

    def words(self, piece: str) -> list[str | int]:
        """Pre-tokens of a piece in the file's alphabet; an id for a special string."""
        if m := PLAIN.fullmatch(piece):  # no more than a shortcut: the library splits these alike
            plain = piece.isascii()
            return [w.replace(" ", "\u0120").replace("\n", "\u010a") if plain else w.encode().decode("latin-1").translate(self._chars) for w in m.groups() if w]
        if self._special is None or "<" not in piece and not self._special.search(piece):
            return [w for w, _ in self._split(piece)]
        out: list[str | int] = []
        at = 0
        for m in self._special.finditer(piece):
            out += [w for w, _ in self._split(piece[at : m.start()])] if at < m.start() else []
            out.append(self.special[m.group()])
            at = m.end()
        return out + ([w for w, _ in self._split(piece[at:])] if at < len(piece) else [])


def slices(texts, most: int = SLICE):
    """Lists of consecutive texts of an Arrow array with about that many characters together, and one at least. Nulls become empty."""
    held, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held
