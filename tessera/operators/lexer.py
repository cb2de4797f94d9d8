"""Tokens of C and C++ texts."""

from __future__ import annotations

import re
import string
from itertools import accumulate, compress
from operator import sub
from typing import NamedTuple

#: A directive, or blanks and what follows them: names that no quote follows and brackets come first, as most tokens are of
#: these, and nothing else begins as they do. Blanks end before the line of a directive, and may be all there is, so that
#: none are tried twice.
#: The pieces follow upon each other without a gap, so that their lengths tell their places.
_RAW = r"""(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)"|"""
_ANY = (
    r"""^[ \t]*\#(?:[^\n\\]|\\.)*|[^\S\n]*+(?:\n(?![^\S\n]*\#)[^\S\n]*+)*+(?:~?[^\W\d]\w*+(?!["'])|[(){}\[\];,]|//[^\n]*|/\*.*?(?:\*/|\Z)|"""
    + _RAW
    + r"""(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"?|(?:u8|[uUL])?'(?:\\.|[^'\\\n])*'?"""
    r"""|~?[^\W\d]\w*|\.?\d(?:[\w.']|[eEpP][+-])*|::|->\*?|<<=|>>=|<=>|[-+*/%&|^=!<>]=|&&|\|\||\+\+|--|\.\.\.|\S|\n|)"""
)
_PIECE = re.compile(f"({_ANY})", re.S | re.M)
#: The same for texts without raw strings: what has no groups is found in less than half the time.
_PLAIN = re.compile(_ANY.replace(_RAW, ""), re.S | re.M)
#: What a token is by its first character, where that is enough. A name that begins as a string's prefix does is none if a
#: quote is in it.
_KINDS = dict.fromkeys(set(string.ascii_letters + "_") - set("uULR"), "name") | dict.fromkeys(string.digits, "number") | dict.fromkeys("\"'", "string") | dict.fromkeys("(){}[];,:<>=!&|^*%+-?", "op")


def _kind(x: str) -> str | None:
    """Of the others, but for a #; none for a comment."""
    c = x[0]
    if c == "/":
        return None if x.startswith(("//", "/*")) else "op"
    if c == ".":
        return "number" if x[1:2].isdecimal() else "op"
    if c == "~":
        return "name" if len(x) > 1 else "op"
    if c == "_" or c.isalnum() and not c.isdecimal():
        return "string" if '"' in x or "'" in x else "name"
    return "number" if c.isdecimal() else "op"


class Token:
    """made: whether a macro made it; then its place is that of the macro's use."""

    __slots__ = ("kind", "text", "start", "end", "made")

    def __init__(self, kind: str, text: str, start: int, end: int, made: bool = False):
        self.kind, self.text, self.start, self.end, self.made = kind, text, start, end, made


class Columns(NamedTuple):
    """Tokens by column, as most of what is asked of them is of their texts alone. made is none where no macro made any."""

    said: list[str]
    kinds: list[str]
    starts: list[int]
    ends: list[int]
    made: list[bool] | None = None

    def only(self, kept) -> Columns:
        """Those whose place has a true value."""
        return Columns(*[x and list(compress(x, kept)) for x in self])

    def tokens(self) -> list[Token]:
        return list(map(Token, self.kinds, self.said, self.starts, self.ends))

    @classmethod
    def of(cls, t: list[Token]) -> Columns:
        return cls([x.text for x in t], [x.kind for x in t], [x.start for x in t], [x.end for x in t], [x.made for x in t])


def columns(text: str, limit: int | None = None) -> Columns:
    """The tokens of a text without comments; at most `limit` of them, and the next."""
    pieces = _PLAIN.findall(text) if 'R"' not in text else [x for x, _ in _PIECE.findall(text)]
    said = list(map(str.lstrip, pieces))
    ends = list(accumulate(map(len, pieces)))
    # Blanks alone have no kind.
    kinds = [_KINDS.get(x[0]) if x else "" for x in said]
    for i in [i for i, kind in enumerate(kinds) if kind is None]:
        if said[i][0] != "#":
            kinds[i] = _kind(said[i])
            continue
        # A directive is all that begins its line with blanks and a #.
        piece = pieces[i]
        start = ends[i] - len(piece)
        if (not start or text[start - 1] == "\n") and piece.lstrip(" \t")[0] == "#":
            kinds[i], said[i] = "pp", piece
        else:
            kinds[i] = "op"
    out = Columns(said, kinds, list(map(sub, ends, map(len, said))), ends)
    out = out if all(kinds) else out.only(kinds)
    return Columns(*[x and x[: limit + 1] for x in out]) if limit else out


def tokens(text: str, limit: int | None = None) -> list[Token]:
    """As columns, a token each."""
    return columns(text, limit).tokens()
