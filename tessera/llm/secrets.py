"""Secret scans: fixed patterns, and what an assignment-aware reading of a text adds.

The reading lexes a text as source or configuration code, whichever it is: names, flags, strings (with prefixes, escapes,
three quotes, back-quotes), marks, line ends, and gaps (blanks, continued lines, short comments). Then
  1  targets and values are parsed into pairs: name = value, name: value, "name": value, name := value, name => value,
     box["name"] = value, name: type = value, type name = value, name type = value, --name value, --name=value,
     set name value, #define name value, <name>value</name>, key="name" value="value", f("name", value), and YAML values on
     the lines below, with | or > or without. A value is strings and names joined by + . .. & or by standing together (over
     line ends too), in any brackets, the strings of a call or of a list, or a bare word, which ends before &name= ; and what
     stands for it by or, ||, ??, ?: or a condition;
  2  constants are carried on: what a name is given, it gives to the names that are given it, whichever comes first, to a
     fixpoint. So each name is as sensitive as the most sensitive name that it reaches;
  3  a value is scored by that and by how much it looks like a value rather than a word, path or placeholder; the literals
     of those above the threshold are spans, without their quotes. Blanks are for passphrases alone, and a string within a
     call that is a key's name itself is none.
A text without any part of a sensitive name is not lexed: no literal of it could reach one.

All of it is linear in the text. A text is scanned whole, however long, by a worker that holds one batch. Spans are in code
points, end exclusive.

Cases: null or empty text has no spans. Repeated rows give a row each. A null doc_id is kept. Extra columns are ignored,
whatever their names; redaction keeps them. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import trimmed

_any_case = lambda x: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in x)
ASSIGN = re.compile("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

_LEXER = re.compile(
    r"""(?P<tag><(?P<of>[A-Za-z_][\w.\-]*+)>(?P<inner>[^<>\n]{2,}+)</(?P=of)>)"""
    r"""|(?P<triple>(?:\b[rRbBfFuU]{1,2})?(?:\"{3}(?P<t1>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}(?P<t2>(?:[^'\\]|\\.|'(?!''))*+)'{3}))"""
    r"""|(?P<string>(?<![^\W_])(?:[rRbBfFuUL]{1,2}(?=["']))?(?:"(?P<s1>(?:[^"\\\n]|\\.)*+)"|'(?P<s2>(?:[^'\\\n]|\\.)*+)'|`(?P<s3>(?:[^`\\\n]|\\.)*+)`))"""
    r"""|(?P<gap>[\x20\t\r]++|\\\r?\n|/\*[^*=:]*+\*/)|(?P<line>\n)|(?P<flag>--[A-Za-z][\w.\-]*+)|(?P<name>[^\W\d][\w.\-]*+)"""
    r"""|(?P<mark>:=|=>|===?|!=|<=|>=|::|\.\.|[=:+.&|>,;()\[\]{}*?!-])|(?P<other>[^\s"'`A-Za-z=:+.&|>,;()\[\]{}*?!-]++|.)""",
    re.S,
)
#: As in a query string, the next name ends a value.
_BARE = re.compile(r"(?:[A-Za-z0-9+/_.=$@!%^*-]|&(?![A-Za-z_][\w.-]*=))++")
_NAME = re.compile(r"[^\W\d][\w.]*\Z")
_KEY = re.compile(r"[^\W\d][\w.\- ]*\Z")
_BLOCK = re.compile(r"[\x20\t]*[|>][+-]?[\x20\t]*\n")
_ASSIGNS, _JOINS = {"=", ":", ":=", "=>"}, {"+", ".", "..", "&"}
_COMPARES = {"==", "!=", "<", ">", "<=", ">=", "is", "in"}
_IN_TYPES = {"::", "[", "]", ".", "&", "|", "*", "?", ",", ">", "-"}
#: Parts of target names and how far each speaks for a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "pw": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authorization": 0.8, "bearer": 0.8, "auth": 0.6, "key": 0.5, "salt": 0.5, "signature": 0.4, "mnemonic": 1.0}
#: Parts that make a name harmless.
HARMLESS = {"public", "field", "label", "length", "count", "limit", "max", "min", "type", "name", "path", "file", "url", "hint", "help", "column", "id"}
#: Words that stand for a value, or say that there is none.
PLACEHOLDERS = {"none", "null", "true", "false", "changeme", "example", "todo", "undefined"}
#: Names whose values may have blanks, and words that only text about them has.
PHRASES = {"passphrase", "password", "passwd", "pwd", "mnemonic"}
SAYS = {"enter", "your", "please", "must", "invalid", "incorrect", "required", "wrong", "forgot", "reset", "confirm", "change", "type", "password", "passwords", "passphrase", "characters", "empty"}
THRESHOLD = 0.6
#: No name is sensitive that holds none of these.
_STEMS = re.compile("(?i)" + "|".join(sorted({"pass", "pwd", "pw", "secret", "token", "key", "cred", "auth", "bearer", "salt", "signature", "mnemonic"})))
#: Ends of names that are written as one word.
_ENDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey")
_KEY_WORDS = re.compile(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*")


def _name_parts(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+(?![a-z])", name)]


def sensitivity(name: str) -> float:
    parts = _name_parts(name)
    if not parts or parts[-1] in HARMLESS or "public" in parts:
        return 0.0
    words = parts + [a + b for a, b in zip(parts, parts[1:])] + [end for end in _ENDS if parts[-1].endswith(end)]
    return max((SENSITIVE.get(p, 0.0) for p in words), default=0.0)


def _stands_for(head: str, last: str, n: int, chars: Counter) -> bool:
    """Whether a literal is a placeholder, by its first twelve characters, the last, its length and which it has."""
    low = head.lower()
    return n <= 12 and low in PLACEHOLDERS or low.startswith(("your_", "your-", "$")) or n > 2 and set(chars) <= {"x", "X"} or len(chars) == 1 and head[0] in "*." or head[0] + last in ("<>", "%%")


def looks(chars: Counter, head: str, last: str) -> float:
    """0 to 1: how much a literal of these characters, which begins and ends so, looks like a secret value."""
    n = chars.total()
    if n < 6 or _stands_for(head, last, n, chars):
        return 0.0
    kinds = any("a" <= c <= "z" for c in chars) + any("A" <= c <= "Z" for c in chars) + any("0" <= c <= "9" for c in chars) + any(not (c.isascii() and c.isalnum()) for c in chars)
    entropy = -sum(c / n * math.log2(c / n) for c in chars.values())
    return min(1.0, 0.3 * (kinds - 1) + entropy / 6 + (0.1 if n >= 16 else 0.0))


def _phrase(name: str, literal: str) -> bool:
    """Whether a literal with blanks can be what this name is given."""
    words, parts = literal.lower().split(), set(_name_parts(name))
    return bool(PHRASES & parts) and len(words) >= (2 if "passphrase" in parts else 3) and not SAYS.intersection(w.strip(".,:;!?'") for w in words)


class _Bare(NamedTuple):
    """A bare word that may be a name."""

    name: str
    start: int
    end: int


def _span(part) -> tuple[int, int]:
    return part[1:] if isinstance(part, _Bare) else tuple(part)


#: Where the text of a token is, by its kind.
_INNER = {"tag": ("inner",), "triple": ("t1", "t2"), "string": ("s1", "s2", "s3")}


class _Pair(NamedTuple):
    """A target and the parts of a value: a part is a literal's (start, end), or a bare word. within: a call has them."""

    name: str
    parts: list
    within: bool = False


class _Reader:
    """A text's tokens, (kind, start, end, inner start, inner end) without gaps, and what is assigned to what."""

    def __init__(self, text: str):
        self.text, self.tokens, self.pairs = text, [], []
        opened, self.shut = [], {}
        for m in _LEXER.finditer(text):
            kind = m.lastgroup
            if kind == "gap":
                continue
            inner = next((m.span(g) for g in _INNER.get(kind, ()) if m[g] is not None), m.span())
            if kind == "mark" and m[0] == "(":
                opened.append(len(self.tokens))
            elif kind == "mark" and m[0] == ")" and opened:
                self.shut[opened.pop()] = len(self.tokens)
            self.tokens.append((kind, *m.span(), *inner))
        self.starts = [t[1] for t in self.tokens]
        # Past either end there are blank ones.
        self.kinds = [t[0] for t in self.tokens] + [""] * 4
        self.words = [text[t[3] : t[4]] for t in self.tokens] + [""] * 4
        #: The bare word that was read last: any place in it ends where it does.
        self.bare = (0, 0)
        #: What a key="name" has just named, and where it ended.
        self.named: tuple[str, int] | None = None

    def word(self, i: int) -> str:
        return self.words[i]

    def kind(self, i: int) -> str:
        return self.kinds[i]

    def mark(self, i: int, *words: str) -> bool:
        return self.kinds[i] == "mark" and self.words[i] in words

    def after_lines(self, i: int) -> int:
        while self.kind(i) == "line":
            i += 1
        return i

    def is_string(self, i: int) -> bool:
        return self.kind(i) in ("string", "triple")

    def bare_at(self, i: int) -> tuple[int, int] | None:
        at = self.tokens[i][1]
        if not self.bare[0] <= at < self.bare[1]:
            m = _BARE.match(self.text, at)
            if m is None:
                return None
            self.bare = m.span()
        return at, self.bare[1]

    def is_call(self, i: int) -> int | None:
        """The bracket that opens behind the name at i, without a blank, and is closed."""
        b = self.bare_at(i)
        j = bisect_left(self.starts, b[1], i + 1) if b else i
        return j if b and self.mark(j, "(") and self.tokens[j][1] == b[1] and j in self.shut else None

    def atom(self, i: int) -> tuple[list, int]:
        """The parts of the string or bare word at i, and where it ends; no parts if there is none."""
        kind = self.kind(i)
        if self.is_string(i):
            return [self.tokens[i][3:5]], i + 1
        if not kind or kind == "line" or (span := self.bare_at(i)) is None:
            return [], i
        a, b = span
        j = bisect_left(self.starts, b, i + 1)
        if self.mark(j, "(", "[") and self.tokens[j][1] == b:
            return [], i  # a call, or a place in something
        return [_Bare(self.text[a:b], a, b) if _NAME.match(self.text, a, b) else (a, b)], j

    def joined(self, i: int) -> tuple[list, int]:
        """The parts of a joined value at i, and where it ends."""
        k = self.after_lines(i)
        if k > i and not self.is_string(k):
            return [], i  # a value on the next line is a string
        parts, depth, begin = [], 0, i
        while True:
            while self.mark(k, "("):
                k, depth = k + 1, depth + 1
            more, k = self.atom(self.after_lines(k) if depth else k)
            if not more:
                return [], begin
            parts += more
            while True:
                j = self.after_lines(k)
                if depth and self.mark(j, ")"):
                    k, depth = j + 1, depth - 1
                else:
                    break
            if self.joins(j):
                k = self.after_lines(j + 1)
                if not (self.mark(k, "(") or self.atom(k)[0]):
                    break
            elif self.is_string(j) and self.is_string(j - 1 if j == k else k - 1) and not self.mark(j + 1, *_ASSIGNS):
                k = j
            else:
                break
        return (parts, k) if not depth else ([], begin)

    def joins(self, i: int) -> bool:
        """An & joins values if blanks stand before it; else it is of a query string or an address."""
        return self.mark(i, *_JOINS) and (self.word(i) != "&" or self.tokens[i - 1][2] < self.tokens[i][1])

    def strings(self, i: int, end: int) -> Iterator[int]:
        """The strings between brackets, of which those in further brackets are passed over."""
        while i < end:
            if self.is_string(i):
                yield i
            i = self.shut.get(i, i) + 1

    def value(self, i: int) -> tuple[list[_Pair], int]:
        """The values that may stand at i, as pairs without a name, and where they end."""
        k = self.after_lines(i)
        if self.mark(k, "["):
            # A list of strings.
            out, j = [], self.after_lines(k + 1)
            while self.is_string(j):
                out.append(_Pair("", [self.tokens[j][3:5]]))
                j = self.after_lines(j + 1)
                j = self.after_lines(j + 1) if self.mark(j, ",") else j
            return (out, j + 1) if self.mark(j, "]") else ([], i)
        out, j = self.operand(i)
        while True:
            if k := self.otherwise(j):
                more, j = self.operand(k)
            elif self.mark(j, "?") or self.mark(j, *_COMPARES) or self.kind(j) == "name" and self.word(j) in _COMPARES:
                # A condition is no value; what it chooses from is.
                if not self.mark(j, "?"):
                    j = self.operand(j + 1)[1]
                if not self.mark(j, "?"):
                    return [], i
                out, j = self.operand(j + 1)
                more, j = self.operand(j + 1) if self.mark(j, ":") else ([], j)
            elif self.kind(j) == "name" and self.word(j) == "if" and out:
                at = self.operand(j + 1)[1]
                if self.mark(at, *_COMPARES) or self.kind(at) == "name" and self.word(at) in _COMPARES:
                    at = self.operand(at + 1)[1]
                if not (self.kind(at) == "name" and self.word(at) == "else"):
                    return out, j
                more, j = self.operand(at + 1)
            else:
                return out, j
            if not more:
                return out, j
            out = out + more

    def otherwise(self, i: int) -> int | None:
        """Where what stands for a value begins, behind or, ||, ?? or ?: at i."""
        if self.kinds[i] == "name":
            return i + 1 if self.words[i] == "or" else None
        return i + 2 if self.mark(i, "|", "?") and self.mark(i + 1, "|", "?", ":") else None

    def operand(self, i: int) -> tuple[list[_Pair], int]:
        """A joined value, or what a call has as strings."""
        if self.kind(i) == "name" and (opens := self.is_call(i)) is not None:
            return [_Pair("", [self.tokens[k][3:5]], True) for k in self.strings(opens + 1, self.shut[opens])], self.shut[opens] + 1
        parts, j = self.joined(i)
        return ([_Pair("", parts)], j) if parts else ([], i)

    def below(self, i: int) -> list:
        """The YAML value on the lines below the colon at i: what is indented further, if it isn't a mapping."""
        text, at = self.text, self.tokens[i][2]
        m = _BLOCK.match(text, at)
        if m is None and self.kind(i + 1) != "line":
            return []
        begin = text.rfind("\n", 0, at) + 1
        indent = len(text[begin:at]) - len(text[begin:at].lstrip(" \t-"))
        at = m.end() if m else self.tokens[i + 1][2]
        rows = []
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            row = text[at:end]
            own = row.strip()
            if own and len(row) - len(row.lstrip()) <= indent:
                break
            if own:
                rows.append((at + row.index(own[0]), at + len(row.rstrip())))
            at = end + 1
            if m is None:
                break
        if m is None and rows and not _BARE.fullmatch(text, *rows[0]):
            return []
        return rows

    def give(self, names, values: list[_Pair]) -> None:
        self.pairs.extend(v._replace(name=n.rstrip(".-")) for n in dict.fromkeys(names) for v in values)

    def read(self) -> None:
        t = self.tokens
        for i, (kind, *_) in enumerate(t):
            if kind == "tag":
                m = _LEXER.match(self.text, t[i][1])
                self.give([m["of"]], [_Pair("", [t[i][3:5]])])
            elif kind == "flag" and not self.mark(i + 1, "="):
                if self.kind(i + 1) != "line" and (values := self.value(i + 1)[0]):
                    self.give([self.word(i).lstrip("-")], values)
            elif kind == "name" and self.word(i).lower() == "set" and not self.mark(i - 1, "-"):
                j = i + 1
                while self.mark(j, "-") and self.kind(j + 1) == "name":
                    j += 2
                if self.kind(j) == "name" and self.kind(j + 1) not in ("line", "") and not self.mark(j + 1, *_ASSIGNS):
                    values, k = self.value(j + 1)
                    if values and not self.mark(k, *_ASSIGNS):
                        self.give([self.word(j)], values)
            elif kind == "name" and self.word(i) == "define" and self.word(i - 1).endswith("#") and self.kind(i + 1) == "name":
                self.give([self.word(i + 1)], self.value(i + 2)[0] if self.kind(i + 2) != "line" else [])
            elif kind == "mark" and self.word(i) == "(" and self.kind(i - 1) == "name" and self.is_string(i + 1) and self.mark(i + 2, ",") and _KEY.match(self.word(i + 1)):
                self.give([self.word(i + 1)], self.value(i + 3)[0])
            elif kind == "mark" and self.word(i) == "(" and self.is_string(i + 1) and self.mark(i + 2, ")") and (k := self.otherwise(i + 3)) and _KEY.match(self.word(i + 1)):
                self.give([self.word(i + 1)], self.operand(k)[0])
            elif kind == "mark" and self.word(i) in _ASSIGNS and i:
                self.assignment(i)

    def assignment(self, i: int) -> None:
        names = []
        k = i - 1
        if self.word(k) == "]" and self.kind(k - 1) == "string":  # box["name"] =
            names.append(self.word(k - 1))
        elif self.kind(k) in ("name", "flag"):
            names.append(self.word(k).lstrip("-"))
            if self.kind(k - 1) == "name" and self.word(i) != ":":  # name type =
                names.append(self.word(k - 1))
        elif self.kind(k) == "string" and _KEY.match(self.word(k)):
            names.append(self.word(k))
        if not names:
            # name: type[of, it] =
            if self.word(i) != "=" or self.word(k) not in ("]", ">", "?"):
                return
        if self.word(i) == "=":
            # What stands between a colon and an equals sign is a type, if there is only what types are made of. An equals
            # sign isn't, so no token is passed twice.
            while k >= 0 and (self.kind(k) in ("name", "other") or self.mark(k, *_IN_TYPES)):
                k -= 1
            if self.word(k) == ":" and self.kind(k - 1) == "name":
                names.append(self.word(k - 1))
        values, j = self.value(i + 1)
        if self.word(i) == ":":
            parts = values[0].parts if len(values) == 1 else []
            if len(parts) == 1 and isinstance(parts[0], _Bare) and self.mark(j, "=", "[", "<"):
                return  # a type
            if not values and (rows := self.below(i)):
                values = [_Pair("", rows)]
        # key="name" value="..", and - name: NAME with value: .. below.
        if names and names[0].lower() == "value" and self.named and self.named[1] == i - 1:
            names.append(self.named[0])
        self.named = None
        if names and names[0].lower() in ("key", "name", "id") and len(values) == 1 and len(values[0].parts) == 1:
            while self.kind(j) == "line" or self.mark(j, ",", "-"):
                j += 1
            self.named = (self.text[slice(*_span(values[0].parts[0]))], j)
        self.give(names, values)


def _characters(text: str, spans: set[tuple[int, int]]) -> dict[tuple[int, int], Counter]:
    """How often each literal has each character. Those with one end, as in a=b=c, are counted from that end on, once."""
    by_end: dict[int, list[int]] = {}
    for a, b in spans:
        by_end.setdefault(b, []).append(a)
    out = {}
    for b, starts in by_end.items():
        chars: Counter = Counter()
        until = b
        for a in sorted(starts, reverse=True):
            chars.update(text[a:until])
            until = a
            out[a, b] = chars.copy() if len(starts) > 1 else chars
    return out


def literals(text: str) -> list[tuple[int, int]]:
    """The literals that reach a sensitive name, directly or through constants."""
    if not _STEMS.search(text):
        return []
    r = _Reader(text)
    r.read()
    known = {p.name for p in r.pairs}
    # A bare word that is a known name stands for what that name is given.
    pairs = [p._replace(parts=[x.name if isinstance(x, _Bare) and x.name in known and x.name != p.name else x for x in p.parts]) for p in r.pairs]
    own = {n: sensitivity(n) for n in known}
    reach, waiting = dict(own), [n for n in known if own[n]]
    given: dict[str, set[str]] = {}
    for n, parts, _ in pairs:
        given.setdefault(n, set()).update(p for p in parts if isinstance(p, str))
    while waiting:
        n = waiting.pop()
        for m in given.get(n, ()):
            if reach[m] < reach[n]:
                reach[m] = reach[n]
                waiting.append(m)
    # What a name is given as a literal stands for it where values are joined.
    told = {n: _span(parts[0]) for n, parts, _ in pairs if len(parts) == 1 and not isinstance(parts[0], str)}
    show = lambda p: told.get(p) if isinstance(p, str) else _span(p)
    wanted = {x for n, parts, _ in pairs if reach[n] for p in parts if (x := show(p))}
    chars = _characters(text, wanted)
    found, until = set(), 0
    for n, parts, within in pairs:
        spans = [_span(p) for p in parts if not isinstance(p, str)]
        # In a run like key=x=y the value of x lies within that of key.
        if not (s := reach[n]) or not spans or len(spans) == 1 and spans[0][1] == until:
            continue
        whole = [x for p in parts if (x := show(p)) and x[0] < x[1]]
        if not whole:
            continue
        head = ""
        for a, b in whole:
            if len(head) >= 12:
                break
            head += text[a : min(b, a + 12)]
        count = chars[whole[0]] if len(whole) == 1 else sum((chars[x] for x in whole), Counter())
        look = looks(count, head[:12], text[whole[-1][1] - 1])
        if " " in count and not (len(whole) == 1 and not within and _phrase(n, text[slice(*whole[0])])):
            look = 0.0
        if look and within and _KEY_WORDS.fullmatch(text, *whole[0]) and sensitivity(text[slice(*whole[0])]):
            look = 0.0
        if s * look >= THRESHOLD * 0.5 and look >= THRESHOLD:
            found.update(x for x in spans if x[0] < x[1])
            until = spans[-1][1]
    return sorted(found)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then kind: the base spans, and literals that no base span of the text covers."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(x in low for x in ("password", "passwd", "secret", "token", "api")):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text or "--" in text or "set" in low:
        base = sorted((a, b) for _, a, b in spans)
        starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        covered = lambda a, b: (i := bisect_right(starts, a)) > 0 and reach[i - 1] >= b
        spans += [("literal", a, b) for a, b in literals(text) if not covered(a, b)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    for batch in batches:
        rows = [scan(t.as_py()) for t in batch.column("text")]
        base = [[x for x in r if x[0] != "literal"] for r in rows]
        counts = [pa.array([sum(x[0] == k for x in r) for r in rows], pa.int64()) for k in KINDS]
        yield pa.record_batch(
            [batch.column("doc_id").cast(pa.int64()), *counts, pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base]), pa.array(map(_joined, rows), pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans, a row per document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_scan), "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")


def redacted(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with each stretch of spans replaced by a mask."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += (text[at:a], mask)
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked; n_chars, where it is a column, follows the text."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            new = pa.array([redacted(t.as_py()) for t in batch.column(i)], batch.schema.field(i).type)
            yield batch.set_column(i, batch.schema.field(i), new)

    out = docs.mapInArrow(trimmed(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6(docs: DataFrame) -> DataFrame:
    return find_secrets(docs)
