"""The macros of a text, expanded where they shape what is declared.

A table of the text's own definitions is kept along its tokens. A use is expanded, with all that it holds, if what it comes
to has a brace, or if it begins a declaration, has brackets behind a name, and a body follows: then it makes a declarator.
All other uses stay as they are written, since a reader asks for the names in the source. What a macro makes has the place
of its use, and an argument its own, so that all places are those of the source. A macro is not expanded within itself,
its arguments included. Other files' macros aren't known.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from tessera.operators.lexer import Columns, Token, tokens

#: So many tokens are made of one text at most; beyond, it is read without its macros, and a warning says so.
MOST = 200_000
_DEFINE = re.compile(r"\s*#\s*define[ \t]+([^\W\d]\w*)(\([^)]*\))?(.*)", re.S)
_UNDEF = re.compile(r"\s*#\s*undef\s+([^\W\d]\w*)")
_BRANCH = re.compile(r"\s*#\s*(if|el|endif)")
_SCOPES = {"namespace", "class", "struct", "union", "extern"}
_BEFORE_BODY = {"{", "const", "noexcept", "override", "final", ":"}


class Macro(NamedTuple):
    #: None of one without brackets; "..." is __VA_ARGS__.
    params: tuple[str, ...] | None
    body: list[Token]


class TooMuch(Exception):
    pass


def _defined(text: str) -> tuple[str, Macro] | None:
    m = _DEFINE.match(text)
    if m is None:
        return None
    body = tokens(m[3].replace("\\\n", "  "))
    if m[2] is None:
        return m[1], Macro(None, body)
    names = [x.strip() for x in m[2][1:-1].replace("\\\n", " ").split(",")]
    return m[1], Macro(tuple("__VA_ARGS__" if x == "..." else x.removesuffix("...") for x in names if x), body)


def _brackets(t: list[Token]) -> dict[int, int]:
    """Where each round bracket that is closed is closed."""
    opened, shut = [], {}
    for i, x in enumerate(t):
        if x.kind == "op" and x.text == "(":
            opened.append(i)
        elif x.kind == "op" and x.text == ")" and opened:
            shut[opened.pop()] = i
    return shut


def _arguments(t: list[Token], i: int, shut: int) -> list[list[Token]]:
    """What stands between the brackets at i and shut, cut at its commas."""
    args: list[list[Token]] = [[]]
    depth = 0
    for x in t[i + 1 : shut]:
        if x.kind == "pp":
            continue
        depth += (x.text == "(") - (x.text == ")")
        if x.text == "," and not depth:
            args.append([])
        else:
            args[-1].append(x)
    return args


class _Table:
    """The macros that are known at a place of the text."""

    def __init__(self):
        self.known: dict[str, Macro] = {}
        self.left = MOST
        #: Of each conditional that is open: the names that its earlier branches define, and its present one.
        self.branches: list[tuple[set[str], set[str]]] = []
        self.seen: dict[str, tuple[bool, bool]] = {}

    def directive(self, text: str) -> None:
        if m := _BRANCH.match(text):
            if m[1] == "if":
                self.branches.append((set(), set()))
            elif self.branches:
                earlier, own = self.branches.pop()
                if m[1] == "el":
                    self.branches.append((earlier | own, set()))
        elif d := _defined(text):
            # Of branches that define a name the first counts, as with braces that they share.
            if not any(d[0] in earlier for earlier, _ in self.branches):
                self.known[d[0]] = d[1]
                self.seen = {}
            for _, own in self.branches:
                own.add(d[0])
        elif (m := _UNDEF.match(text)) and self.known.pop(m[1], None):
            self.seen = {}

    def makes(self, name: str) -> tuple[bool, bool]:
        """Whether a macro comes to a brace, and to brackets behind a name, by itself or by those that it holds."""
        if name not in self.seen:
            reached, waiting = {name}, [name]
            brace = call = False
            while waiting:
                m = self.known[waiting.pop()]
                for k, x in enumerate(m.body):
                    brace = brace or x.kind == "op" and x.text in "{}"
                    call = call or x.text == "(" and k > 0 and m.body[k - 1].kind == "name" or x.text == "(" and k == 0
                    if x.kind == "name" and x.text in self.known and x.text not in reached:
                        reached.add(x.text)
                        waiting.append(x.text)
            self.seen[name] = brace, call
        return self.seen[name]

    def replaced(self, m: Macro, args: list[list[Token]], use: Token, end: int) -> list[Token]:
        """The body of a macro with its arguments."""
        own = dict(zip(m.params or (), args))
        if m.params and m.params[-1] == "__VA_ARGS__" and len(args) > len(m.params):
            own["__VA_ARGS__"] = [x for k, a in enumerate(args[len(m.params) - 1 :]) for x in ([Token("op", ",", use.start, end, True)] if k else []) + a]
        out: list[Token] = []
        paste, k, body = False, 0, m.body
        while k < len(body):
            x = body[k]
            if x.text == "#" and k + 1 < len(body) and body[k + 1].text == "#":
                paste, k = True, k + 2
                continue
            if x.text == "#" and k + 1 < len(body) and body[k + 1].text in own:
                new = [Token("string", '"' + " ".join(y.text for y in own[body[k + 1].text]).replace('"', '\\"') + '"', use.start, end, True)]
                k += 1
            else:
                new = own[x.text] if x.kind == "name" and x.text in own else [Token(x.kind, x.text, use.start, end, True)]
            k += 1
            if paste and out and new:
                out[-1] = Token(out[-1].kind, out[-1].text + new[0].text, use.start, end, True)
                new = new[1:]
            paste = False
            self.left -= len(new) + 1
            if self.left < 0:
                raise TooMuch
            out += new
        return out

    def expanded(self, use: list[Token]) -> list[Token]:
        """A use with its arguments, and all uses in what it comes to."""
        out: list[Token] = []
        waiting = [(use, _brackets(use), 0, frozenset())]
        while waiting:
            t, shut, i, hidden = waiting.pop()
            while i < len(t):
                x = t[i]
                m = self.known.get(x.text) if x.kind == "name" and x.text not in hidden else None
                if m is None or m.params is not None and i + 1 not in shut:
                    out.append(x)
                    i += 1
                    continue
                args, i = ([], i + 1) if m.params is None else (_arguments(t, i + 1, shut[i + 1]), shut[i + 1] + 1)
                waiting.append((t, shut, i, hidden))
                t, i, hidden = self.replaced(m, args, use[0], use[-1].end), 0, hidden | {x.text}
                shut = _brackets(t)
        return out


def expand(c: Columns) -> tuple[Columns, str | None]:
    """The tokens with the macros expanded that make braces or declarators, and a warning if they would make too many."""
    defined = {m[1] for x, kind in zip(c.said, c.kinds) if kind == "pp" and "define" in x and (m := _DEFINE.match(x))}
    # What isn't used isn't expanded.
    if defined.isdisjoint(c.said):
        return c, None
    t = c.tokens()
    table, shut, out, i = _Table(), _brackets(t), [], 0
    # Whether each open brace is a scope of declarations; what has led to this place since the last brace or semicolon.
    scopes: list[bool] = []
    lead: list[str] = []

    def take(x: Token) -> None:
        out.append(x)
        if x.kind == "op" and x.text in "{};":
            if x.text == "{":
                scopes.append(all(scopes[-1:]) and bool(_SCOPES.intersection(lead)) and "(" not in lead)
            elif x.text == "}" and scopes:
                scopes.pop()
            lead.clear()
        else:
            lead.append(x.text)

    try:
        while i < len(t):
            x = t[i]
            if x.kind == "pp":
                table.directive(x.text)
                out.append(x)
                i += 1
                continue
            m = table.known.get(x.text) if x.kind == "name" else None
            if m is None or m.params is not None and i + 1 not in shut:
                take(x)
                i += 1
                continue
            end = i + 1 if m.params is None else shut[i + 1] + 1
            brace, call = table.makes(x.text)
            after = t[end].text if end < len(t) else ""
            body_follows = after in _BEFORE_BODY or after in table.known and table.makes(after)[0]
            if brace or call and not lead and all(scopes[-1:]) and body_follows:
                for y in table.expanded(t[i:end]):
                    take(y)
                i = end
            else:
                take(x)
                i += 1
    except TooMuch:
        return c, f"macros expand to over {MOST} tokens"
    return Columns.of(out), None
