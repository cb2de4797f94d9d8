"""Personal data: fixed patterns, and identifiers that are disguised, with their places in the source.

The fixed patterns (email, ip, card, phone) are read from the text as it is. Then transducers rewrite the text, one after
another, and each keeps what it replaced:
  1  characters: look-alikes of other scripts, full-width and mathematical forms, digits of any script, blanks and dashes
     of any kind become ASCII; characters without a width go;
  2  marks: [at], (dot), {@}, &#64; and their like become @ and . with the blanks around them;
  3  digits: runs of three or more spelled digits (English, German, French, Spanish, with "double", "plus", "dash" and "dot"
     between them) become digits, and O, o, I, l in groups of digits do;
  4  words: a bare "at", "arroba", "arobase", "klammeraffe" or a spaced @ between a name and a domain, and "dot", "punkt", "punto", "point" between the
     parts of an address, become @ and . ; "underscore", "dash" and "hyphen" in the name _ and -
Identifiers found in what comes out, that hold something rewritten, are mapped back through all transducers to the code
points of the source, and added if no fixed one of the kind covers them. They must pass more than the fixed ones: a domain
ends in letters, cards pass Luhn without being one digit throughout, nothing adjoins a letter or digit. Nine to fifteen
spelled digits that aren't a count up or down are a phone number, with or without a plus.

"at" between words is no disguise by itself: a dot of the domain must be disguised, too, or the name must hold a digit or
mark, as in "see j.doe at example.com".

Everything is linear in the text, and a text is scanned whole by a worker that holds one batch. Texts are independent
rows: there is no shuffle. Spans are in code points, end exclusive.

Cases: null and empty texts have no spans. Repeated rows give a row each. A null doc_id is kept. Extra columns are ignored,
whatever their names; redaction keeps them. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# A run of these that isn't part of a match holds no start of one: what follows it is the same from any place in it.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(x), 10)) for x in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)) and m[1]:
            yield m.span()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text) if "." in text else ():
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


class Rewritten:
    """A text and what it was made from: pieces (start, end) of the result that stand for (start, end) of the source; all
    else is as it was."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        self.pieces: list[tuple[int, int, int, int]] = []
        out, at, size = [], 0, 0
        for a, b, new in edits:
            out += (source[at:a], new)
            size += a - at
            self.pieces.append((size, size + len(new), a, b))
            size, at = size + len(new), b
        self.text = "".join(out) + source[at:] if edits else source
        self.starts = [p[0] for p in self.pieces]

    def back(self, a: int, b: int) -> tuple[int, int, bool]:
        """The source of the result's a to b, and whether something in it was rewritten."""
        i = bisect_right(self.starts, a) - 1
        # Pieces that became nothing, at the very start, stay outside; the last that begins at or before a tells the shift.
        start = a
        if i >= 0:
            s, e, x, y = self.pieces[i]
            start = x if s <= a < e else y + a - e
        j = bisect_right(self.starts, b - 1) - 1
        end = b
        if j >= 0:
            s, e, x, y = self.pieces[j]
            end = y if s <= b - 1 < e else y + b - e
        first = i if i >= 0 and self.pieces[i][1] > a else i + 1
        return start, end, first <= j


# Letters of other scripts (Cyrillic, Greek, Armenian, small capitals) that look like a Latin one.
_LOOKS = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "аαᴀɑ", "b": "Ьʙ", "c": "сϲᴄ", "d": "ԁᴅ", "e": "еᴇ", "g": "ɡց", "h": "һհ", "i": "іιıɪ", "j": "јϳᴊ", "k": "кκᴋ", "l": "ӏʟ", "m": "мᴍ", "n": "ոɴ", "o": "оοօᴏ", "p": "рρᴘ", "q": "ԛ", "s": "ѕſꜱ", "t": "тτᴛ", "u": "υսᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "хχ", "y": "уүʏ", "z": "ᴢ",
}
_LATIN = {c: latin for latin, like in _LOOKS.items() for c in like}


@lru_cache(4096)
def plain(c: str) -> str | None:
    """What a character becomes, or None if it stays."""
    if c.isascii():
        return None
    if c in _LATIN:
        return _LATIN[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Pd" or c == "\u2212":
        return "-"
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if c in "\u3002\uff61\u2024":
        return "."
    new = unicodedata.normalize("NFKC", c)
    return new if new != c and new.isascii() and len(new) == 1 else None


#: Characters beyond Latin-1 and its extensions that can be something else; what of them stays is told one by one.
_OTHER = re.compile("[\xa0\xad\u0131\u017f\u0250-\u02ff\u0370-\u058f\u0600-\u1dbf\u2000-\u214f\u2212\u2460-\u24ff\u3000-\u30ff\ua731\ufe00-\uffef\U00010000-\U0010ffff]")


def characters(text: str) -> Rewritten:
    if text.isascii():
        return Rewritten(text, [])
    return Rewritten(text, [(m.start(), m.end(), new) for m in _OTHER.finditer(text) if (new := plain(m[0])) is not None])


_AT, _DOT = "at|arroba|arobase|klammeraffe", "dot|punkt|punto|point"
_MARK = re.compile(rf"(?i)[ \t]{{0,3}}(?:[\[({{<][ \t]{{0,3}}(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))[ \t]{{0,3}}[\])}}>]|(?P<at2>&(?:\#0{{0,3}}64|\#x40|commat);)|(?P<dot2>&(?:\#0{{0,3}}46|\#x2e|period);))[ \t]{{0,3}}")
_OPENS = re.compile(r"[\[({<&]")


def marks(text: str) -> Rewritten:
    if not _OPENS.search(text):
        return Rewritten(text, [])
    return Rewritten(text, [(m.start(), m.end(), "@" if m["at"] or m["at2"] else ".") for m in _MARK.finditer(text)])


#: The names of digits.
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_REPEAT = {"double": 2, "triple": 3, "treble": 3}
_APART = r"(?:[\x20\t\n,/()-]{1,3}|\.)"
_PART = rf"(?:(?:(?:double|triple|treble)[\x20\t\n]{{1,3}})?(?:{_DIGIT}|o)|[0-9]{{1,4}}|{_DOT}|dash|hyphen|minus)(?![^\W_])"
_RUN = re.compile(rf"(?i)(?<![^\W_])(?:plus[\x20\t\n]{{1,3}}|\+[\x20]?)?(?:(?:double|triple|treble)[\x20\t\n]{{1,3}})?(?:{_DIGIT}|[0-9]{{1,4}})(?![^\W_])(?:{_APART}{_PART})++")
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{_DIGIT})(?![^\W_])")
_TOKEN = re.compile(rf"(?i)(?P<word>[^\W\d_]+)|(?P<num>[0-9]+)|(?P<apart>[^\w]+)")
_GROUP = re.compile(r"(?<![^\W_])(?=[0-9OoIl]*[0-9])(?=[0-9]*[OoIl])[0-9OoIl]{2,}(?![^\W_])")
_ROUND = str.maketrans("OoIl", "0011")


def _spelled(run: str) -> str:
    """The digits of a run of spelled ones."""
    out, times, tokens = [], 1, list(_TOKEN.finditer(run))
    for k, m in enumerate(tokens):
        kind, t = m.lastgroup, m[0].lower()
        if kind == "num":
            out.append(t)
        elif kind == "word":
            if t in SPELLED or t == "o":
                out.append(str(SPELLED.get(t, 0)) * times)
            times = _REPEAT.get(t, 1)
            out.append({"plus": "+", "dash": "-", "hyphen": "-", "minus": "-"}.get(t, "." if re.fullmatch(_DOT, t) else ""))
        elif t.strip() == "+":
            out.append("+")
        elif 0 < k < len(tokens) - 1 and "." not in (out[-1], "") and not re.fullmatch(_DOT, tokens[k + 1][0].lower()):
            # Blanks between spelled digits go, other marks stay. A point without blanks, as from [dot], is a point.
            by = t.strip(" \t\n,")
            numbers = tokens[k - 1].lastgroup == "num" or tokens[k + 1].lastgroup == "num"
            out.append("." if t == "." else by[:1] if by[:1] in set("-()") else " " if numbers and tokens[k + 1][0].lower() not in ("dash", "hyphen", "minus") else "")
    return "".join(out)


def digits(text: str) -> Rewritten:
    edits = []
    if _SPELLED.search(text):
        for m in _RUN.finditer(text):
            if sum(1 for _ in _SPELLED.finditer(m[0])) >= 3:
                edits.append((*m.span(), _spelled(m[0])))
    if any(c in text for c in "OoIl"):
        until, k, groups = 0, 0, []
        for m in _GROUP.finditer(text):
            while k < len(edits) and edits[k][1] <= m.start():
                k += 1
            if m.start() >= until and not (k < len(edits) and edits[k][0] < m.end()):
                groups.append((*m.span(), m[0].translate(_ROUND)))
                until = m.end()
        edits = sorted(edits + groups)
    return Rewritten(text, edits)


_DOT_WORD = rf"(?:[\x20\t]{{1,3}}(?:{_DOT})[\x20\t]{{1,3}}|[\x20\t]{{1,3}}\.[\x20\t]{{1,3}}|\.)"
_AT_WORD = re.compile(rf"(?i)[\x20\t]{{1,3}}(?:{_AT}|@)[\x20\t]{{1,3}}|[\x20\t]{{1,3}}@|@[\x20\t]{{0,3}}")
_DOMAIN = re.compile(rf"(?i)[a-z0-9][a-z0-9-]*+(?:{_DOT_WORD}[a-z0-9-]++)+")
#: Between the parts of a name there may be others.
_NAME_JOINS = rf"{_DOT}|underscore|dash|hyphen"
_NAME_WORD = rf"[\x20\t]{{1,3}}(?:{_NAME_JOINS})[\x20\t]{{1,3}}"
_TOD_WORD = rf"(?:[\x20\t]{{1,3}}(?:{'|'.join(x[::-1] for x in _NAME_JOINS.split('|'))})[\x20\t]{{1,3}}|\.)"
_NAME_BACK = re.compile(rf"(?i)[a-z0-9_%+-]++(?:{_TOD_WORD}[a-z0-9_%+-]++)*")
_JOINED = re.compile(rf"(?i)(?<![^\W_])[a-z0-9.+%]++([_-])at\1[a-z0-9]++(?:\1(?:{_DOT})\1[a-z0-9]++)++")
_DOTTED = re.compile(rf"(?i)(?<![\w.])[0-9]{{1,3}}(?:[\x20\t]{{0,3}}(?:{_DOT})[\x20\t]{{0,3}}[0-9]{{1,3}}|[\x20\t]{{0,3}}\.[\x20\t]{{0,3}}[0-9]{{1,3}}){{3}}(?!\w)")
_DOTS = re.compile(rf"(?i)[\x20\t]{{1,3}}(?:{_DOT}|\.)[\x20\t]{{1,3}}|[\x20\t]{{1,3}}\.|\.[\x20\t]{{1,3}}|(?:{_DOT})(?=[0-9])|(?<=[0-9])(?:{_DOT})")


def words(text: str) -> Rewritten:
    edits: list[tuple[int, int, str]] = []
    low, back = text.lower(), None
    worded = any(x in low for x in _DOT.split("|"))
    for m in _DOTTED.finditer(text):
        if found := [(x.start() + m.start(), x.end() + m.start(), ".") for x in _DOTS.finditer(m[0])]:
            edits += found
    for m in _JOINED.finditer(text) if worded and ("_at" in low or "-at" in low) else ():
        by = m[1]
        edits += [(x.start() + m.start(), x.end() + m.start(), "@" if x[0][1] in "aA" else ".") for x in re.finditer(rf"(?i){by}(?:at|{_DOT}){by}", m[0])]
    until = 0
    for m in _AT_WORD.finditer(text):
        if m.start() < until or not (d := _DOMAIN.match(text, m.end())):
            continue
        back = text[::-1] if back is None else back
        n = _NAME_BACK.match(back, len(text) - m.start())
        if n is None:
            continue
        name = max(len(text) - n.end(), until)
        if name >= m.start():
            continue
        end = d.end()
        dots = [x for x in re.finditer(rf"(?i){_DOT_WORD}", d[0])]
        # The domain ends in letters; what comes behind the last part of that kind isn't its.
        while dots and not re.fullmatch(r"(?i)[a-z]{2,24}", d[0][dots[-1].end() : end - d.start()]):
            end = d.start() + dots.pop().start()
        if not dots or text[end : end + 1] == "@":
            continue
        disguised = any(x[0] != "." for x in dots)
        before = list(re.finditer(rf"(?i){_NAME_WORD}", text[name : m.start()]))
        if m[0] == "@" and not disguised and not before:
            continue
        spaced_only = all(x[0].strip() == "." for x in dots)
        if "@" not in m[0] and spaced_only and not before and not re.search(r"[0-9._%+-]", text[name : m.start()]):
            continue
        if "@" in m[0] and not disguised and m[0].startswith("@") and m[0] != "@" and not before and "\n" in m[0]:
            continue
        said = lambda x: {"un": "_", "da": "-", "hy": "-"}.get(x.strip().lower()[:2], ".")
        edits += [(x.start() + name, x.end() + name, said(x[0])) for x in before]
        if m[0] != "@":
            edits.append((*m.span(), "@"))
        edits += [(x.start() + d.start(), x.end() + d.start(), ".") for x in dots if x[0] != "."]
        until = end
    out, at = [], 0
    for e in sorted(set(edits)):
        if e[0] >= at:
            out.append(e)
            at = e[1]
    return Rewritten(text, out)


TRANSDUCERS = (characters, marks, digits, words)


def normalise(text: str) -> list[Rewritten]:
    """The text through all transducers; the last has the outcome."""
    steps = []
    for f in TRANSDUCERS:
        steps.append(f(steps[-1].text if steps else text))
    return steps


def to_source(steps: list[Rewritten], a: int, b: int) -> tuple[int, int, bool]:
    changed = False
    for s in reversed(steps):
        a, b, here = s.back(a, b)
        changed |= here
    return a, b, changed


def _alone(text: str, a: int, b: int) -> bool:
    return not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Cards among groups of digits, whatever stands beside them: the first group that begins one, with as many more as can be."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        groups, i = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer("[0-9]+", m[0])], 0
        while i < len(groups):
            size, best = 0, None
            for j in range(i, len(groups)):
                size += groups[j][1] - groups[j][0]
                if size > 19:
                    break
                if size >= 12 and luhn(_digits(text[groups[i][0] : groups[j][1]])):
                    best = j
            if best is not None:
                yield groups[i][0], groups[best][1]
            i = i + 1 if best is None else best + 1


def _counted(d: str) -> bool:
    """Whether digits go up or down one by one, or stay."""
    return len({(int(y) - int(x)) % 10 for x, y in zip(d, d[1:])}) == 1


def _strict(kind: str, x: str) -> bool:
    if kind == "email":
        name, _, domain = x.partition("@")
        labels = domain.split(".")
        return bool(re.search("[A-Za-z0-9]", name)) and ".." not in name and name[0] != "." and bool(re.fullmatch("[A-Za-z]{2,24}", labels[-1])) and all(p[0] != "-" and p[-1] != "-" for p in labels)
    return kind != "card" or not _counted(_digits(x))


def disguised(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of identifiers that hold something rewritten, in the source's code points."""
    steps = normalise(text)
    if not any(s.pieces for s in steps):
        return []
    out, new = [], steps[-1].text
    for kind in KINDS:
        for a, b in (_blocks if kind == "card" else FINDERS[kind])(new):
            x, y, changed = to_source(steps, a, b)
            if changed and _strict(kind, new[a:b]) and (kind == "email" or _alone(new, a, b)) and (kind != "ip" or not re.match(r"\.[0-9]", new[b : b + 2]) and new[a - 1 : a] != "."):
                out.append((kind, x, y))
    # Spelled numbers without a plus.
    spelled = steps[2]
    for s, e, x, y in spelled.pieces:
        d = _digits(spelled.text[s:e])
        if 9 <= len(d) <= 15 and not _counted(d) and "." not in spelled.text[s:e] and len(_SPELLED.findall(steps[1].text[x:y])) >= 7:
            a, b, _ = to_source(steps[:2], x, y)
            if not any(p <= a and b <= q for _, p, q in out):
                out.append(("phone", a, b))
    return out


def scan(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether added), by start and then kind."""
    if not text:
        return []
    out = [(k, a, b, False) for k in KINDS for a, b in FINDERS[k](text)]
    base: dict[str, list[tuple[int, int]]] = {k: [(a, b) for x, a, b, _ in out if x == k] for k in KINDS}
    for k, a, b in disguised(text):
        i = bisect_right(base[k], (a, len(text) + 1)) - 1
        if i < 0 or base[k][i][1] < b:
            out.append((k, a, b, True))
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def _scan(batches):
    for batch in batches:
        rows = [scan(t.as_py()) for t in batch.column("text")]
        base = [[x for x in r if not x[3]] for r in rows]
        counts = [pa.array([sum(x[0] == k for x in r) for r in base], pa.int64()) for k in KINDS]
        added = pa.array([len(r) - len(b) for r, b in zip(rows, base)], pa.int64())
        digest = pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base], pa.string())
        yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *counts, added, digest, pa.array(map(_joined, rows), pa.string())], [c.split()[0] for c in _OUT.split(", ")])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of each kind's fixed matches, n_added, base_sha256, spans, a row per document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _OUT)


def redacted(text: str | None) -> str | None:
    """The text with each stretch of spans replaced by the kind of its first."""
    out, at = [], 0
    for k, a, b, _ in scan(text):
        if a >= at:
            out += (text[at:a], f"[{k.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact_pii(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; n_chars, where it is a column, follows the text."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array([redacted(t.as_py()) for t in batch.column(at)], field.type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op11(docs: DataFrame) -> DataFrame:
    return find_pii(docs)
