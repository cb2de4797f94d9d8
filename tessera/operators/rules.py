"""Ordered rewrites outside comments and literals, and hints that only count.

Each rule sees what the rules before it made. A match is looked for in the masked text and spliced into the original,
groups being taken from the original; that needs positions, which no SQL function gives, so one Arrow pass applies all
rules of a text in order. Counting alone (hint_counts) is a Column expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.regexops import LITERAL, TOKEN, count_matches, mask


_HEAD = re.compile(r"\\b([A-Za-z_][A-Za-z0-9_]*+)(?![*+?{])")


def headed(regex: str) -> str:
    """The same, where it or each of its plain alternatives begins with a word, with the word before its border: a regex that begins
    with letters is searched for by them, one that begins with a border is tried at every place."""
    parts = regex.split("|") if not re.search(r"[()\[\]]", regex) else [regex] if "|" not in regex else []
    if not parts or not all(map(_HEAD.match, parts)):
        return regex
    return "|".join(_HEAD.sub(r"\1(?<=\\b\1)", x, count=1) for x in parts)


@dataclass(frozen=True)
class Rule:
    regex: str
    replacement: str
    description: str
    triggers: tuple[str, ...] = ()
    hint: bool = False
    #: Groups that must be equal in the original text too, not only where comments and literals are blanked.
    same: tuple[str, str] | None = None
    #: What is compiled, where trying the regex at each of many blank lines would take long.
    linear: str | None = None
    #: What finds the matches in one pass, where trying the regex at each word would take long: it gives what of a text
    #: is replaced, and groups 1 and 2.
    finder: Callable[[str], Iterator[tuple[tuple[int, int], ...]]] | None = None
    compiled: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(headed(self.linear or self.regex), re.M))

    @property
    def takes_blank_lines(self) -> bool:
        """The blank lines above a match belong to it."""
        return self.linear is not None


_TYPEDEF, _TYPEDEF_END = re.compile(r"typedef(?<=\btypedef)(?=\s)"), re.compile("[;{}]")
_SPACES, _WORD_END = re.compile(r"\s*"), re.compile(r"\w")


def typedefs(code: str) -> Iterator[tuple[tuple[int, int], ...]]:
    """What the regex of the typedef rule finds, by its marks alone: of the stretch from a typedef to the next semicolon the
    last word is the name and what is between the type, if no brace comes first. Only the first typedef of a
    stretch that blanks follow can begin a match, since all others have the same end."""
    at = 0
    while first := _TYPEDEF.search(code, at):
        mark = _TYPEDEF_END.search(code, first.end())
        if mark is None:
            return
        at = mark.end()
        if mark[0] == ";":
            name_end = len(code[first.end() : mark.start()].rstrip()) + first.end()
            name = name_end
            while name > first.end() and _WORD_END.match(code[name - 1]):
                name -= 1
            begin = _SPACES.match(code, first.end()).end()
            gap = len(code[first.end() : name].rstrip()) + first.end()
            if name < name_end and re.match(r"[A-Za-z_]", code[name]) and gap < name:
                if begin < gap:
                    yield (first.start(), mark.end()), (begin, gap), (name, name_end)
                elif name - first.end() >= 3:  # blanks alone: one of them is the type
                    yield (first.start(), mark.end()), (name - 2, name - 1), (name, name_end)


# What is looked for, what it becomes, and how that is called.
RULES = (
    Rule(r"\bNULL\b", "nullptr", "NULL -> nullptr", ("null_macro",)),
    Rule(r"\btypedef\s+([^;{}]+?)\s+([A-Za-z_]\w*)\s*;", r"using \2 = \1;", "typedef -> using", finder=typedefs),
    Rule(r"\bthrow\s*\(\s*\)", "noexcept", "throw() -> noexcept"),
    Rule(r"^\s*#\s*define\s+([A-Z][A-Z0-9_]*)\s+([0-9]+(?:\.[0-9]+)?f?L?U?L?)\b.*$", r"constexpr auto \1 = \2;", "#define constant -> constexpr", linear=r"^[^\S\n]*+#\s*define\s+([A-Z][A-Z0-9_]*)\s+([0-9]+(?:\.[0-9]+)?f?L?U?L?)\b.*$"),
    Rule(r"#\s*include\s*<stdio\.h>", "#include <cstdio>", "<stdio.h> -> <cstdio>"),
    Rule(r"#\s*include\s*<stdlib\.h>", "#include <cstdlib>", "<stdlib.h> -> <cstdlib>"),
    Rule(r"#\s*include\s*<string\.h>", "#include <cstring>", "<string.h> -> <cstring>"),
    Rule(r"#\s*include\s*<time\.h>", "#include <ctime>", "<time.h> -> <ctime>"),
    Rule(r"\(\s*([A-Za-z_][A-Za-z0-9_:<>]*)\s*\)\s*([A-Za-z_][A-Za-z0-9_]*)", r"\g<0>", "C-style cast - consider static_cast", ("c_style_cast",), True),
    Rule(r"\bchar\s*\*\s*([A-Za-z_]\w*)\b", r"\g<0>", "char* pointer - consider std::string or std::string_view", ("char_pointer",), True),
    Rule(r"\bstd\s*::\s*auto_ptr\b", "std::unique_ptr", "std::auto_ptr -> std::unique_ptr (deprecated)", (), True),
    Rule(r"\bprintf\s*\(", r"\g<0>", "printf detected - consider std::cout or std::print (C++23)", ("printf_usage",), True),
    Rule(r"\bmalloc\s*\(", r"\g<0>", "malloc usage - migrate to make_unique / vector", ("malloc_usage",), True),
    Rule(r"\bfree\s*\(", r"\g<0>", "free usage - replace with smart pointer ownership", ("free_usage",), True),
    Rule(r"\btime_t\b|\blocaltime\b", r"\g<0>", "legacy time API - migrate to std::chrono", ("time_usage",), True),
    Rule(r"^\s*#\s*define\s+([a-zA-Z_]\w*)\s*\(.*?\).*$", r"\g<0>", "functional macro - migrate to constexpr inline function", ("functional_macro",), True, linear=r"^[^\S\n]*+#\s*define\s+([a-zA-Z_]\w*)\s*\(.*?\).*$"),
    Rule(r"^\s*(?P<a>.*?;)\s*\n\s*(?P<b>(?P=a))\s*$", r"\g<a>", "redundant duplicate statement - removed consecutive call", same=("a", "b"), linear=r"^[^\S\n]*+(?P<a>.*?;)[^\S\n]*+\n\s*+(?P<b>(?P=a))\s*$"),
)
_TOKENS, _LITERAL = re.compile(TOKEN), re.compile(LITERAL)
_GROUP = re.compile(r"\\(?:g<(\w+)>|(\d))")


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Where the comments, strings and character literals are."""
    return [m.span() for m in _TOKENS.finditer(text) if _LITERAL.match(m[0])]


def masked(text: str) -> str:
    """The text with blanks for what stands in those spans; its lines stay."""
    ends = [0, *(x for span in literal_spans(text) for x in span), len(text)]
    pieces = [text[a:b] for a, b in pairwise(ends)]
    pieces[1::2] = ["\n".join(" " * len(line) for line in x.split("\n")) for x in pieces[1::2]]
    return "".join(pieces)


def edits(text: str, rule: Rule, code: str | None = None) -> list[tuple[int, int, str]]:
    """What a rule replaces by what. Groups are those of the text, not of its masked form, which is code if it is known."""
    out, seen, code = [], 0, masked(text) if code is None else code
    found = rule.finder(code) if rule.finder else (m.span for m in rule.compiled.finditer(code))
    for m in found:
        span = m if callable(m) else lambda g=0, m=m: m[g]
        group = lambda g, span=span: text[slice(*span(g))]
        a, b = span()
        if rule.takes_blank_lines:
            a = seen + len(code[seen:a].rstrip())
            if a and code[a - 1] != "\n":
                a = code.index("\n", a) + 1
        if not rule.same or group(rule.same[0]) == group(rule.same[1]):
            by = _GROUP.sub(lambda r, g=group: g(int(x) if (x := r[1] or r[2]).isdigit() else x), rule.replacement)
            out.append((a, b, by))
        seen = b
    return out


def apply_rule(text: str, rule: Rule, code: str | None = None) -> tuple[str, int]:
    """The text after a rule, and how often it applied. Hints apply without a change."""
    found = edits(text, rule, code)
    if rule.hint or not found:
        return text, len(found)
    kept = [text[a:b] for a, b in pairwise([0, *(x for a, b, _ in found for x in (a, b)), len(text)])][::2]
    return "".join(x + y for x, y in zip(kept, [by for *_, by in found] + [""])), len(found)


def modernize_text(text: str | None, rules: tuple[Rule, ...] = RULES, patterns: dict[str, int] | None = None) -> tuple[str, list[tuple[str, int]]]:
    """The rewritten text, and (description, times) of the rules that found something. A rule with triggers rests if
    patterns are given and none of its own is among them."""
    text, applied = text or "", []
    # A text is masked again when a rule has changed it.
    code = masked(text)
    for rule in rules:
        if rule.triggers and patterns and not any(patterns.get(x, 0) > 0 for x in rule.triggers):
            continue
        new, n = apply_rule(text, rule, code)
        if new != text:
            text, code = new, masked(new)
        if n:
            applied.append((rule.description, n))
    return text, applied


def apply_rules(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """file_id, text, applied array<struct<description, times>>, changed. A column patterns (map<string, int>), if any,
    gates."""
    gated = "patterns" in files.columns

    def run(batches):
        for batch in batches:
            gates = batch.column("patterns").to_pylist() if gated else [None] * len(batch)
            texts = batch.column("text").to_pylist()
            done = [modernize_text(t, rules, dict(g) if g else None) for t, g in zip(texts, gates)]
            kind = pa.list_(pa.struct([("description", pa.string()), ("times", pa.int32())]))
            yield pa.record_batch([batch.column("file_id"), pa.array([d[0] for d in done], pa.string()), pa.array([[{"description": a, "times": n} for a, n in d[1]] for d in done], kind), pa.array([d[0] != (t or "") for d, t in zip(done, texts)])], ["file_id", "text", "applied", "changed"])

    cols = [F.col("file_id").cast("long").alias("file_id"), "text", *(["patterns"] if gated else [])]
    return files.select(*cols).mapInArrow(run, "file_id long, text string, applied array<struct<description: string, times: int>>, changed boolean")


def hint_counts(text: Column, rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """A count for each hint, on one masking."""
    m = mask(text)
    return [count_matches(m, "(?m)" + (r.linear or r.regex)).alias(r.description) for r in rules if r.hint]


def labels(applied: Column) -> Column:
    """"description (n times)" of each rule that applied."""
    return F.transform(applied, lambda a: F.format_string("%s (%d times)", a.description, a.times))


def transformation_counts(applied: DataFrame) -> DataFrame:
    """description, times, n_files: how often each rule applied, over all files."""
    a = applied.select("file_id", F.explode("applied").alias("a"))
    return a.groupBy("a.description").agg(F.sum("a.times").alias("times"), F.countDistinct("file_id").alias("n_files"))
