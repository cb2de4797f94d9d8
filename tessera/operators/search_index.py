"""Line search by an index: a table of byte trigrams to files, and the trigrams that a regular expression requires.

The index is two written tables: the files' texts, dealt to parts of about FILES files, and a row for each trigram and
part, with the files of the part that have it, sorted by trigram. A search asks the expression for a condition over trigrams that each line it finds must fulfil,
reads the postings of those alone, and then only the parts that hold candidates, of which the lines are searched as ever. So
its rows are those of a full scan; an expression of which nothing can be told is a full scan.

What can't be told for certain is told to require nothing: the condition is derived from the expression as Python reads it,
and where Java, which does the searching, may read it otherwise it is left unread.
"""

from __future__ import annotations

import re
import warnings
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.patterns import search_lines, search_lines_for
from tessera.sources.scratch import Scratch

#: Files to a part of the written texts.
FILES = 256
#: So many parts are named in a search at most.
NAMED = 1000
#: So many candidates go to the texts at most; of more both are exchanged.
FEW = 1 << 17
#: What one expression's alternatives may come to before they are given up: they then require nothing.
STRINGS, GRAMS = 64, 256
_UNLIKE = re.compile(r"&&|\\[QERXhHvVpPGzNkcexX0-9]|\(\?[a-z]*x|\(\?<[A-Za-z]|\[[^\]\\]*(?:\\.[^\]\\]*)*\[")


class Needs(NamedTuple):
    """A condition over trigrams: `all` or `any` of its parts, which are trigrams or conditions. all of nothing holds always."""

    how: str
    parts: tuple = ()


ALWAYS = Needs("all")


def _all(*parts) -> Needs:
    out: list = []
    for p in parts:
        for x in p.parts if isinstance(p, Needs) and p.how == "all" else (p,):
            if x not in out:
                out.append(x)
    return Needs("all", tuple(out))


def _any(*parts) -> Needs:
    return ALWAYS if any(p == ALWAYS for p in parts) else parts[0] if len(set(parts)) == 1 else Needs("any", tuple(dict.fromkeys(parts)))


def _grams(x: bytes) -> Needs:
    return _all(*(x[i : i + 3] for i in range(len(x) - 2)))


class _Told(NamedTuple):
    """Of a part of an expression: all that it can match, if that is few strings, else what each match begins and ends with,
    and what each requires."""

    exact: frozenset[bytes] | None
    first: frozenset[bytes]
    last: frozenset[bytes]
    needs: Needs


_EMPTY = _Told(frozenset([b""]), frozenset([b""]), frozenset([b""]), ALWAYS)
_UNKNOWN = _Told(None, frozenset([b""]), frozenset([b""]), ALWAYS)


def _of_strings(x: frozenset[bytes]) -> Needs:
    return _any(*(_grams(s) for s in sorted(x))) if x else ALWAYS


def _strings(x) -> _Told:
    x = frozenset(x)
    return _Told(x, x, x, ALWAYS) if len(x) <= STRINGS else _UNKNOWN


def _shorter(t: _Told) -> _Told:
    """Ends of two bytes suffice to make trigrams with what stands beside them; what is cut off is required here."""
    if t.exact is not None and (len(t.exact) > STRINGS or max(map(len, t.exact), default=0) > 32):
        t = _Told(None, t.exact, t.exact, t.needs)
    if t.exact is None:
        needs = _all(t.needs, *(_of_strings(x) for x in (t.first, t.last) if all(len(s) > 2 for s in x)))
        first, last = frozenset(s[:2] for s in t.first), frozenset(s[-2:] for s in t.last)
        t = _Told(None, first if len(first) <= STRINGS else frozenset([b""]), last if len(last) <= STRINGS else frozenset([b""]), needs)
    return t


def _then(a: _Told, b: _Told) -> _Told:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        x = frozenset(p + q for p, q in product(a.exact, b.exact))
        return _shorter(_Told(x, x, x, _all(a.needs, b.needs)))
    needs = _all(a.needs, b.needs)
    if len(a.last) * len(b.first) <= STRINGS:
        # What a ends with and b begins with stands together.
        needs = _all(needs, _of_strings(frozenset(p + q for p, q in product(a.last, b.first))))
    first = frozenset(p + q for p, q in product(a.exact, b.first)) if a.exact is not None and len(a.exact) * len(b.first) <= STRINGS else a.first
    last = frozenset(p + q for p, q in product(a.last, b.exact)) if b.exact is not None and len(a.last) * len(b.exact) <= STRINGS else b.last
    return _shorter(_Told(None, first, last, needs))


def _full(t: _Told) -> Needs:
    return _all(t.needs, *([_of_strings(t.exact)] if t.exact is not None else [_of_strings(t.first), _of_strings(t.last)]))


def _or(parts: list[_Told]) -> _Told:
    if all(p.exact is not None and p.needs == ALWAYS for p in parts):
        return _strings(x for p in parts for x in p.exact)
    return _shorter(_Told(None, frozenset(x for p in parts for x in p.first), frozenset(x for p in parts for x in p.last), _any(*(_full(p) for p in parts))))


def _char(c: int, folded: bool) -> set[bytes]:
    x = chr(c)
    return {y.encode() for y in ((x.lower(), x.upper(), x) if folded and len(x.lower()) == len(x.upper()) == 1 else (x,))}


def _told(tree, folded: bool) -> _Told:
    from re import _constants as C

    out = _EMPTY
    for op, value in tree:
        if op is C.LITERAL:
            t = _strings(_char(value, folded))
        elif op is C.IN:
            chars: set[bytes] | None = set()
            for kind, x in value:
                if kind is C.LITERAL:
                    chars |= _char(x, folded)
                elif kind is C.RANGE and x[1] - x[0] < STRINGS:
                    for c in range(x[0], x[1] + 1):
                        chars |= _char(c, folded)
                else:
                    chars = None
                    break
            t = _strings(chars) if chars else _UNKNOWN
        elif op is C.BRANCH:
            t = _or([_told(x, folded) for x in value[1]])
        elif op is C.SUBPATTERN:
            _, on, off, inner = value
            t = _told(inner, (folded or bool(on & re.I)) and not off & re.I)
        elif op is C.ATOMIC_GROUP:
            t = _told(value, folded)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            one = _told(inner, folded)
            if low == 0:
                t = _or([_EMPTY, one]) if high == 1 else _UNKNOWN
            else:
                t = one
                for _ in range(min(low, 8) - 1):
                    t = _then(t, one)
                if high != low or low > 8:
                    t = _Told(None, t.first, one.last if low > 8 else t.last, _full(t)) if t.exact is None or one.exact is None else _shorter(_Told(None, t.exact, t.exact, _of_strings(t.exact)))
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            t = _EMPTY
        else:
            t = _UNKNOWN
        out = _then(out, t)
    return out


def required(regex: str) -> Needs:
    """What trigrams a line must hold that the expression finds."""
    if _UNLIKE.search(regex):
        return ALWAYS
    from re import _parser

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        try:
            tree = _parser.parse(regex)
            needs = ALWAYS if tree.state.flags & re.X else _full(_told(tree, bool(tree.state.flags & re.I)))
        except (re.error, RecursionError, OverflowError, UnicodeEncodeError, Warning):
            return ALWAYS
    return needs if len(_leaves(needs)) <= GRAMS else ALWAYS


def literals(regex: str) -> tuple[str, ...]:
    """Strings that a line must hold that the expression finds, as they stand in it: to look for them spares trying an
    expression whose trials are many."""
    if required(regex) == ALWAYS:
        return ()
    from re import _constants as C
    from re import _parser

    tree = _parser.parse(regex)
    if tree.state.flags & re.I:
        return ()
    runs = "".join(chr(x) if op is C.LITERAL else "\0" for op, x in tree).split("\0")
    return tuple(dict.fromkeys(x for x in runs if len(x) > 2 and "\ufffd" not in x))


def _leaves(needs: Needs) -> set[bytes]:
    return {y for x in needs.parts for y in (_leaves(x) if isinstance(x, Needs) else {x})}


def _number(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


def _condition(needs: Needs, has) -> Column:
    parts = [_condition(x, has) if isinstance(x, Needs) else has(_number(x)) for x in needs.parts]
    out = F.lit(needs.how == "all")
    for p in parts:
        out = out & p if needs.how == "all" else out | p
    return out


def _has(gram: int) -> Column:
    return F.array_contains("grams", F.lit(gram))


_GRAMS = "gram int, part int, files array<long>"
#: So many trigrams are held before their rows leave the worker.
HELD = 1 << 20


def _rows(part: int, files: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each trigram of these files of a part."""
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    every, of = every[order], np.repeat(np.array(files, np.int64), [len(g) for g in grams])[order]
    begins = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    ends = pa.array(np.r_[begins, len(every)].astype(np.int32))
    return pa.record_batch([pa.array(every[begins]), pa.array(np.full(len(begins), part, np.int32)), pa.ListArray.from_arrays(ends, pa.array(of))], ["gram", "part", "files"])


def _postings(batches):
    # Files of a part stand together; where they don't, the part has several rows for a trigram.
    now, files, grams, held = None, [], [], 0
    for batch in batches:
        for k, part, text in zip(*(batch.column(c).to_pylist() for c in ("file_id", "part", "text"))):
            if files and (part != now or held >= HELD):
                yield _rows(now, files, grams)
                files, grams, held = [], [], 0
            b = np.frombuffer((text or "").encode(), np.uint8).astype(np.int32)
            own = np.unique((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)
            now, held = part, held + len(own)
            files.append(k)
            grams.append(own)
    if files:
        yield _rows(now, files, grams)


class SearchIndex:
    """A folder with the two tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._listed: DataFrame | None = None

    def build(self, files: DataFrame, files_to_a_part: int = FILES) -> SearchIndex:
        """Writes the index of (file_id, path, text); file_id tells files apart, null ones aren't indexed."""
        own = files.select(F.col("file_id").cast("long").alias("file_id"), "path", "text").where("file_id is not null")
        parts = max(1, -(-own.count() // files_to_a_part))
        own = own.withColumn("part", F.pmod(F.xxhash64("file_id"), F.lit(parts)).cast("int"))
        own.repartition(min(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/texts")
        self._listed = None
        texts = self._texts()
        found = texts.select("file_id", "part", "text").mapInArrow(_postings, _GRAMS)
        # By trigram and part, so that one that nearly all files have is not one task's, and a search skips row groups.
        found.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part").write.mode("overwrite").parquet(f"{self.path}/grams")
        return self

    def _texts(self) -> DataFrame:
        # The folders of the parts are listed once, not once a search.
        if self._listed is None:
            self._listed = self.spark.read.schema("file_id long, path string, text string, part int").parquet(f"{self.path}/texts")
        return self._listed

    def candidates(self, regex: str) -> DataFrame | None:
        """file_id, part of the files that may hold a line; None if that is all of them."""
        needs = required(regex)
        asked = sorted(map(_number, _leaves(needs)))
        if not asked:
            return None
        return self._seen(asked).where(_condition(needs, _has)).select("file_id", "part")

    def _seen(self, asked: list[int]) -> DataFrame:
        """file_id, part, grams: which of the trigrams a file has, where it has any."""
        rows = self.spark.read.schema(_GRAMS).parquet(f"{self.path}/grams").where(F.col("gram").isin(asked))
        return rows.select("gram", "part", F.explode("files").alias("file_id")).groupBy("file_id", "part").agg(F.collect_set("gram").alias("grams"))

    def files(self, regex: str) -> DataFrame:
        """file_id, path, text of the candidates. Parts without any aren't read: a few are named, of more Spark learns as it
        joins."""
        texts, found = self._texts(), self.candidates(regex)
        if found is None:
            return texts.select("file_id", "path", "text")
        parts = [r.part for r in found.select("part").distinct().limit(NAMED + 1).collect()]
        texts = texts.where(F.col("part").isin(parts)) if len(parts) <= NAMED else texts
        found = F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found
        return texts.join(found, ["part", "file_id"], "left_semi").select("file_id", "path", "text")

    def search(self, regex: str) -> DataFrame:
        """path, line, text, as search_lines of all files."""
        return search_lines(self.files(regex), regex)

    def search_for(self, regexes: tuple[str, ...]) -> DataFrame:
        """expression (its place), path, line, text: as search for each of the expressions, by one reading of the postings and
        one of the texts."""
        needs, held = [required(x) for x in regexes], tuple(map(literals, regexes))
        asked = sorted({g for x in needs for g in map(_number, _leaves(x))})
        texts, anywhere = self._texts(), F.array(*[F.lit(not _leaves(x)) for x in needs])
        if not asked:
            return search_lines_for(texts.withColumn("wanted", anywhere), regexes, held)
        found = self._seen(asked).select("file_id", "part", F.array(*[_condition(x, _has) for x in needs]).alias("wanted")).where(F.array_contains("wanted", True))
        # Written once, as it is both counted and joined.
        found = Scratch(self.spark, "found").write(found, "files")
        found = F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found
        # Where each expression requires something, a file that isn't found has nothing.
        joined = texts.join(found, ["part", "file_id"], "left" if any(not _leaves(x) for x in needs) else "inner")
        return search_lines_for(joined.select("path", "text", F.coalesce("wanted", anywhere).alias("wanted")), regexes, held)
