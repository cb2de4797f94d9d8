"""Periodic runs: stretches of a text that repeat with a period of q words, three times or more, found and collapsed.

A run is a maximal stretch of words with smallest period q (words q apart are equal) of max(MIN_WORDS, MIN_POWER * q) words
or more. They are found by Kolpakov's and Kucherov's method, linear in the words that it reads:
  1  the words are factorised (LZ): a factor is the longest stretch that begins earlier too, told by the suffix
     automaton's first places, or a new word;
  2  a run that crosses or touches the last factor border it meets lies within twice the factor before and once the factor
     behind that border (Main). Longest common extensions from the border, by two Z arrays each way, tell it;
  3  any other run lies strictly inside a factor, so it is a copy of one within the factor's earlier occurrence: runs are
     copied in the order of their starts, which sees copies of copies.

Each word of a run is in a window of WINDOW words that stands a period on or back again. So the method reads those
stretches alone whose words are all in windows that occur twice in the text, as hashes tell; each run lies whole in one of
them, and so would a longer one. That loses none, and spares the automaton what has no repeats. Texts are independent
rows: there is no shuffle, and a lost task is read again.

Cases: null and empty texts have no words, no runs, and the hash of nothing. Repeated rows give a row each. A null doc_id is
kept and never altered. A text is taken whole by one worker, however long: some 300 bytes a word of repeating stretches.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import mix, spans, texts, word_hashes

MIN_WORDS, MIN_POWER = 24, 3
#: A run of L >= max(24, 3 q) words has L - q >= 16 that stand q words on, and as many q words back.
WINDOW = 16
_ODD = np.uint64(0x9E6C63D0876A9A47)


class Automaton:
    """The suffix automaton of a list of small integers: of each state the longest length, the suffix link and the place
    where its strings end first. Most states have one transition, which is held in two arrays; others have a dict."""

    def __init__(self, s: list[int]):
        self.length, self.link, self.first_end = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.symbol, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        last = 0
        for i, c in enumerate(s):
            last = self._extend(last, c, i)

    def step(self, state: int, c: int) -> int:
        if self.symbol[state] == c:
            return self.to[state]
        return self.more[state].get(c, -1) if state in self.more else -1

    def _put(self, state: int, c: int, to: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _new(self, length: int, link: int, first_end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.first_end.append(first_end)
        self.symbol.append(-1)
        self.to.append(-1)
        return len(self.length) - 1

    def _extend(self, last: int, c: int, end: int) -> int:
        new = self._new(self.length[last] + 1, 0, end)
        p = last
        while p >= 0 and (q := self.step(p, c)) < 0:
            self._put(p, c, new)
            p = self.link[p]
        if p < 0:
            return new
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        clone = self._new(self.length[p] + 1, self.link[q], self.first_end[q])
        self.symbol[clone], self.to[clone] = self.symbol[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        while p >= 0 and self.step(p, c) == q:
            self._put(p, c, clone)
            p = self.link[p]
        self.link[q] = self.link[new] = clone
        return new


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, source): the longest stretch from begin that also begins at source, before; source -1 for a new word."""
    a, n, i, out = Automaton(s), len(s), 0, []
    while i < n:
        state, j = 0, i
        # A string of this state that ends first before j begins before i.
        while j < n and 0 <= (to := a.step(state, s[j])) and a.first_end[to] < j:
            state, j = to, j + 1
        out.append((i, max(j, i + 1), a.first_end[state] - (j - i) + 1 if j > i else -1))
        i = max(j, i + 1)
    return out


def z_array(s: list[int]) -> list[int]:
    """How far each suffix agrees with the whole."""
    n = len(s)
    z, left, right = [n] + [0] * max(0, n - 1), 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z[:n]


def _at_border(s: list[int], low: int, border: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the long enough repetitions in s[low:high] that cross or touch the border."""
    left, right = s[low:border], s[border:high]
    nl, nr = len(left), len(right)
    if nl + nr < MIN_WORDS:
        return
    most = (nl + nr) // MIN_POWER
    forward = z_array([*right, -1, *left])  # of right, and of each suffix of left followed by nothing
    ahead = forward[:nr]
    back = z_array(left[::-1])
    # Agreement with the border's left, read backwards, of what ends q words behind the border.
    over = z_array([*left[::-1], -1, *s[low : border + min(nr, most)][::-1]]) if nl else []
    span = nl + min(nr, most)
    for q in range(1, min(nr, most) + 1):
        on = ahead[q] if q < nr else 0
        before = min(over[nl + 1 + (span - nl - q)], nl) if nl else 0
        if before + on >= (MIN_POWER - 1) * q and before + on + q >= MIN_WORDS:
            yield border - before, border + q + on, q
    for q in range(1, min(nl, most) + 1):
        # A suffix of left that agrees with right up to the border goes on with right itself.
        on = forward[nr + 1 + nl - q] if nr else 0
        if on == q:
            on = q + (ahead[q] if q < nr else 0)
        before = back[q] if q < nl else 0
        if before + on >= (MIN_POWER - 1) * q and before + on + q >= MIN_WORDS:
            yield border - q - before, border + on, q


def runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of s, by start and end."""
    n, cut = len(s), factors(s)
    found: dict[tuple[int, int], int] = {}
    borders = [(b, e, cut[k - 1][1] - cut[k - 1][0] if k else 0) for k, (b, e, _) in enumerate(cut)] + [(n, n, cut[-1][1] - cut[-1][0] if cut else 0)]
    for b, e, before in borders:
        for i, j, q in _at_border(s, max(0, b - 2 * before - (e - b)), b, e):
            if (i == 0 or s[i - 1] != s[i - 1 + q]) and (j == n or s[j] != s[j - q]):
                found[i, j] = min(q, found.get((i, j), q))
    if not found:
        return []
    starts: dict[int, list[tuple[int, int]]] = {}
    for (i, j), q in found.items():
        starts.setdefault(i, []).append((j, q))
    order = sorted(starts)
    for b, e, source in cut:
        if source < 0 or e - b < MIN_WORDS:
            continue
        # The source may reach into the factor itself, and see what was copied there just now.
        at, on = bisect_right(order, source), b - source
        while at < len(order) and (i := order[at]) + MIN_WORDS + on <= e:
            for j, q in starts[i]:
                if j + on < e and (i + on, j + on) not in found:
                    found[i + on, j + on] = q
                    if i + on not in starts:
                        starts[i + on] = []
                        insort(order, i + on)
                    starts[i + on].append((j + on, q))
            at += 1
    return sorted((i, j, q) for (i, j), q in found.items())


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """Where each word is in a window of WINDOW words whose hash occurs twice among these: (first word, end)."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return []
    h, size = mix(codes), 1
    while size < WINDOW:
        h, size = mix(h[:-size] * _ODD + h[size:]), 2 * size
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    begins = np.flatnonzero(np.bincount(order[1:][same], minlength=n) + np.bincount(order[:-1][same], minlength=n))
    if not len(begins):
        return []
    new = np.flatnonzero(np.diff(begins) > WINDOW) + 1
    first, last = begins[np.append(0, new)], begins[np.append(new, len(begins)) - 1] + WINDOW
    return [(i, j) for i, j in zip(first.tolist(), last.tolist()) if j - i >= MIN_WORDS]


def periodic(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The words, numbers, with a periodic tail in one text of ten, as crc32 of the id tells."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text whose words are told apart by 64-bit numbers, by start and period."""
    out = []
    for i, j in stretches(codes):
        s = np.unique(codes[i:j], return_inverse=True)[1].tolist()
        out += [(i + a, b - a, q) for a, b, q in runs(s)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def keep_first(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period."""
    gone = np.zeros(n + 1, np.int64)
    for i, length, q in found:
        gone[i + q] += 1
        gone[i + length] -= 1
    return np.cumsum(gone[:-1]) == 0


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, ties to the smallest start and then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2] or r[1] * best[2] == best[1] * r[2] and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


_OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, n_dropped long, runs_sha256 string, collapsed_sha256 string"


def _told(doc_id, words: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes) -> tuple:
    """words: of each word of the text which of the source it is."""
    found = find_runs(codes)
    best = strongest(found)
    kept = words[keep_first(len(words), found)] if found else words
    text = b" ".join([data[i:j] for i, j in zip(starts[kept].tolist(), ends[kept].tolist())])
    listed = "".join(f"{i},{n},{q}\n" for i, n, q in found).encode()
    return (doc_id, len(words), len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, len(words) - len(kept), hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())


def _detect(altered: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for i, j, data, off in texts(batch):
                starts, ends, first = spans(data, off)
                with np.errstate(over="ignore"):
                    codes, raw, rows = word_hashes(data, starts, ends, lower=False), data.tobytes(), []
                    for k, doc in enumerate(ids[i:j]):
                        a, b = first[k], first[k + 1]
                        words = np.arange(b - a)
                        words = periodic(doc, words) if altered else words
                        rows.append(_told(doc, words, codes[a:b][words], starts[a:b], ends[a:b], raw))
                names = [c.split()[0] for c in _OUT.split(", ")]
                types = [pa.string() if c.endswith("string") else pa.int64() for c in _OUT.split(", ")]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return run


def detect_runs(docs: DataFrame, altered: bool = False) -> DataFrame:
    """The runs of each text, a row per document: their number, the strongest, a digest of all, and of the text with
    each run's repeats left out. altered: of texts with the periodic tails that the query asks for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_detect(altered), _OUT)


def _collapse(at: int):
    def run(batches):
        for batch in batches:
            new = []
            for text in batch.column(at):
                raw = (text.as_py() or "").encode()
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = spans(data, np.array([0, len(data)]))
                with np.errstate(over="ignore"):
                    found = find_runs(word_hashes(data, starts, ends, lower=False)) if len(data) else []
                if not found:
                    new.append(text.as_py())
                    continue
                # What stands between two words stays with the first of them.
                kept, until = keep_first(len(starts), found), np.append(starts[1:], len(raw))
                new.append((raw[: starts[0]] + b"".join(raw[i:j] for i, j in zip(starts[kept].tolist(), until[kept].tolist()))).decode())
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return run


def collapse_runs(docs: DataFrame) -> DataFrame:
    """The documents, of each run its first period alone; all columns stay as they are, but for the text."""
    return docs.mapInArrow(_collapse(docs.columns.index("text")), docs.schema)


def op13(docs: DataFrame) -> DataFrame:
    return detect_runs(docs, altered=True).drop("n_words", "n_dropped")
