"""Line differences: a shortest edit script of two texts, in memory linear in their lines.

Lines are numbered by their text. What both texts begin and end with is left aside, and so are lines that one of them alone
has, which no script can keep. Of the rest a longest common subsequence is found by halving one side and finding where its
halves meet the other (Hirschberg), with whole rows of lengths as the bits of one number (Hyyrö).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 3
_OUT = "id long, hunk int, position int, op string, old_line int, new_line int, text string"


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """Of each beginning of b the length of its longest common subsequence with all of a."""
    at: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    whole = (1 << len(b)) - 1
    rows, kept = whole, {}
    for x in a:
        places = at.get(x)
        if not places:
            continue
        bits = kept.get(x)
        if bits is None:
            raw = bytearray(len(b) // 8 + 1)
            for p in places:
                raw[p >> 3] |= 1 << (p & 7)
            bits = int.from_bytes(raw, "little")
            # At most 512 lines are as frequent as that, so what is kept is linear in b.
            if 512 * len(places) >= len(b):
                kept[x] = bits
        low = rows & bits
        rows = ((rows + low) | (rows - low)) & whole
    bits = np.unpackbits(np.frombuffer(rows.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The places (in a, in b) of a longest common subsequence, in order."""
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        i, k, j, m = waiting.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in (own := b[j:m]):
                out.append((i, j + own.index(a[i])))
            continue
        half = (i + k) // 2
        cut = j + int(np.argmax(_row(a[i:half], b[j:m]) + _row(a[half:k][::-1], b[j:m][::-1])[::-1]))
        waiting += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(out)


def matches(before: list[str], after: list[str]) -> list[tuple[int, int]]:
    """The places of the lines that a shortest edit script keeps."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines] for lines in (before, after))
    both = set(a) & set(b)
    i, j = ([k for k, x in enumerate(lines) if x in both] for lines in (a, b))
    return [(i[x], j[y]) for x, y in common([a[x] for x in i], [b[x] for x in j])]


def changes(before: str | None, after: str | None, context: int = CONTEXT) -> list[tuple[int, str, int | None, int | None, str]]:
    """(hunk, op, old_line, new_line, text) of each line that goes (-) or comes (+), in order. Changes with up to twice
    `context` lines between them are one hunk. Null is a text without a line."""
    old, new = ([] if x is None else x.split("\n") for x in (before, after))
    out, hunk, last = [], 0, None
    i = j = 0
    for x, y in [*matches(old, new), (len(old), len(new))]:
        if x > i or y > j:
            if last is None or i - last > 2 * context:
                hunk += 1
            out += [(hunk, "-", k + 1, None, old[k]) for k in range(i, x)] + [(hunk, "+", None, k + 1, new[k]) for k in range(j, y)]
            last = x
        i, j = x + 1, y + 1
    return out


def unified(before: str | None, after: str | None, context: int = CONTEXT) -> str:
    """The changes as a unified diff; an empty text if there are none."""
    old, new = ([] if x is None else x.split("\n") for x in (before, after))
    steps, i, j = [], 0, 0
    for x, y in [*matches(old, new), (len(old), len(new))]:
        steps += [("-", k, j, old[k]) for k in range(i, x)] + [("+", x, k, new[k]) for k in range(j, y)]
        if x < len(old) and y < len(new):
            steps.append((" ", x, y, old[x]))
        i, j = x + 1, y + 1
    changed = [n for n, s in enumerate(steps) if s[0] != " "]
    out = ["--- before", "+++ after"] if changed else []
    k = 0
    while k < len(changed):
        last = k
        while last + 1 < len(changed) and changed[last + 1] - changed[last] - 1 <= 2 * context:
            last += 1
        part = steps[max(0, changed[k] - context) : changed[last] + context + 1]
        sizes = [sum(s[0] in kinds for s in part) for kinds in (" -", " +")]
        ranges = [f"{first + 1 if n else first}" + ("" if n == 1 else f",{n}") for first, n in zip(part[0][1:3], sizes)]
        out += [f"@@ -{ranges[0]} +{ranges[1]} @@", *(s[0] + s[3] for s in part)]
        k = last + 1
    return "\n".join(out)


def line_changes(pairs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """id, hunk, position, op, old_line, new_line, text: a row per changed line of (id, before, after). A pair is one row of a
    task, with memory linear in its lines."""

    def run(batches):
        for b in batches:
            for k, x, y in zip(*(b.column(c).to_pylist() for c in ("id", "before", "after"))):
                if rows := changes(x, y, context):
                    cols = list(zip(*[(k, h, n, *more) for n, (h, *more) in enumerate(rows, 1)]))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()))], ["id", "hunk", "position", "op", "old_line", "new_line", "text"])

    return pairs.select(F.col("id").cast("long").alias("id"), "before", "after").mapInArrow(run, _OUT)
