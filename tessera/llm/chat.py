"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then turns in one canonical form.

The states are roles. A line speaks for a role by the speaker marker it begins with, by the role its row states (for the
row's first line) and by plain features (a question, a list or code, an instruction); a role tends to go on within a row
and to change between rows. Viterbi finds the likeliest roles of a transcript; neighbouring lines of one role become a
turn, without their markers, rendered as <|role|>, the text and <|end|>.

Rows are sorted into transcripts by a shuffle and read as a stream, BLOCK turn numbers to a task's group and about LINES
lines to a chunk at a time. A transcript of more than one chunk is read twice: first each chunk gives the best score for
each pair of roles before it and at its end, from which the roles at all chunk ends follow; then each chunk is decided
between its ends. So the roles are the likeliest of the whole transcript; a turn that spans chunks is put together.

Cases: rows that repeat in all four columns count once; other rows of one turn follow one another by role and text. A
null role states nothing; a null or empty text gives an empty turn only if its row states a role. A null conv_id is one
transcript, a null turn comes first. A row is read whole, however long its text. Extra columns are ignored, whatever their names.
An empty table has no turns.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, small

ROLES = ("system", "user", "assistant")
BLOCK, LINES = 512, 8192
STATED = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "agent": 2}
_names = {**STATED, "q": 1, "question": 1, "instruction": 1, "a": 2, "answer": 2, "response": 2}
MARKER = re.compile(r"^\s{0,3}(?:<\|(?:im_start\|>)?|#{1,4}\s*|\*{1,2}|\[)?\s*(" + "|".join(sorted(_names, key=len, reverse=True)) + r")\s*(?:\*{0,2}\s*:\s*\*{0,2}|\|>|\]\s*:?|\*{2})\s*", re.I)
_end = re.compile(r"\s*<\|(?:im_)?end\|>\s*$")

_log = math.log
#: log P(next row's role | role) between rows, and within a row.
BETWEEN = [[_log(x) for x in r] for r in ((0.05, 0.85, 0.10), (0.02, 0.13, 0.85), (0.02, 0.88, 0.10))]
WITHIN = [[_log(x) for x in r] for r in ((0.94, 0.05, 0.01), (0.005, 0.95, 0.045), (0.005, 0.045, 0.95))]
FIRST = [_log(x) for x in (0.25, 0.65, 0.10)]
SAID, MARKED = (_log(0.9), _log(0.05)), (_log(0.97), _log(0.015))
FEATURES = (
    (re.compile(r"\?\s*$"), (0.05, 0.40, 0.12)),
    (re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])\s|^\s*```"), (0.15, 0.05, 0.25)),
    (re.compile(r"(?i)^\s*you are\b|\byou must\b|\byour (?:task|role)\b"), (0.50, 0.04, 0.01)),
    (re.compile(r"(?i)^\s*(?:sure|certainly|of course|here (?:is|are)|i can|as an)\b"), (0.01, 0.03, 0.20)),
    (re.compile(r"(?i)^\s*(?:please|can you|could you|how (?:do|can|to)|what|why|write|explain)\b"), (0.05, 0.30, 0.03)),
)


def emissions(line: str, stated: int | None) -> list[float]:
    out = [0.0, 0.0, 0.0]
    m = MARKER.match(line)
    for s in range(3):
        if m:
            out[s] += MARKED[0] if _names[m[1].lower()] == s else MARKED[1]
        if stated is not None:
            out[s] += SAID[0] if stated == s else SAID[1]
        for pattern, p in FEATURES:
            out[s] += _log(p[s] if pattern.search(line) else 1 - p[s])
    return out


def _forward(lines: list[tuple[str, int | None, bool]], start: list[float], emitted: list[list[float]]) -> tuple[list[float], list[list[int]]]:
    """Best scores by the role of the last line, and where they come from; `start` scores the roles of the first line."""
    back, best = [], [start[s] + emitted[0][s] for s in range(3)]
    for (text, _, begins), e in zip(lines[1:], emitted[1:]):
        step = BETWEEN if begins or MARKER.match(text) else WITHIN
        come = [max(range(3), key=lambda r: (best[r] + step[r][s], -r)) for s in range(3)]
        best = [best[come[s]] + step[come[s]][s] + e[s] for s in range(3)]
        back.append(come)
    return best, back


def viterbi(lines: list[tuple[str, int | None, bool]], enter: int | None = None, end: int | None = None) -> list[int]:
    """lines: text, stated role, whether a row begins. The likeliest roles; of equals the first. `enter` is the role of
    the line before, `end` the role of the last line, where they are known."""
    if not lines:
        return []
    best, back = _forward(lines, FIRST if enter is None else BETWEEN[enter], [emissions(t, x) for t, x, _ in lines])
    out = [max(range(3), key=lambda s: (best[s], -s)) if end is None else end]
    for come in reversed(back):
        out.append(come[out[-1]])
    return out[::-1]


def _lines(rows: list[tuple[int | None, str | None, str | None]]) -> tuple[list[tuple[str, int | None, bool]], list[int | None]]:
    lines, source = [], []
    for turn, role, text in rows:
        stated = STATED.get((role or "").strip().lower())
        if not (text or "").strip() and stated is None:
            continue
        for i, line in enumerate((text or "").replace("\r\n", "\n").split("\n")):
            lines.append((line, stated if i == 0 else None, i == 0))
            source.append(turn)
    return lines, source


def _scores(rows) -> list[float]:
    """Best scores by last role, at a transcript's beginning and after each role; empty without lines."""
    lines, _ = _lines(rows)
    if not lines:
        return []
    emitted = [emissions(t, x) for t, x, _ in lines]
    return [x for start in (FIRST, *BETWEEN) for x in _forward(lines, start, emitted)[0]]


def segments(rows, enter: int | None = None, end: int | None = None) -> list[tuple[int | None, int, int, str, bool]]:
    """rows: turn, role, text in order. First source turn, role, lines, text, and whether a turn begins (else it goes on)."""
    lines, source = _lines(rows)
    out: list[list] = []
    for (line, _, begins), role, turn in zip(lines, viterbi(lines, enter, end), source):
        m = MARKER.match(line)
        if not out or out[-1][1] != role or (m and begins):
            out.append([turn, role, [], bool(out) or enter != role or bool(m and begins)])
        out[-1][2].append(_end.sub("", line[m.end() :] if m and _names[m[1].lower()] == role else line).rstrip())
    return [(t, r, len(x), "\n".join(x), head) for t, r, x, head in out]


def turns(rows: list[tuple[int | None, str | None, str | None]]) -> list[tuple[int | None, str, int, str]]:
    """rows: turn, role, text in order. The recovered turns: first source turn, role, lines, rendered text."""
    strip = lambda x: x.strip("\n")
    return [(t, ROLES[r], n, f"<|{ROLES[r]}|>\n{strip(x)}\n<|end|>\n") for t, r, n, x, _ in segments(rows)]


def _chunks(batches):
    """(conv_id, block), number of the chunk, its rows, and what is known of the block's chunks."""
    key, rows, n_lines, last, k, known = None, [], 0, None, 0, {}
    for batch in batches:
        for conv, block, turn, role, text, told in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "turn", "role", "text", "told"))):
            if key != (conv, block) or n_lines >= LINES:
                if rows:
                    yield key, k, rows, known
                k, known = (k + 1, known) if key == (conv, block) else (0, {})
                key, rows, n_lines = (conv, block), [], 0
            if told is not None:
                known[told[0]] = told[1:]
                continue
            if (conv, block, turn, role, text) == last:
                continue
            last = (conv, block, turn, role, text)
            rows.append((turn, role, text))
            n_lines += 1 + (text or "").count("\n")
    if rows:
        yield key, k, rows, known


def _format(batches):
    for key, _, rows, _ in _chunks(batches):
        got = turns(rows)
        yield pa.record_batch([pa.array([key[0]] * len(got), pa.int64()), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.int64()), pa.array([x[3] for x in got], pa.string())], ["conv_id", "turn", "role", "n_lines", "rendered"])


def _measure(batches):
    for key, k, rows, _ in _chunks(batches):
        if scores := _scores(rows):
            yield pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([k], pa.int64()), pa.array([scores], pa.list_(pa.float64()))], ["conv_id", "block", "chunk", "scores"])


def _ends(t: pa.Table) -> pa.Table:
    """The roles before and at the end of each chunk of a transcript, on its likeliest path; -1 before the first."""
    rows = sorted(zip(t["block"].to_pylist(), t["chunk"].to_pylist(), t["scores"].to_pylist()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    best, back = rows[0][2][:3], []
    for _, _, x in rows[1:]:
        come = [max(range(3), key=lambda r: (best[r] + x[3 + 3 * r + s], -r)) for s in range(3)]
        best = [best[come[s]] + x[3 + 3 * come[s] + s] for s in range(3)]
        back.append(come)
    end = [max(range(3), key=lambda s: (best[s], -s))]
    for come in reversed(back):
        end.append(come[end[-1]])
    end.reverse()
    told = [[k, a, b, int(i + 1 == len(rows))] for i, ((_, k, _), a, b) in enumerate(zip(rows, [-1, *end], end))]
    return pa.table({"conv_id": pa.array(t["conv_id"].to_pylist(), pa.int64()), "block": pa.array([x[0] for x in rows], pa.int64()), "told": pa.array(told, pa.list_(pa.int64()))})


def _decide(batches):
    names = ["conv_id", "block", "chunk", "k", "turn", "role", "n_lines", "body", "head", "open"]
    types = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    for (conv, block), chunk, rows, known in _chunks(batches):
        if chunk not in known:
            continue
        enter, end, last = known[chunk]
        got = segments(rows, None if enter < 0 else enter, end)
        out = [(conv, block, chunk, k, t, ROLES[r], n, x, head, not head or (k + 1 == len(got) and not last)) for k, (t, r, n, x, head) in enumerate(got)]
        yield pa.record_batch([pa.array(x, y) for x, y in zip(zip(*out), types)], names)


def _sorted(c: DataFrame) -> DataFrame:
    return c.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.col("told").isNull(), "turn", "role", "text")


def _long(c: DataFrame, scratch: Scratch) -> DataFrame:
    """The turns of transcripts of more than one chunk."""
    scores = scratch.write(_sorted(c).mapInArrow(_measure, "conv_id long, block long, chunk long, scores array<double>"), "scores")
    told = scratch.write(scores.groupBy("conv_id").applyInArrow(_ends, "conv_id long, block long, told array<long>"), "told")
    told = told.select("conv_id", "block", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "told")
    schema = "conv_id long, block long, chunk long, k long, turn long, role string, n_lines long, body string, head boolean, open boolean"
    parts = scratch.write(_sorted(c.union(told)).mapInArrow(_decide, schema), "parts")
    spans = parts.where("open").withColumn("g", F.sum(F.col("head").cast("long")).over(Window.partitionBy("conv_id").orderBy("block", "chunk", "k")))
    spans = spans.groupBy("conv_id", "g").agg(F.sum("n_lines").alias("n_lines"), F.sort_array(F.collect_list(F.struct("block", "chunk", "k", "turn", "role", "body"))).alias("x"))
    spans = spans.select("conv_id", F.get("x", F.lit(0)).turn.alias("turn"), F.get("x", F.lit(0)).role.alias("role"), "n_lines", F.array_join(F.col("x.body"), "\n").alias("body"))
    out = parts.where("not open").select("conv_id", "turn", "role", "n_lines", "body").union(spans)
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.btrim("body", F.lit("\n")), F.lit("\n<|end|>\n"))
    return out.select("conv_id", "turn", "role", "n_lines", rendered.alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_lines, rendered, a row per recovered turn; turn is the source turn that it begins in."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / BLOCK).alias("block"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(None).cast("array<long>").alias("told"))
    scratch = Scratch(conversations.sparkSession, "chat")
    block = F.coalesce("block", F.lit(-(1 << 63)))
    n_lines = F.sum(1 + F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)))
    long = c.groupBy(F.col("conv_id").alias("id")).agg(F.min(block).alias("a"), F.max(block).alias("b"), n_lines.alias("n")).where(f"a <> b or n > {LINES}").select("id")
    long = small(scratch.write(long, "long"))
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    short = _sorted(c.join(long, same, "left_anti")).mapInArrow(_format, "conv_id long, turn long, role string, n_lines long, rendered string")
    return short if long.isEmpty() else short.union(_long(c.join(long, same, "left_semi"), scratch))


def op7(conversations: DataFrame) -> DataFrame:
    return format_chats(conversations).select("conv_id", "turn", "role", "n_lines", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
