"""Packing of documents into training sequences by cost.

A document's ids are cut only where needed: full-length stretches are sequences of their own, and what is left is placed
in descending order, each piece into the sequence of lowest cost (linear plus quadratic in the length of its pieces,
as attention costs within a document) that has room for it. A block of pieces opens just as many sequences as its ids
fill, so where none has room the piece is cut to fill the emptiest ones.

Blocks are packed apart: a block is a bounded number of pieces, so memory does not grow with the input and a lost task
repeats one block. Ids are taken once a document; sequences are numbered by block.

Cases: null or empty text is the separator id alone. Repeated rows are packed each. A null doc_id is kept. A text is encoded as a
whole, however long, by a task that holds its ids; a block ends behind it. Extra columns are ignored, whatever their names. An
empty table has no pieces.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import CHUNK, pieces, raw, trimmed
from tessera.llm.tokens import VOCABULARY, encoder

LENGTH, SEPARATOR = 2048, 1
#: The cost of a piece of n ids is n + QUADRATIC * n * n.
QUADRATIC = 1 / 1024
#: Documents in a block at most.
BLOCK = 8192
#: Bits of a sequence's number within its block, and of the block's within its partition; the rest tells the partition.
IN_BLOCK, IN_PART = 22, 20


def place(lengths: list[int], room: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) for pieces under `room` ids, in as few sequences as the ids fill."""
    total = sum(lengths)
    n = -(-total // room)
    used, cost, out = [0] * n, [0.0] * n, []
    # Sequences by what is left in them, the cheapest first, below a tree of the least (cost, sequence) of each range.
    none, size = (math.inf, n), 1 << room.bit_length()
    heaps, least = [[] for _ in range(room + 1)], [none] * (2 * size)

    def follow(free: int) -> None:
        k = free + size
        least[k] = heaps[free][0] if heaps[free] else none
        while k > 1:
            k >>= 1
            least[k] = min(least[2 * k], least[2 * k + 1])

    def cheapest(left: int) -> int:
        """The cheapest sequence with room for `left` ids; n if there is none."""
        k = left + size
        best = least[k]
        while k > 1:
            if not k & 1:
                best = min(best, least[k + 1])
            k >>= 1
        return best[1]

    def emptiest() -> int:
        k = 1
        while k < size:
            k = 2 * k + 1 if least[2 * k + 1] < none else 2 * k
        return least[k][1]

    def put(piece: int, start: int, length: int, s: int) -> None:
        free = room - used[s]
        out.append((piece, start, length, s, used[s]))
        used[s] += length
        cost[s] += length + QUADRATIC * length * length
        # The sequence is the first of its heap.
        heapq.heappop(heaps[free])
        follow(free)
        if free > length:
            heapq.heappush(heaps[free - length], (cost[s], s))
            follow(free - length)

    if n:
        heaps[room] = [(0.0, s) for s in range(n)]
        follow(room)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[piece]
        while left:
            s, take = cheapest(left), left
            if s == n:
                # None has room for the whole.
                s = emptiest()
                take = room - used[s]
            put(piece, start, take, s)
            start, left = start + take, left - take
    return out


def sequence_base(part: int, block: int, sequences: int) -> int:
    """The number of a block's first sequence. No two blocks share one; what doesn't fit is an error."""
    if part >> (63 - IN_BLOCK - IN_PART) or block >> IN_PART or sequences > 1 << IN_BLOCK:
        raise OverflowError(f"partition {part}, block {block} of {sequences} sequences is beyond the numbers of sequences")
    return (part << (IN_BLOCK + IN_PART)) + (block << IN_BLOCK)


def _pack(vocabulary: str, length: int, separator: int):
    def block(rows: list[tuple], part: int, number: int):
        """rows: (doc_id, ids as bytes)"""
        lens = [len(x) // 4 for _, x in rows]
        pieces = []
        k = 0
        for r, n in enumerate(lens):
            for start in range(0, n - n % length, length):
                pieces.append((r, start, length, k, 0))
                k += 1
        rest = [r for r, n in enumerate(lens) if n % length]
        for i, at, m, s, off in place([lens[r] % length for r in rest], length):
            pieces.append((rest[i], lens[rest[i]] // length * length + at, m, k + s, off))
        cols = list(zip(*pieces))
        first = sequence_base(part, number, max(cols[3]) + 1)
        return pa.record_batch(
            [
                pa.array([rows[r][0] for r in cols[0]], pa.int64()),
                pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.int64()),
                pa.array([zlib.crc32(rows[r][1][4 * a : 4 * (a + m)]) for r, a, m in zip(*cols[:3])], pa.int64()),
                pa.array([lens[r] for r in cols[0]], pa.int64()),
                pa.array([first + s for s in cols[3]], pa.int64()),
                pa.array(cols[4], pa.int64()),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches):
        from pyspark import TaskContext

        enc, part, blocks, rows, size = encoder(vocabulary), TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            docs, texts = batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text")
            for i, j in pieces(raw(texts)[1], 2 * CHUNK):
                ids, at = enc.encode(texts[i:j])
                for k, d in enumerate(docs[i:j]):
                    rows.append((d, ids[at[k] : at[k + 1]].astype("<u4").tobytes() + np.uint32(separator).astype("<u4").tobytes()))
                    size += len(rows[-1][1])
                if len(rows) >= BLOCK or size >= 32 * CHUNK:
                    yield block(rows, part, blocks)
                    blocks, rows, size = blocks + 1, [], 0
        if rows:
            yield block(rows, part, blocks)

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, a row per piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_pack(vocabulary, length, separator)), schema)


def op8(docs: DataFrame) -> DataFrame:
    return pack(docs)
