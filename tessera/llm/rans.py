"""Token ids in a compact file format: a static range asymmetric numeral system.

A segment holds the ids of documents in turn. Its header has the documents, the frequency table that all its blocks
share, and a checkpoint for each block: its number of ids, where its bytes are, the states of its interleaved lanes and
a checksum of its ids and bytes. So each block is decoded by itself, and a block's lanes are decoded side by side in numpy.

A segment is a file. Tasks write theirs, in ascending doc_id order, into a folder that all share, under names that no other
attempt has; a manifest, a table that is committed as a whole, names the files that count, with their places, sizes and
checksums. So a task that runs twice leaves a file that is never read, and what a lost executor wrote is there. The first
id's number of a segment is told in two levels: within its partition by the task, and over partitions from a total of each.

Cases: null or empty text is the end id alone. A null doc_id comes first. Repeated rows are written each. A text is encoded as
a whole, however long, into one segment, whose documents have 2^32 ids at most. Extra columns are ignored, whatever their names.
An empty table has an empty manifest, and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.kernel import CHUNK, pieces, raw
from tessera.llm.tokens import VOCABULARY, encoder

END = 2
MAGIC, BITS, LOW = b"TSRA", 20, np.uint64(1 << 31)
MANIFEST = "part int, seg int, before long, n_ids long, n_docs long, n_bytes long, crc32 long, file string"
SEGMENT, BLOCK, LANES = 1 << 22, 1 << 20, 2048
_U32 = np.uint64(32)


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their frequencies out of 2**BITS, each at least 1."""
    n = np.bincount(ids)
    symbols = np.flatnonzero(n)
    n = n[symbols]
    if len(symbols) > 1 << BITS:
        raise ValueError(f"more than {1 << BITS} symbols in a segment")
    f = np.maximum(1, n * (1 << BITS) // max(1, len(ids)))
    over = int(f.sum()) - (1 << BITS)
    while over > 0:  # take from the most frequent what the rare ones were given
        big = np.flatnonzero(f > 1)
        take = np.minimum(f[big] - 1, np.maximum(1, f[big] * over // int(f[big].sum())))
        take[np.cumsum(take) > over] = 0
        if not take.any():
            take[np.argmax(f[big])] = min(over, int(f[big].max()) - 1)
        f[big] -= take
        over = int(f.sum()) - (1 << BITS)
    f[np.argmax(f)] -= over
    return symbols.astype(np.uint32), f.astype(np.uint64)


def encode_block(k: np.ndarray, f: np.ndarray, cum: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """k: places in the table. The words to read, and the states to start from."""
    x = np.full(lanes, LOW, np.uint64)
    out = []
    limit = (LOW >> np.uint64(BITS)) << _U32
    for at in range((len(k) - 1) // lanes * lanes, -1, -lanes):
        s = k[at : at + lanes]
        fs, y = f[s], x[: len(s)]
        full = y >= limit * fs
        out.append(y[full].astype(np.uint32))
        y = np.where(full, y >> _U32, y)
        q = y // fs
        x[: len(s)] = (q << np.uint64(BITS)) + (y - q * fs) + cum[s]
    return np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32), x


def decode_block(words: np.ndarray, states: np.ndarray, n: int, slot: np.ndarray, f: np.ndarray, cum: np.ndarray) -> np.ndarray:
    x, lanes, at = states.copy(), len(states), 0
    out = np.empty(n, np.int64)
    low = np.uint64((1 << BITS) - 1)
    for i in range(0, n, lanes):
        y = x[: min(lanes, n - i)]
        m = y & low
        s = slot[m]
        out[i : i + len(s)] = s
        y = f[s] * (y >> np.uint64(BITS)) + m - cum[s]
        more = np.flatnonzero(y < LOW)
        y[more] = (y[more] << _U32) | words[at : at + len(more)]
        at += len(more)
        x[: len(s)] = y
    return out


def pack_segment(doc_ids: list[int | None], lens: list[int], ids: np.ndarray) -> bytes:
    symbols, f = table(ids)
    cum = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    k = place[ids]
    checkpoints, body = [], b""
    for at in range(0, len(ids), BLOCK):
        part = k[at : at + BLOCK]
        lanes = max(1, min(LANES, len(part) // 64))
        words, states = encode_block(part, f, cum, lanes)
        payload = states.tobytes() + words.astype("<u4").tobytes()
        checkpoints.append(struct.pack("<IIQII", len(part), lanes, len(body), len(payload), zlib.crc32(payload, zlib.crc32(ids[at : at + BLOCK].astype("<u4").tobytes()))))
        body += payload
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(lens, "<u4").tobytes()
    head = zlib.compress(docs + np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + f.astype("<u4").tobytes(), 6)
    return MAGIC + struct.pack("<IIIII", len(doc_ids), len(symbols), len(checkpoints), len(head), zlib.crc32(head)) + head + b"".join(checkpoints) + body


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids. A damaged segment raises an error."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n_docs, n_symbols, n_blocks, n_head, crc = struct.unpack_from("<IIIII", data, 4)
    head = data[24 : 24 + n_head]
    if zlib.crc32(head) != crc:
        raise ValueError("damaged header")
    head = zlib.decompress(head)
    ids_, null, lens = np.frombuffer(head, "<i8", n_docs), np.frombuffer(head, "u1", n_docs, 8 * n_docs), np.frombuffer(head, "<u4", n_docs, 9 * n_docs)
    symbols = np.cumsum(np.frombuffer(head, "<u4", n_symbols, 13 * n_docs), dtype=np.uint32)
    f = np.frombuffer(head, "<u4", n_symbols, 13 * n_docs + 4 * n_symbols).astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
    slot = np.repeat(np.arange(n_symbols, dtype=np.int32), f.astype(np.int64))
    at = 24 + n_head
    body, out = at + 24 * n_blocks, []
    for b in range(n_blocks):
        n, lanes, start, size, crc = struct.unpack_from("<IIQII", data, at + 24 * b)
        states = np.frombuffer(data, "<u8", lanes, body + start)
        words = np.frombuffer(data, "<u4", (size - 8 * lanes) // 4, body + start + 8 * lanes).astype(np.uint64)
        ids = symbols[decode_block(words, states, n, slot, f, cum)]
        if zlib.crc32(data[body + start : body + start + size], zlib.crc32(ids.astype("<u4").tobytes())) != crc:
            raise ValueError(f"damaged block {b}")
        out.append(ids)
    return [None if x else int(d) for d, x in zip(ids_, null)], lens, np.concatenate(out) if out else np.zeros(0, np.uint32)


def _write(folder: str, vocabulary: str, end: int, limit: int):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        enc, part, seg, before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        store, base = fs.FileSystem.from_uri(folder)
        docs, lens, ids, size = [], [], [], 0

        def flush():
            data, name = pack_segment(docs, lens, np.concatenate(ids)), f"{part:06d}-{seg:06d}-{uuid.uuid4().hex}.tsra"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            row = (part, seg, before, size, len(docs), len(data), zlib.crc32(data), name)
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string()))], [c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            names, texts = batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text")
            for i, j in pieces(raw(texts)[1], 8 * CHUNK):
                got, at = enc.encode(texts[i:j])
                got = np.insert(got, at[1:], end)
                docs += names[i:j]
                lens += (np.diff(at) + 1).tolist()
                ids.append(got)
                size += len(got)
                if size >= limit:
                    yield flush()
                    seg, before = seg + 1, before + size
                    docs, lens, ids, size = [], [], [], 0
        if docs:
            yield flush()

    return run


def _read(folder: str):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{base}/{r['file']}") as f:
                    data = f.read()
                if len(data) != r["n_bytes"] or zlib.crc32(data) != r["crc32"]:
                    raise ValueError(f"{r['file']} is damaged")
                docs, lens, ids = unpack_segment(data)
                ends = np.cumsum(lens, dtype=np.int64)
                starts = ends - lens
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(r["first"] + starts, pa.int64()), pa.array(lens.astype(np.int64)), pa.array(crcs, pa.int64())], names)

    return run


def write_ids(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """The manifest of the files that its tasks write into the folder, an address that Arrow opens (file, hdfs, s3, gs, abfs):
    part, seg, before (ids of the part's segments before), n_ids, n_docs, n_bytes, crc32, file. It must be written, once."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    d = d.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return d.mapInArrow(_write(folder, vocabulary, end, SEGMENT), MANIFEST)


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents of the files that a written manifest names, by decoding them."""
    spark = manifest.sparkSession
    offsets, first = [], 0
    for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], first))
        first += r["n"]
    known = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    rows = manifest.join(known, "part").select("file", "n_bytes", "crc32", (F.col("offset") + F.col("before")).alias("first"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "file").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "ids")
    folder = f"{scratch.base}/segments"
    return read_ids(scratch.write(write_ids(docs, folder), "manifest"), folder)
