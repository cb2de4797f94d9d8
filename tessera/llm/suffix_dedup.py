"""Exact repeated passages: every byte that lies in a 50-byte string which also starts in a document of a smaller doc_id.

Suffix arrays find them, of just the places where a repeat can be. Each window of 50 bytes is told by the least hash of
its 32-byte pieces; neighbouring windows mostly share it, and make up a run. Equal windows have equal least hashes, so
  1  texts are packed into blocks, the unit of recovery;
  2  a block sends the distinct least hashes of its runs to buckets, and gets back, a bit each, which of them occur in
     other documents too, and which have so many different strings that no task should sort them together;
  3  of those runs it sends each distinct string once, with the smallest doc_id that holds it. Where the strings of one
     least hash differ, they are suffix-sorted (gsaca), their common piece being one symbol, and neighbours whose first 50 bytes agree share their smallest
     doc_id; where they are all alike there is nothing to sort. The windows of a piece with very many contexts go apart, by a
     hash of their own: contexts that differ in a window share no window. Blocks get back the smallest doc_id of each;
  4  a block removes what a smaller doc_id covers.
No document is sent anywhere, no pair of documents is made, and a passage that many documents hold is sent once a block.

Cases: null or empty text is 0 bytes. Texts under 50 bytes lose nothing. Rows of one doc_id don't affect one another. A
null doc_id comes after all others: such rows lose what any document with an id holds, and take from none. A text is held
whole, however long, in a block of its own. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, free_shuffles
from tessera.llm.gsaca import suffix_array
from tessera.llm.kernel import _CHAR, _R, _R_INV, CHUNK, mix, powers, raw

LENGTH, PIECE = 50, 32
#: Bytes of text to a block and to a bucket; symbols to a suffix array, unless the strings of one hash are more.
BLOCK, BUCKET, BATCH = 4 << 20, 12 << 20, 1 << 15
#: Windows to a run at most, so that its length and bounds fit 16 bits.
WINDOWS = 1 << 15
#: Different strings of one least hash, counted block by block, beyond which its windows go apart.
SPLIT = 1 << 15
LAST = np.iinfo(np.int64).max


def _prefix_hash(data: np.ndarray) -> np.ndarray:
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CHAR[data] * powers(_R, len(data)), out=h[1:])
    return h


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least hash (mixed), first and last window (exclusive), and a hash of the bytes, of each run; none crosses texts."""
    out = []
    for a in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        b = min(a + CHUNK, len(data) - LENGTH + 1)
        part = data[a : b + LENGTH - 1]
        n = len(part)
        h, inverse = _prefix_hash(part), powers(_R_INV, n)
        m = mix((h[PIECE:] - h[:-PIECE]) * inverse[: n - PIECE + 1])
        width, span = LENGTH - PIECE + 1, 1
        while span * 2 <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < width:
            m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
        # Windows that reach into the next text are none.
        ok = np.ones(b - a, np.int32)
        ends = off[1:-1]
        ends = ends[(ends > a) & (ends < b + LENGTH - 1)]
        if len(ends):
            step = np.zeros(b - a + 1, np.int32)
            np.add.at(step, np.maximum(ends - LENGTH + 1, a) - a, 1)
            np.add.at(step, np.minimum(ends, b) - a, -1)
            ok = np.cumsum(step[:-1]) == 0
        ok = ok.astype(bool)
        change = np.concatenate([[True], (m[1:] != m[:-1]) | ~ok[:-1]]) | ~ok
        marks = np.append(np.flatnonzero(change), b - a)
        first, last = marks[:-1], marks[1:]
        good = ok[first]
        first, last = first[good], last[good]
        # A stretch of a short period is one run of any length: it is broken, and its parts share their least hash.
        n = -(-(last - first) // WINDOWS)
        first = np.repeat(first, n) + WINDOWS * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        last = np.minimum(first + WINDOWS, np.repeat(last, n))
        end = last + LENGTH - 1
        bytes_hash = mix((h[end] - h[first]) * inverse[first] + (end - first).astype(np.uint64))
        out.append((mix(m[first]), first + a, last + a, bytes_hash))
    if not out:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


class Block:
    """A block's texts and runs; the same whenever it is read."""

    def __init__(self, row: dict):
        lens = np.frombuffer(row["lens"], "<i8")
        self.off = np.concatenate([[0], np.cumsum(lens)])
        size = int(self.off[-1])
        self.data = np.frombuffer(pa.decompress(row["data"], size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
        self.docs = np.frombuffer(row["docs"], "<i8")
        with np.errstate(over="ignore"):
            self.m, self.first, self.last, self.hash = runs(self.data, self.off)
        self.doc = self.docs[np.searchsorted(self.off, self.first, "right") - 1] if len(self.first) else np.zeros(0, np.int64)

    def keep(self, of: np.ndarray) -> None:
        self.m, self.first, self.last, self.hash, self.doc = (x[of] for x in (self.m, self.first, self.last, self.hash, self.doc))

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct least hashes, in order, whether two documents of the block have them, and their distinct strings."""
        order = np.argsort(self.m, kind="stable")
        m, d = self.m[order], self.doc[order]
        if not len(m):
            return m, np.zeros(0, bool), np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        several = np.ones(len(new), np.int64)
        of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(m))))
        again = np.flatnonzero((np.bincount(of) > 1)[of])
        if len(again):
            g, h = of[again], self.hash[order[again]]
            by = np.lexsort((h, g))
            other = np.concatenate([[True], (g[by][1:] != g[by][:-1]) | (h[by][1:] != h[by][:-1])])
            several = np.maximum(np.bincount(g[by][other], minlength=len(new)), 1)
        return m[new], np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new), several

    def strings(self, bits: bytes, hot: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of the runs whose hash is shared: their order by (hash, bytes), and where each distinct string begins in it. Runs
        of hashes with very many strings are cut into their windows, each with a hash of its own. No other run stays."""
        own = np.unique(self.m)
        shared = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        self.keep(np.flatnonzero(shared[np.searchsorted(own, self.m)]) if len(own) else np.zeros(0, np.int64))
        busy = np.sort(np.frombuffer(hot, np.uint64))
        apart = busy[np.searchsorted(busy, self.m) % len(busy)] == self.m if len(busy) else np.zeros(0, bool)
        if apart.any():
            n = np.where(apart, self.last - self.first, 1)
            each = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            apart = apart[each]
            self.keep(each)
            self.first = self.first + at * apart
            self.last = np.where(apart, self.first + 1, self.last)
            for i in range(0, len(each), CHUNK // LENGTH):
                k = np.flatnonzero(apart[i : i + CHUNK // LENGTH]) + i
                if len(k):
                    self.hash[k] = _string_hashes(gather(self.data, self.first[k], np.full(len(k), LENGTH)), np.full(len(k), LENGTH))
            with np.errstate(over="ignore"):
                self.m[apart] = mix(self.hash[apart] + np.uint64(PIECE))
        order = np.lexsort((self.hash, self.m))
        m, h = self.m[order], self.hash[order]
        new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (h[1:] != h[:-1])])) if len(m) else np.zeros(0, np.int64)
        return order, new


def _string_hashes(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A hash of each of the strings that stand one after another."""
    with np.errstate(over="ignore"):
        g, own = _prefix_hash(data), np.cumsum(lens) - lens
        return mix((g[own + lens] - g[own]) * powers(_R_INV, len(data) + 1)[own] + lens.astype(np.uint64))


def _buckets(values: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """bucket, first and last (exclusive) of sorted hashes, for the buckets that any of them belongs to."""
    if not len(values):
        return []
    own = np.minimum(values // np.uint64((1 << 64) // n_buckets), np.uint64(n_buckets - 1)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return list(zip(own[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(own)).tolist()))


def gather(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of stretches, one after another."""
    ends = np.cumsum(lens)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)]


def _pack(batches):
    from pyspark import TaskContext

    part, k, docs, lens, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

    def block():
        data = b"".join(texts)
        packed = pa.compress(data, "zstd", asbytes=True) if data else b""
        return pa.record_batch([pa.array([(part << 20) + k], pa.int64()), pa.array([np.array(docs, "<i8").tobytes()]), pa.array([np.array(lens, "<i8").tobytes()]), pa.array([packed], pa.binary()), pa.array([len(data)], pa.int64())], ["block", "docs", "lens", "data", "size"])

    for batch in batches:
        data, off = raw(batch.column("text"))
        ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
        for i, d in enumerate(ids):
            t = data[off[i] : off[i + 1]].tobytes()
            if docs and size + len(t) > BLOCK:
                yield block()
                k, docs, lens, texts, size = k + 1, [], [], [], 0
            docs.append(LAST if d is None else d)
            lens.append(len(t))
            texts.append(t)
            size += len(t)
    if docs:
        yield block()


def _send_hashes(n_buckets: int):
    names = ["bucket", "block", "m", "twice", "several"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m, twice, strings = Block(row).hashes()
                for b, i, j in _buckets(m, n_buckets):
                    several = np.flatnonzero(strings[i:j] > 1)
                    told = np.stack([several, strings[i:j][several]]).astype("<u4").tobytes()
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([m[i:j].tobytes()]), pa.array([np.packbits(twice[i:j]).tobytes()]), pa.array([told])], names)

    return run


def _which(limit: int):
    """For each block of a bucket which of its hashes other documents have too, and the hashes with over `limit` strings."""

    def run(t: pa.Table) -> pa.Table:
        ms = [np.frombuffer(x.as_py(), np.uint64) for x in t["m"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(m)) for x, m in zip(t["twice"], ms)])
        every, at, count = np.unique(np.concatenate(ms), return_inverse=True, return_counts=True)
        shared = ((count > 1) | (np.bincount(at, twice, len(every)) > 0))[at]
        ends = np.cumsum([len(m) for m in ms])
        several = [np.frombuffer(x.as_py(), "<u4").reshape(2, -1).astype(np.int64) for x in t["several"]]
        strings = np.bincount(at[np.concatenate([x[0] + e - len(m) for x, e, m in zip(several, ends, ms)])], np.concatenate([x[1] for x in several]), len(every))
        hot = (strings > limit)[at] & shared
        return pa.table({
            "block": t["block"], "bucket": t["bucket"], "n": pa.array([len(m) for m in ms], pa.int64()),
            "bits": pa.array([np.packbits(shared[e - len(m) : e]).tobytes() for e, m in zip(ends, ms)]), "hot": pa.array([m[hot[e - len(m) : e]].tobytes() for e, m in zip(ends, ms)]),
        })

    return run


def _bits_of_block(t: pa.Table) -> pa.Table:
    rows = sorted(zip(t["bucket"].to_pylist(), t["n"].to_pylist(), t["bits"].to_pylist()))
    bits = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for _, n, x in rows])
    return pa.table({"block": t["block"][:1], "bits": pa.array([np.packbits(bits).tobytes()]), "hot": pa.array([b"".join(t["hot"].to_pylist())])})


def _send_strings(n_buckets: int):
    names = ["bucket", "block", "m", "lens", "least", "many", "size", "bytes"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Block(row)
                order, new = x.strings(row["bits"], row["hot"])
                if not len(order):
                    continue
                least, most = np.minimum.reduceat(x.doc[order], new), np.maximum.reduceat(x.doc[order], new)
                of = order[new]
                lens = x.last[of] + LENGTH - 1 - x.first[of]
                for b, i, j in _buckets(x.m[of], n_buckets):
                    data = gather(x.data, x.first[of[i:j]], lens[i:j]).tobytes()
                    yield pa.record_batch(
                        [pa.array([b], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([x.m[of[i:j]].tobytes()]), pa.array([pa.compress(lens[i:j].astype("<u2").tobytes(), "zstd", asbytes=True)]), pa.array([least[i:j].tobytes()]), pa.array([np.packbits(most[i:j] > least[i:j]).tobytes()]), pa.array([len(data)], pa.int64()), pa.array([pa.compress(data, "zstd", asbytes=True)])],
                        names,
                    )

    return run


def anchors(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where in each string the piece of the least hash m begins; -1 where it occurs more than once."""
    text = gather(data, starts, lens)
    h = _prefix_hash(text)
    hashes = mix(mix((h[PIECE:] - h[:-PIECE]) * powers(_R_INV, len(text))[: len(text) - PIECE + 1]))
    ends = np.cumsum(lens)
    owner, offset = np.repeat(np.arange(len(lens)), lens), np.arange(len(text)) - np.repeat(ends - lens, lens)
    at = np.flatnonzero((hashes == m[owner[: len(hashes)]]) & (offset[: len(hashes)] <= lens[owner[: len(hashes)]] - PIECE))
    out = np.full(len(lens), -1)
    out[owner[at]] = offset[at]
    out[np.bincount(owner[at], minlength=len(lens)) != 1] = -1
    return out


def smallest(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, m: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window of each string, one after another, the smallest doc of the strings that hold it. Strings of one
    least hash m are neighbours; those of different hashes have no window in common.

    The strings of a hash have its piece in common, so that piece is one symbol of theirs, and a window is as many
    symbols as bytes are not in it, and one. Where a string has the piece twice, its hash's strings are sorted as bytes.
    """
    windows = lens - LENGTH + 1
    base = np.cumsum(windows) - windows
    out = np.repeat(doc, windows)
    new = np.concatenate([[True], m[1:] != m[:-1]])
    group = np.cumsum(new) - 1
    several = np.flatnonzero((np.bincount(group) > 1)[group])
    if not len(several):
        return out
    with np.errstate(over="ignore"):
        anchor = np.full(len(lens), -1)
        anchor[several] = anchors(data, starts[several], lens[several], m[several])
    plain = np.zeros(int(group[-1]) + 1, bool)
    plain[group[several[anchor[several] < 0]]] = True
    for short in (True, False):
        ks = several[plain[group[several]] != short]
        size = lens[ks] - (PIECE - 1) * short + 1
        # Batches end where a group does.
        batch = np.cumsum(size) // BATCH
        batch = np.maximum.accumulate(np.where(np.concatenate([[True], group[ks][1:] != group[ks][:-1]]), batch, 0)) if len(ks) else batch
        cuts = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])) if len(ks) else []
        for i, j in zip(cuts, np.append(cuts[1:], len(ks))):
            k, n = ks[i:j], size[i:j]
            # A symbol below all bytes ends each string.
            ends = np.cumsum(n)
            owner = np.repeat(np.arange(len(k)), n)
            offset = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            byte = np.minimum(offset + (PIECE - 1) * (short & (offset > anchor[k][owner])), lens[k][owner] - 1)
            text = data[starts[k][owner] + byte].astype(np.int64) + 1
            if short:
                own = offset == anchor[k][owner]
                text[own] = 257 + group[k][owner[own]] - group[k[0]]
            text[ends - 1] = 0
            sa = suffix_array(text)
            sa = sa[offset[sa] < windows[k][owner[sa]]]
            view = np.lib.stride_tricks.sliding_window_view(text.astype(np.int32), LENGTH - (PIECE - 1) * short)
            same = np.zeros(len(sa), bool)
            for p in range(1, len(sa), 1 << 14):
                q = min(p + (1 << 14), len(sa))
                same[p:q] = (view[sa[p - 1 : q - 1]] == view[sa[p:q]]).all(1)
            first = np.flatnonzero(~same)
            least = np.minimum.reduceat(doc[k][owner[sa]], first)
            out[base[k][owner[sa]] + offset[sa]] = np.repeat(least, np.diff(np.append(first, len(sa))))
    return out


def _sort(t: pa.Table) -> pa.Table:
    """For each block of a bucket: stretches of windows of its strings, each with the smallest doc_id that holds them."""
    parts = [(np.frombuffer(m, np.uint64), np.frombuffer(pa.decompress(n, 2 * (len(m) // 8), "zstd"), "<u2").astype(np.int64), np.frombuffer(d, np.int64), np.unpackbits(np.frombuffer(f, np.uint8), count=len(m) // 8), np.frombuffer(pa.decompress(x, s, "zstd"), np.uint8)) for m, n, d, f, s, x in zip(*(t[c].to_pylist() for c in ("m", "lens", "least", "many", "size", "bytes")))]
    m, lens, least, many, data = (np.concatenate(x) for x in zip(*parts))
    starts = np.cumsum(lens) - lens
    h = np.concatenate([_string_hashes(p[4], p[1]) for p in parts])
    order = np.lexsort((h, m))
    new = np.concatenate([[True], (m[order][1:] != m[order][:-1]) | (h[order][1:] != h[order][:-1])])
    which = np.empty(len(m), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    of = order[first]
    docs = smallest(data, starts[of], lens[of], m[of], np.minimum.reduceat(least[order], first))
    windows = lens[of] - LENGTH + 1
    # Stretches of windows with one smallest doc_id.
    string = np.repeat(np.arange(len(of)), windows)
    cut = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (string[1:] != string[:-1])]))
    end = np.append(cut[1:], len(docs))
    per = np.bincount(string[cut], minlength=len(of))
    from_ = np.cumsum(per) - per
    begin = cut - (np.cumsum(windows) - windows)[string[cut]]
    until = begin + (end - cut)
    least_of = docs[cut]
    out = {"block": [], "bucket": [], "n": [], "string": [], "a": [], "b": [], "doc": []}
    at = 0
    for p, block in zip(parts, t["block"].to_pylist()):
        w = which[at : at + len(p[0])]
        n = per[w]
        own = np.repeat(np.arange(len(w)), n)
        k = np.arange(int(n.sum())) + np.repeat(from_[w] - (np.cumsum(n) - n), n)
        used = (least_of[k] < p[2][own]) | (p[3][own] > 0)
        own, k = own[used], k[used]
        out["block"].append(block)
        out["bucket"].append(t["bucket"][0].as_py())
        out["n"].append(len(w))
        for name, x in (("string", own.astype("<u4")), ("a", begin[k].astype("<u2")), ("b", until[k].astype("<u2")), ("doc", least_of[k])):
            out[name].append(x.tobytes())
        at += len(w)
    return pa.table({"block": pa.array(out["block"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), "n": pa.array(out["n"], pa.int64()), **{c: pa.array(out[c], pa.binary()) for c in ("string", "a", "b", "doc")}})


def _remove(keep_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]

    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            x = Block(row)
            step = np.zeros(len(x.data) + 1, np.int32)
            if len(found):
                order, new = x.strings(row["bits"], row["hot"])
                rows = sorted(found.to_pylist(), key=lambda r: r["bucket"])
                base = np.cumsum([0] + [r["n"] for r in rows])
                string = np.concatenate([np.frombuffer(r["string"], "<u4").astype(np.int64) + b for r, b in zip(rows, base)])
                a, b = (np.concatenate([np.frombuffer(r[c], "<u2") for r in rows]).astype(np.int64) for c in "ab")
                doc = np.concatenate([np.frombuffer(r["doc"], "<i8") for r in rows])
                size = np.diff(np.append(new, len(order)))
                n = size[string]
                k = np.repeat(np.arange(len(string)), n)
                run_ = order[np.arange(int(n.sum())) + np.repeat(new[string] - (np.cumsum(n) - n), n)]
                hit = doc[k] < x.doc[run_]
                k, run_ = k[hit], run_[hit]
                np.add.at(step, x.first[run_] + a[k], 1)
                np.add.at(step, x.first[run_] + b[k] + LENGTH - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = x.off[:-1][np.diff(x.off) > 0]
            begins[inner] = gone[inner]
            total, starts = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
            kept = x.data[~gone].tobytes()
            for i, d in enumerate(x.docs.tolist()):
                p, q = int(x.off[i]), int(x.off[i + 1])
                mine = kept[p - int(total[p]) : q - int(total[q])]
                out.append((None if d == LAST else d, q - p, int(total[q] - total[p]), int(starts[q] - starts[p]), hashlib.sha256(mine).hexdigest(), *([mine] if keep_text else [])))
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(names, zip(*out), types)})

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the bytes kept, a row per document."""
    scratch = Scratch(spark, "suffix")
    schema = "block long, docs binary, lens binary, data binary, size long"
    blocks = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack, schema), "blocks")
    n_buckets = max(2, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // BUCKET))
    bits = blocks.mapInArrow(_send_hashes(n_buckets), "bucket int, block long, m binary, twice binary, several binary").groupBy("bucket").applyInArrow(_which(SPLIT), "block long, bucket int, n long, bits binary, hot binary")
    bits = scratch.write(bits.groupBy("block").applyInArrow(_bits_of_block, "block long, bits binary, hot binary"), "bits")
    free_shuffles(spark)
    size = bits.agg(F.sum(F.octet_length("bits") + F.octet_length("hot"))).first()[0] or 0
    told = lambda how: blocks.join(F.broadcast(bits) if size <= 32 << 20 else bits, "block", how)
    found = told("inner").mapInArrow(_send_strings(n_buckets), "bucket int, block long, m binary, lens binary, least binary, many binary, size long, bytes binary")
    found = scratch.write(found.groupBy("bucket").applyInArrow(_sort, "block long, bucket int, n long, string binary, a binary, b binary, doc binary"), "found")
    free_shuffles(spark)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return told("left").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove(keep_text), result)


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return remove_repeats(spark, docs)
