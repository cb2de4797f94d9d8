"""Language-model scores: n-grams of any order with Katz back-off, evaluated recursively.

P(w | h) = d(c) c(h w) / c(h) where training saw h w, else alpha(h) P(w | h'), h' being h without its first word, down to
P(w) = d(c) c(w) / N of known words, and what the discounts leave for an unknown word. The d are Good-Turing discounts
of each order (up to a count of GT), and alpha(h) makes the probabilities that follow h add up to one exactly. Every
n-gram of the training texts is in the model, whatever its count. Texts begin with as many start marks as a context
holds; the end counts as a token.

The corpus is packed into blocks of word numbers, the unit of recovery. Each order takes one exchange: a block sends its
distinct n-grams, by context, to the buckets of that order, with how often its training texts hold them; a bucket adds
them up, keeps its part of the table, and answers each block with the counts of its n-grams, and the profile of
each of its contexts: how many n-grams were seen once to GT times, the sum of the other counts, and the sum of the lower
order's probabilities of those seen. From that a block has d, alpha and P of its tokens, hence what the next order needs:
an n-gram that was seen has a seen suffix, whose probability is told by two whole numbers.
A context of over 1 / HOT of all tokens (so HOT of them at most) is dealt to several buckets by the word that follows;
its profile is added up, and broadcast. The table's parts are rows of a Parquet table for each order (see `table_of`).

Cases: null or empty text is the end token alone. Repeated rows are counted and scored each. A null doc_id is in no
fold: it is trained on, and held_out is false. Without training texts every token is unknown. A text is held whole, however
long, in one block. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, free_shuffles, held_out
from tessera.llm.kernel import mix, spans, texts, word_hashes

START, END = np.uint64(1), np.uint64(2)
GT, HOT, ORDER = 5, 1 << 20, 2
#: Tokens to a block, to a bucket, and of one context to a bucket.
TOKENS, BUCKET, SPLIT = 1_500_000, 750_000, 500_000
#: An order's buckets are served in so many passes, one after another, of which each frees its shuffles.
PASSES = 2
_A = np.uint64(0xC2B2AE3D27D4EB4F)
#: Of a context: n-grams seen once to GT times, and the sum of the other counts.
PROFILE = GT + 1
_ROWS = "kind int, block long, bucket int, a binary, b binary, c binary, d binary, e binary, stats array<long>"


def _z(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Numbers, byte by byte of their places, compressed."""
    size = np.dtype(kind).itemsize
    raw = x.astype(kind).reshape(-1).view(np.uint8).reshape(-1, size).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _un(z: bytes, kind: str = "<u8") -> np.ndarray:
    if not z:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(z[8:], int.from_bytes(z[:8], "little"), "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def short(w: np.ndarray) -> np.ndarray:
    """48 bits that tell words apart that follow one context."""
    return mix(w) >> np.uint64(16)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of a context and the short of the word that follows."""
    return mix(v * _A + w)


def _begins(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value begins among sorted ones."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _pack(limit: int):
    """Blocks: docs, flags (1: no doc_id, 2: held out), tokens to each, distinct word hashes, and the words' numbers."""

    def block(part: int, k: int, held: list):
        ids, flags, lens, tokens = (np.concatenate(x) for x in zip(*held))
        words, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
        # Frequent words have small numbers.
        by = np.argsort(-n, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        words, at = words[by], rank[at]
        cols = [[(part << 32) + k], [ids.tobytes()], [flags.tobytes()], [_z(lens)], [words.tobytes()], [_z(at, "<u4")]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] + [pa.binary()] * 5)], ["block", "docs", "flags", "lens", "words", "at"])

    def run(batches):
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flags = (null + 2 * batch.column("held_out").to_numpy(zero_copy_only=False)).astype(np.uint8)
                for i, j, data, off in texts(batch):
                    starts, ends, first = spans(data, off)
                    held.append((ids[i:j], flags[i:j], np.diff(first) + 1, np.insert(word_hashes(data, starts, ends), first[1:], END)))
                    size += len(held[-1][3])
                    if size >= limit:
                        yield block(part, k, held)
                        k, size = k + 1, 0
                        held.clear()
            if held:
                yield block(part, k, held)
        pa.default_memory_pool().release_unused()

    return run


class Model:
    """What a block needs besides the answers, for each order: d, and the profiles of split contexts, sorted by key."""

    def __init__(self):
        self.n = self.types = self.n_docs = 0
        self.total = self.unknown = 1.0
        self.n_buckets = 2
        #: Contexts that occur more often than `large` are dealt to several buckets, `piece` of their tokens to each.
        self.large = self.piece = SPLIT
        self.discounts: list[list[float]] = [[]]
        self.split: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [None, None]

    def kept(self, c: np.ndarray, order: int) -> np.ndarray:
        """d(c) c"""
        few = np.array(self.discounts[order]) * np.arange(GT + 1)
        return np.where(c > GT, c, few[np.minimum(c, GT)])

    def weights(self, den: np.ndarray, profile: np.ndarray, below: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each context what its counts are divided by, and alpha. Where no discount leaves anything, one more token
        than was seen is taken to have followed. An unseen context leaves all to the lower order."""
        d = np.array(self.discounts[order])
        kept = profile[:, :GT] @ (d[1:] * np.arange(1, GT + 1)) + profile[:, GT]
        by = np.where(kept >= den * (1 - 1e-9), den + 1, den).astype(np.float64)
        least = self.unknown if order == 2 else 1e-15
        alpha = np.where(den > 0, (by - kept) / np.maximum(by, 1) / np.maximum(1 - below, least), 1.0)
        return np.maximum(by, 1), alpha


class Block:
    """A block's tokens, and the orders that are known of them."""

    def __init__(self, row: dict, model: Model):
        self.model = model
        self.docs, self.flags, self.lens = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["flags"], "u1"), _un(row["lens"]).astype(np.int64)
        self.words, self.at = np.frombuffer(row["words"], np.uint64), _un(row["at"], "<u4").astype(np.int64)
        self.w = self.words[self.at]
        self.begin = np.zeros(len(self.at), bool)
        self.begin[np.cumsum(self.lens) - self.lens] = True
        self.train = np.repeat(self.flags & 2 == 0, self.lens)
        self.gram, self.order = self.w, 1

    def shifted(self, x: np.ndarray, first) -> np.ndarray:
        """Of each token what x says of the one before; `first` at the beginning of a text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.begin] = first
        return out

    def learn_words(self, counts: np.ndarray) -> None:
        """The counts of the block's words give P(w)."""
        m = self.model
        self.count = counts.astype(np.int64)[self.at]
        self.known = self.count
        self.by = np.full(len(self.at), m.total)
        self.p = np.where(self.count > 0, m.kept(self.count, 1) / m.total, m.unknown)

    def next_order(self) -> None:
        """Contexts and n-grams of the next order, sorted by bucket, context and n-gram."""
        m = self.model
        self.context = self.shifted(self.gram, START)
        self.den = self.shifted(self.count, m.n_docs)
        self.gram = pair_key(self.context, short(self.w))
        self.order += 1
        key, at, self.of = np.unique(self.gram, return_index=True, return_inverse=True)
        context, den = self.context[at], self.den[at]
        several = np.where(den > m.large, -(-den // m.piece), 1).astype(np.uint64)
        bucket = mix(context + mix(self.w[at]) % several) if len(at) else context
        self.bucket = (bucket % np.uint64(m.n_buckets)).astype(np.int64)
        self.sorted = np.lexsort((key, context, self.bucket))
        self.keys, self.first = key, at

    def send(self, part: int):
        """A row for each bucket of this pass: contexts, n-grams to each, their c(h); the words that follow, times here, and
        the two numbers that tell the lower order's probability."""
        s = self.sorted
        context, bucket, at = self.context[self.first][s], self.bucket[s], self.first[s]
        here = np.bincount(self.of, self.train, len(self.keys))[s].astype(np.int64)
        cuts = np.append(_begins(bucket), len(s))
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j or bucket[i] % PASSES != part:
                continue
            new = _begins(context[i:j])
            n = np.diff(np.append(new, j - i))
            told = np.stack([here[i:j], self.count[at[i:j]], self.by[at[i:j]].astype(np.int64) if self.order > 2 else np.zeros(j - i, np.int64)])
            yield int(bucket[i]), context[i:j][new].tobytes(), _z(np.stack([n, self.den[at[i:j]][new]])), _six(short(self.w[at[i:j]])), _z(told)

    def learn(self, answers: list[dict]) -> None:
        """Counts and profiles, by bucket, give P of this order."""
        m, s = self.model, self.sorted
        answers = sorted(answers, key=lambda r: r["bucket"])
        counts = np.concatenate([_un(r["a"]) for r in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
        profile = np.concatenate([_un(r["b"]).reshape(PROFILE, -1).T for r in answers]).astype(np.int64) if answers else np.zeros((0, PROFILE), np.int64)
        below = np.concatenate([_un(r["c"], "<f8") for r in answers]) if answers else np.zeros(0)
        context, bucket = self.context[self.first][s], self.bucket[s]
        new = _begins(bucket, context)
        own = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(s))))
        keys, many, under = m.split[self.order]
        if len(keys) and len(new):
            at = np.minimum(np.searchsorted(keys, context[new]), len(keys) - 1)
            hit = keys[at] == context[new]
            profile, below = profile.copy(), below.copy()
            profile[hit], below[hit] = many[at[hit]], under[at[hit]]
        by, alpha = m.weights(self.den[self.first[s]][new], profile, below, self.order)
        place = np.empty(len(s), np.int64)
        place[s] = np.arange(len(s))
        place = place[self.of]
        self.count = counts[place]
        self.by = by[own[place]]
        self.p = np.where(self.count > 0, m.kept(self.count, self.order) / self.by, alpha[own[place]] * self.p)


def _known(row: dict, answers: list[dict], model: Model) -> Block:
    """A block with all orders that have been answered."""
    x = Block(row, model)
    mine = [r for r in answers if r["order"] == 1]
    counts = np.concatenate([_un(r["a"]) for r in sorted(mine, key=lambda r: r["bucket"])]) if mine else np.zeros(0)
    x.learn_words(counts[np.argsort(np.argsort(x.words % np.uint64(model.n_buckets), kind="stable"), kind="stable")] if len(counts) else counts)
    for order in range(2, max((r["order"] for r in answers), default=1) + 1):
        x.next_order()
        x.learn([r for r in answers if r["order"] == order])
    return x


_SENT = ["bucket", "block", "a", "b", "c", "d"]


def _sent(rows) -> pa.Table:
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.table({c: pa.array(x, t) for c, x, t in zip(_SENT, zip(*rows) if rows else [[]] * 6, types)})


def _send_words(n_buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Block(row, None)
                here = np.bincount(x.at, x.train, len(x.words)).astype(np.int64)
                bucket = (x.words % np.uint64(n_buckets)).astype(np.int64)
                s = np.argsort(bucket, kind="stable")
                cuts = np.append(_begins(bucket[s]), len(s))
                rows = [(int(bucket[s[i]]), row["block"], x.words[s[i:j]].tobytes(), b"", b"", _z(here[s[i:j]])) for i, j in zip(cuts[:-1], cuts[1:])]
                yield from _sent(rows).to_batches()

    return run


def _stats(c: np.ndarray) -> list[int]:
    """Sum and number of the counts, and how many are 1 to GT + 1."""
    c = c[c > 0]
    return [int(c.sum()), len(c), *np.bincount(np.minimum(c, GT + 2), minlength=GT + 3)[1 : GT + 2].tolist()]


def _answers(rows: list[tuple]) -> pa.Table:
    names = ["kind", "block", "bucket", "a", "b", "c", "d", "e", "stats"]
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64())]
    return pa.table({c: pa.array(x, t) for c, x, t in zip(names, zip(*rows), types)})


def _merge_words(t: pa.Table) -> pa.Table:
    """Kind 0 answers a block; kind 1 is the bucket's part of the table: words and counts."""
    bucket = t["bucket"][0].as_py()
    words = [np.frombuffer(x.as_py(), np.uint64) for x in t["a"]]
    here = np.concatenate([_un(x.as_py()) for x in t["d"]]).astype(np.int64)
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    c = np.bincount(at, here, len(every)).astype(np.int64)
    ends = np.cumsum([len(x) for x in words])
    rows = [(0, b, bucket, _z(c[at[e - len(x) : e]]), b"", b"", b"", b"", None) for b, x, e in zip(t["block"].to_pylist(), words, ends)]
    seen = c > 0
    return _answers([*rows, (1, 0, bucket, every[seen].tobytes(), _z(c[seen]), b"", b"", b"", _stats(c))])


def _merge(shared, order: int):
    """Kind 0 answers a block; kind 1 is the bucket's part of the table: contexts, n-grams to each, c(h), n-grams with counts,
    profiles and sums of lower probabilities; kind 2 the same profiles of contexts that other buckets have, too."""

    def run(t: pa.Table) -> pa.Table:
        m, bucket = shared.value, t["bucket"][0].as_py()
        contexts = [np.frombuffer(x.as_py(), np.uint64) for x in t["a"]]
        sizes = [_un(x.as_py()).reshape(2, -1).astype(np.int64) for x in t["b"]]
        words = [_unsix(x.as_py()) for x in t["c"]]
        told = np.concatenate([_un(x.as_py()).reshape(3, -1) for x in t["d"]], axis=1).astype(np.int64)
        heads, of_head = np.unique(np.concatenate(contexts), return_inverse=True)
        den = np.zeros(len(heads), np.int64)
        den[of_head] = np.concatenate([s[1] for s in sizes])
        head = np.repeat(of_head, np.concatenate([s[0] for s in sizes]))
        words_at = np.concatenate(words)
        with np.errstate(over="ignore"):
            every, at, of = np.unique(pair_key(heads[head], words_at), return_index=True, return_inverse=True)
        c = np.bincount(of, told[0], len(every)).astype(np.int64)
        seen, head_of = c > 0, head[at]
        lower = m.kept(told[1][at], order - 1) / (told[2][at] if order > 2 else m.total)
        profile = np.zeros((PROFILE, len(heads)), np.int64)
        for r in range(1, GT + 1):
            profile[r - 1] = np.bincount(head_of[c == r], minlength=len(heads))
        profile[GT] = np.bincount(head_of[c > GT], c[c > GT], len(heads))
        below = np.bincount(head_of[seen], lower[seen], len(heads))
        rows, g, h = [], 0, 0
        for b, hs, s, gs in zip(t["block"].to_pylist(), contexts, sizes, words):
            mine, own = c[of[g : g + len(gs)]], of_head[h : h + len(hs)]
            # Only contexts of an unseen n-gram need alpha.
            bare = np.add.reduceat(mine == 0, np.cumsum(s[0]) - s[0]) > 0
            rows.append((0, b, bucket, _z(mine), _z(profile[:, own]), _z(np.where(bare, below[own], 0.0), "<f8"), b"", b"", None))
            g, h = g + len(gs), h + len(hs)
        by = np.argsort(head_of[seen], kind="stable")
        n = np.bincount(head_of[seen], minlength=len(heads))
        rows.append((1, 0, bucket, heads.tobytes(), _z(np.concatenate([[n, den], profile])), _six(words_at[at][seen][by]), _z(c[seen][by]), _z(below, "<f8"), _stats(c)))
        large = den > m.large
        if large.any():
            rows.append((2, 0, bucket, heads[large].tobytes(), _z(profile[:, large]), _z(below[large], "<f8"), b"", b"", None))
        return _answers(rows)

    return run


def _unpack_split(batches):
    for batch in batches:
        for a, b, c in zip(*(batch.column(x).to_pylist() for x in "abc")):
            p = _un(b).reshape(PROFILE, -1).astype(np.int64)
            yield pa.record_batch([pa.array(np.frombuffer(a, "<i8")), *map(pa.array, p), pa.array(_un(c, "<f8"))], ["context", *(f"p{i}" for i in range(PROFILE)), "below"])


def discounts(of: list[int]) -> list[float]:
    """d(r) for r from 0 to GT by Good and Turing from how many were seen 1 to GT + 1 times; (r - 0.5) / r where those
    don't serve."""
    n = [0, *of]
    out, tail = [0.0], (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT + 1):
        d = 0.0
        if n[1] and n[r] and tail < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _score(shared):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        m, out = shared.value, []
        norm = m.n + 0.5 * (m.types + 1)
        answers = answers.to_pylist()
        with np.errstate(over="ignore"):
            for row in blocks.to_pylist():
                x = _known(row, answers, m)
                first = np.cumsum(x.lens) - x.lens
                add = lambda v, first=first: np.add.reduceat(v, first)
                out.append((x.docs, x.flags, x.lens, add((x.known > 0).astype(np.int64)), add(np.log10((x.known + 0.5) / norm)), add(np.log10(x.p))))
        ids, flags, lens, known, base, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"doc_id": pa.array(ids, mask=(flags & 1).astype(bool)), "held_out": pa.array((flags & 2).astype(bool)), "n_tokens": pa.array(lens), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def _send(shared, part: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers = [], answers.to_pylist()
        with np.errstate(over="ignore"):
            for row in blocks.to_pylist():
                x = _known(row, answers, shared.value)
                x.next_order()
                rows += [(b, row["block"], *r) for b, *r in x.send(part)]
        return _sent(rows)

    return run


class Trained:
    """The written tables, and the numbers that every task needs."""

    def __init__(self, spark: SparkSession, docs: DataFrame, order: int = ORDER):
        self.spark, self.order, self.scratch, self.model = spark, order, Scratch(spark, "katz"), Model()
        m = self.model
        fold = F.coalesce(held_out(F.col("doc_id"), 1), F.lit(False))
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.alias("held_out"))
        self.blocks = self.scratch.write(d.mapInArrow(_pack(TOKENS), "block long, docs binary, flags binary, lens binary, words binary, at binary"), "blocks")
        m.n_buckets = max(2, -(-(self.blocks.count() * TOKENS) // BUCKET))
        sent = "bucket int, block long, a binary, b binary, c binary, d binary"
        self.parts = [None, self._write(self.blocks.mapInArrow(_send_words(m.n_buckets), sent), _merge_words, 1)]
        free_shuffles(spark)
        got = self._totals(1)
        m.n, m.types, of = got[0], got[1], got[2:]
        m.n_docs = self._end_count()
        m.discounts.append(discounts(of))
        if m.n:
            # What the discounts leave is the unknown word's; where they leave nothing, one more token stands for it.
            kept = sum(r * c * m.discounts[1][r] for r, c in enumerate(of[:GT], 1)) + m.n - sum(r * c for r, c in enumerate(of[:GT], 1))
            m.total = float(m.n) if m.n - kept > 1e-9 * m.n else m.n + 1.0
            m.unknown = (m.total - kept) / m.total
            m.large = max(SPLIT, m.n // HOT)
        for n in range(2, order + 1):
            done = None
            for part in range(PASSES):
                out = self._write(self._cogroup(_send(self._shared(), part), sent), _merge(self._shared(), n), n, part)
                free_shuffles(spark)
                done = out if done is None else done.unionByName(out)
            self.parts.append(done)
            m.discounts.append(discounts(self._totals(n)[2:]))
            m.split.append(self._split(n))

    def _shared(self):
        return self.spark.sparkContext.broadcast(self.model)

    def _write(self, sent: DataFrame, merge, n: int, part: int = 0) -> DataFrame:
        return self.scratch.write(sent.groupBy("bucket").applyInArrow(merge, _ROWS), f"order{n}-{part}", "kind")

    def _cogroup(self, run, schema: str) -> DataFrame:
        """run over each block with the answers that it has had."""
        answers = None
        for n, part in enumerate(self.parts[1:], 1):
            part = part.where("kind = 0").select("block", F.lit(n).alias("order"), "bucket", "a", "b", "c")
            answers = part if answers is None else answers.unionByName(part)
        return self.blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    def _totals(self, n: int) -> list[int]:
        sums = [F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(GT + 3)]
        return list(self.parts[n].where("kind = 1").agg(*sums).first())

    def _end_count(self) -> int:
        """How many training texts there are: each ends once."""
        flags = self.blocks.select("flags").mapInArrow(_count_texts, "n long")
        return flags.agg(F.sum("n")).first()[0] or 0

    def _split(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = [f"p{i}" for i in range(PROFILE)]
        plain = self.parts[n].where("kind = 2").select("a", "b", "c").mapInArrow(_unpack_split, "context long, " + ", ".join(f"{x} long" for x in names) + ", below double")
        rows = plain.groupBy("context").agg(*[F.sum(x).alias(x) for x in (*names, "below")]).collect()
        keys = np.array([r.context for r in rows], np.int64).view(np.uint64)
        by = np.argsort(keys)
        return keys[by], np.array([[r[x] for x in names] for r in rows], np.int64).reshape(-1, PROFILE)[by], np.array([r.below for r in rows], np.float64)[by]

    def table_of(self, n: int) -> DataFrame:
        """context, gram, count, p: the n-grams that were seen, with P (gram is the short of the last word), and a row with
        no gram for each context's alpha in p. For n = 1 the words. Contexts of several buckets have a row in each."""
        shared = self._shared()
        rows = self.parts[n].where("kind = 1").select("a", "b", "c", "d", "e")
        return rows.mapInArrow(_table(shared, n), "context long, gram long, count long, p double")


def _count_texts(batches):
    for batch in batches:
        yield pa.record_batch([pa.array([int((np.frombuffer(x, "u1") & 2 == 0).sum()) for x in batch.column("flags").to_pylist()], pa.int64())], ["n"])


def _table(shared, n: int):
    names = ["context", "gram", "count", "p"]

    def run(batches):
        m = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                if n == 1:
                    w, c = np.frombuffer(r["a"], "<i8"), _un(r["b"]).astype(np.int64)
                    yield pa.record_batch([pa.nulls(len(w), pa.int64()), pa.array(w), pa.array(c), pa.array(m.kept(c, 1) / m.total)], names)
                    continue
                heads, sizes, grams, c, below = np.frombuffer(r["a"], np.uint64), _un(r["b"]).reshape(2 + PROFILE, -1).astype(np.int64), _unsix(r["c"]).view(np.int64), _un(r["d"]).astype(np.int64), _un(r["e"], "<f8")
                profile, keys = sizes[2:].T.copy(), m.split[n][0]
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, heads), len(keys) - 1)
                    hit = keys[at] == heads
                    below = np.where(hit, m.split[n][2][at], below)
                    profile[hit] = m.split[n][1][at[hit]]
                by, alpha = m.weights(sizes[1], profile, below, n)
                own = np.repeat(np.arange(len(heads)), sizes[0])
                signed = heads.view(np.int64)
                yield pa.record_batch([pa.array(signed[own]), pa.array(grams), pa.array(c), pa.array(m.kept(c, n) / by[own])], names)
                yield pa.record_batch([pa.array(signed), pa.nulls(len(heads), pa.int64()), pa.array(sizes[1]), pa.array(alpha)], names)

    return run


def score(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents, learning from those that
    aren't held out."""
    t = Trained(spark, docs, order)
    out = t._cogroup(_score(t._shared()), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(t.model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score(spark, docs)
