"""Near duplicates: the documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

1. One pass takes each text's shingle set as 64-bit hashes, and keeps its size, a 128-bit key of the whole set, and a
   sketch of how often shingles occur. Equal sets are one class, stood for by its smallest id.
2. Adaptive multi-match prefixes: shingles are ordered by frequency. A prefix that is l - 1 longer than the plain one must
   share l shingles; each document takes the l of least estimated cost, from the frequencies of its own prefix. What
   shares a prefix shingle with another class is kept: every candidate comes from there.
3. Candidates are first those pairs of which one leads a shingle: the most central of the classes that have it in their
   prefixes. That is a star for each shingle, never all pairs of a group. They are struck by size, place of the
   shared shingles, number of matches and a bound on the difference of the sets; what is left is verified, and connected.
4. Then the join over all else: pairs that share enough prefix shingles and that step 3 has not connected. Components of
   all verified links.

Cases: null and empty texts have size 0 and link with nothing. A null doc_id takes the id of a document with an equal
set, or null. Rows that repeat a doc_id are one document, linked through any of its texts. A very long text is one row of a
task, its shingles in memory. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, small
from tessera.llm.components import components
from tessera.llm.kernel import mix, spans, texts, trimmed, word_hashes

SIZE, NUM, DEN = 5, 80, 100
MATCHES, SKETCH_BITS, VERIFY_COST = 4, 20, 20
HOT = 1 << 10
_A = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = spans(data, off)
    w = word_hashes(data, starts, ends)
    full = np.zeros(0, np.uint64)
    if len(w) >= SIZE:
        full = w[: len(w) - SIZE + 1].copy()
        for k in range(1, SIZE):
            full = full * _A + w[k : len(w) - SIZE + 1 + k]
        full = mix(full)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= SIZE:
            out.append(np.unique(full[i : j - SIZE + 1]))
        elif j > i:
            h = np.uint64(j - i)
            for x in w[i:j]:
                h = h * _A + x
            out.append(mix(np.array([h], np.uint64) ^ np.uint64(0x5BF03635)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _key(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).astype(np.int64)), int(mix(s + np.uint64(77)).sum(dtype=np.uint64).astype(np.int64))


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "k1", "k2", "sketch"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j, data, off in texts(batch):
                sets = shingle_sets(data, off)
                at = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
                counts += np.bincount(at.astype(np.int64), minlength=len(counts)).astype(np.uint32)
                keys = [_key(s) for s in sets]
                yield pa.record_batch([batch.column("doc_id")[i:j].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.nulls(j - i, types[4])], names)
    if counts.any():
        yield pa.record_batch([pa.nulls(1, t) for t in types[:4]] + [pa.array([zlib.compress(counts.tobytes(), 1)], types[4])], names)


def _summed(pdf):
    import pandas as pd

    total = np.zeros(1 << SKETCH_BITS, np.uint64)
    for x in pdf["sketch"]:
        total += np.frombuffer(zlib.decompress(x), np.uint32)
    return pd.DataFrame({"sketch": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})


def _sketch(rows: DataFrame) -> np.ndarray:
    """The tasks' sketches, added up a few hundred at a time; one array of fixed size."""
    n = rows.count()
    while n > 1:
        groups = max(1, n // 256)
        rows = rows.select("sketch", (F.abs(F.xxhash64("sketch")) % groups).alias("g")).groupBy("g").applyInPandas(_summed, "sketch binary")
        n = rows.count() if groups > 1 else 1
    got = rows.first()
    return np.frombuffer(zlib.decompress(got.sketch), np.uint32) if got else np.zeros(1 << SKETCH_BITS, np.uint32)


def prefix(s: np.ndarray, sketch: np.ndarray, floor: int) -> tuple[np.ndarray, int]:
    """The longest prefix that any partner may ask for, rarest first, and how many matches this document asks for."""
    n = len(s)
    count = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    order = np.argsort((count << np.uint64(32)) | (s >> np.uint64(32)), kind="stable")
    need = -(-NUM * n // DEN)
    plain = n - need + 1
    most = min(n, plain + MATCHES - 1)
    busy = np.cumsum(np.maximum(count[order[:most]].astype(np.int64) - floor, 0))
    cost = [plain + k + busy[plain + k - 1] * (1 + VERIFY_COST / (k + 1)) for k in range(min(MATCHES, need, most - plain + 1))]
    return s[order[:most]], 1 + int(np.argmin(cost))


def parity(s: np.ndarray) -> tuple[int, int]:
    """For each of 128 bins whether the set has an odd number of shingles there. Where two sets' bins differ, they
    differ by a shingle at least."""
    odd = np.packbits((np.bincount((s >> np.uint64(8)).astype(np.int64) & 127, minlength=128) & 1).astype(np.uint8))
    return tuple(odd.view(np.int64).tolist())


def _prefixes(sketch):
    def run(batches):
        counts = sketch.value
        floor = int(np.median(counts))
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
                for i, j, data, off in texts(batch):
                    rows = []
                    for doc, s in zip(ids[i:j], shingle_sets(data, off)):
                        if doc is None or not len(s):
                            continue
                        p, l = prefix(s, counts, floor)
                        rows.append((doc, len(s), l, p.view(np.int64), *parity(s)))
                    if rows:
                        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64())], ["doc_id", "n", "l", "prefix", "p", "q"])

    return run


def _verify(batches):
    with np.errstate(over="ignore"):
        for batch in batches:
            # By text, as the rows of a repeated doc_id can have different ones.
            sets, at = {}, {}
            for side in "ab":
                coded = batch.column("t" + side).dictionary_encode()
                at[side] = coded.indices.to_pylist()
                for i, j, data, off in texts(pa.record_batch([coded.dictionary], ["text"]), "text"):
                    sets |= {(side, i + k): s for k, s in enumerate(shingle_sets(data, off))}
            good, none = [], np.zeros(0, np.uint64)
            for a, b in zip(at["a"], at["b"]):
                x, y = sets.get(("a", a), none), sets.get(("b", b), none)
                n = len(np.intersect1d(x, y, assume_unique=True))
                good.append(n > 0 and DEN * n >= NUM * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(scratch: Scratch, docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids that link."""
    pairs = scratch.write(pairs, f"{name}-pairs")
    need = scratch.write(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"{name}-need")
    t = scratch.write(docs.select(F.col("doc_id").alias("id"), "text").join(small(need), "id", "left_semi"), f"{name}-texts")
    both = pairs.join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    out = scratch.write(both.mapInArrow(trimmed(_verify), "a long, b long").distinct(), f"{name}-links")
    scratch.drop(f"{name}-texts")
    return out


def _near() -> Column:
    """Whether a shared prefix shingle counts for a pair, a being the larger: sizes and parities leave room for a link, and
    it stands in the prefixes that the l of the larger asks for."""
    need, l = F.expr(f"({NUM} * (na + nb) + {NUM + DEN - 1}) div {NUM + DEN}"), F.col("la")  # noqa: E741
    apart = sum(F.bit_count(F.col(x + "a").bitwiseXOR(F.col(x + "b"))) for x in "pq")
    return (DEN * F.col("nb") >= NUM * F.col("na")) & (F.col("ia") < F.col("na") - need + l) & (F.col("ib") < F.col("nb") - need + l) & (apart <= F.col("na") + F.col("nb") - 2 * need)


def _enough(pairs: DataFrame) -> DataFrame:
    """a and b, of rows for each shingle that counts for a pair: those with as many as l."""
    return pairs.groupBy("a", "b", "la").agg(F.count("*").alias("c")).where("c >= la").select("a", "b").distinct()


_SIDE = ("n", "l", "i", "p", "q")


def stars(shared: DataFrame) -> DataFrame:
    """a and b: candidates of which one leads a shingle. The leader is the most central class that has it in its prefix, the
    one whose prefix shingles most others have: of copies with edits of their own, that is what they were copied from.
    A shingle of over HOT classes is dealt to parts of about HOT, so that no task meets all of them."""
    central = shared.groupBy("rep").agg(F.sum("c").alias("central"))
    lead = shared.join(central, "rep").groupBy("token").agg(F.max(F.struct("central", (-F.col("rep")).alias("a"), *_SIDE)).alias("x"), F.max("c").alias("c"))
    lead = lead.select("token", F.explode(F.expr(f"sequence(0L, c div {HOT})")).alias("part"), (-F.col("x.a")).alias("lead"), *[F.col(f"x.{x}").alias(f"{x}0") for x in _SIDE])
    met = shared.withColumn("part", F.expr(f"pmod(xxhash64(rep), c div {HOT} + 1)")).join(lead, ["token", "part"]).where("lead <> rep")
    first = (F.col("n") > F.col("n0")) | ((F.col("n") == F.col("n0")) & (F.col("rep") > F.col("lead")))
    side = lambda x, y, by: [F.when(first, F.col(x)).otherwise(F.col(y)).alias(by + "a"), F.when(first, F.col(y)).otherwise(F.col(x)).alias(by + "b")]
    return _enough(met.select(*side("rep", "lead", ""), *[c for x in _SIDE for c in side(x, x + "0", x)]).where(_near()))


def others(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """a and b: all candidates whose roots differ."""
    post = shared.join(nodes, shared.rep == nodes.doc_id).select("token", "rep", "root", *_SIDE)
    a, b = (post.select("token", F.col("rep").alias(x), *[F.col(c).alias(c + x) for c in ("root", *_SIDE)]) for x in "ab")
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    return _enough(a.join(b, (a.token == b.token) & (F.col("roota") != F.col("rootb")) & larger & _near()))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, a row per document."""
    scratch = Scratch(spark, "jaccard")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    outline = scratch.write(d.mapInArrow(trimmed(_outline), "doc_id long, n long, k1 long, k2 long, sketch binary"), "outline")
    sketch = spark.sparkContext.broadcast(_sketch(outline.where("sketch is not null").select("sketch")))
    rows = outline.where("sketch is null").select("doc_id", "n", "k1", "k2")
    classes = scratch.write(outline.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    found = d.mapInArrow(trimmed(_prefixes(sketch)), "doc_id long, n long, l long, prefix array<long>, p long, q long")
    index = scratch.write(found.join(reps, "doc_id", "left_semi"), "index")
    post = index.select(F.col("doc_id").alias("rep"), "n", "l", "p", "q", F.posexplode("prefix").alias("i", "token"))
    sizes = post.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = scratch.write(post.join(sizes, "token"), "shared")

    links = verified(scratch, d, stars(shared), "stars")
    joined = components(spark, links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = reps.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))
    rest = verified(scratch, d, others(shared, scratch.write(nodes, "nodes")), "rest")
    for name in ("index", "shared"):
        scratch.drop(name)

    edges = joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest.select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = components(spark, edges)
    of_class = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or root is not null").select("k1", "k2", "n", F.coalesce("root", "rep").alias("root"))
    of_class = small(scratch.write(of_class, "of-class"))
    return rows.join(of_class, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component, with their columns as they were; one row where a doc_id
    repeats. Documents without a doc_id stay, equal texts of theirs once."""
    found = near_duplicates(spark, docs).where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    found = Scratch(spark, "kept").write(found, "kept")
    out = docs.join(small(found.where("rows = 1").select("doc_id")), "doc_id", "left_semi")
    if found.where("rows > 1").limit(1).count():
        out = out.unionByName(docs.join(small(found.where("rows > 1").select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    if docs.where("doc_id is null").limit(1).count():
        out = out.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
    return out.select(*docs.columns)


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(spark, docs)
