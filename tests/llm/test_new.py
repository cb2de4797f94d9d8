"""Personal data, importance resampling and periodic runs against plain Python, on nulls, empty and long texts, ties, repeated
rows, odd columns and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import importance, pii, runs
from tessera.llm.common import Scratch

SCHEMA = "doc_id long, text string, w string, p int, bucket long, gain int, rank string, score string, _part int, of int, n_words int, size string, h int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2, 3, "a", "b", 4, 5, 6, "c", 7) for d, t in rows], SCHEMA).repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice(["th", "ER", "ou", "É", "in", "ß", "9", "-"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() + r.choice(["", "", ",", ".", "\n"]) for _ in range(n))
    out = [text(r.randint(1, 90)) for _ in range(60)] + [None, "", " \n\t", "one", "two words", text(4000), "ab " * 300, ("x y z " * 40 + "q ") * 3]
    rows = [(i, t) for i, t in enumerate(out)]
    # Copies with ids of their own, rows that repeat, one id with two texts, and rows without an id.
    return rows + [(200 + i, out[5]) for i in range(40)] + [rows[3], rows[3], rows[61], (7, out[9]), (None, out[4]), (None, out[4]), (None, None), (12345678901234, out[8])]


def brute_resample(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(grams(cut(x)))
    for x in items:
        t.update(grams(cut(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(big_s + 10000) / (float(s[b] + 1) * float(big_t + 10000))))
    out = []
    for d, x in rows:
        w = cut(x)
        g = grams(w)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, g))
        out.append([d, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    placed = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(placed[: 5 * len(placed) // 100]):
        x[5] = k + 1
    return sorted((tuple(x) for x in out), key=repr)


def test_resample(spark):
    rows, items = corpus(), ["thou inth", None, "", "ER É9 ou ßin th"]
    target = spark.createDataFrame([(i, x, 1) for i, x in enumerate(items)], "item_id int, text string, bucket int")
    got = sorted((tuple(r) for r in importance.resample(spark, frame(spark, rows), target).collect()), key=repr)
    want = brute_resample(rows, items)
    assert got == want and sum(x[5] is not None for x in got) == 5 * sum(x[1] >= 20 for x in got) // 100 > 3


def test_resample_empty(spark):
    target = spark.createDataFrame([], "item_id int, text string")
    rows = corpus()
    got = sorted((tuple(r) for r in importance.resample(spark, frame(spark, rows), target).collect()), key=repr)
    assert got == brute_resample(rows, [])
    assert importance.op12(spark, frame(spark, []), target).collect() == []
    few = [(1, "a b c"), (2, None)]
    assert sorted(tuple(r) for r in importance.op12(spark, frame(spark, few), target).select("doc_id", "n_features", "rank").collect()) == [(1, 6, None), (2, 0, None)]


def test_ranks(spark):
    """Ranks over many partitions, with ties, are those of one sort."""
    r = random.Random(2)
    rows = [(i, r.randrange(40)) for i in range(3000)]
    scratch = Scratch(spark, "test")
    df = scratch.write(spark.createDataFrame(rows, "doc_id long, score long").repartition(5), "rows")
    got = [(x.doc_id, x.score) for x in importance.ranked(spark, df, scratch).orderBy("rank").collect()]
    assert got == sorted(rows, key=lambda x: (-x[1], x[0]))
    assert [x["rank"] for x in importance.ranked(spark, df, scratch).orderBy("rank").collect()] == list(range(1, 3001))


def test_resample_plan(spark):
    """No Python, no cross join; the gain table is broadcast and only sums are exchanged."""
    rows = corpus()
    gain = spark.range(10000).selectExpr("cast(id as int) as bucket", "id as gain")
    plan = importance.weights(frame(spark, rows), gain)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Cartesian|NestedLoop", plan) and plan.count("hashpartitioning") == 1


def brute_runs(s):
    n, found = len(s), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(runs.MIN_WORDS, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, j - i, q) for (i, j), q in found.items())


@st.composite
def repetitive(draw):
    s = []
    for _ in range(draw(st.integers(1, 9))):
        if s and draw(st.booleans()):
            a = draw(st.integers(0, len(s) - 1))
            s += s[a : a + draw(st.integers(1, 25))] * draw(st.integers(1, 7))
        else:
            s += draw(st.lists(st.integers(0, 3), min_size=1, max_size=10))
    return s[:600]


@settings(max_examples=300, deadline=None)
@given(repetitive())
def test_runs(s):
    assert [(i, j - i, q) for i, j, q in runs.runs(s)] == brute_runs(s)
    with np.errstate(over="ignore"):
        assert runs.find_runs(np.array(s, np.uint64)) == sorted(brute_runs(s), key=lambda r: (r[0], r[2]))


@settings(max_examples=200, deadline=None)
@given(repetitive())
def test_short_runs(s):
    """The method itself has no least length: with 6 words it finds all cubes, copied ones too."""
    before, runs.MIN_WORDS = runs.MIN_WORDS, 6
    try:
        assert [(i, j - i, q) for i, j, q in runs.runs(s)] == brute_runs(s)
    finally:
        runs.MIN_WORDS = before


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_factors(s):
    """Each factor is the longest stretch that begins before, too, or a new word."""
    at = 0
    for b, e, source in runs.factors(s):
        assert b == at
        at = e
        longest = max((k for k in range(1, len(s) - b + 1) if any(s[i : i + k] == s[b : b + k] for i in range(b))), default=0)
        assert e - b == max(1, longest) and (source == -1 if not longest else source < b and s[source : source + longest] == s[b:e])
    assert at == len(s)


def brute_op13(rows):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        out.append((d, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


def test_periodic_runs(spark):
    rows = corpus() + [(1000 + i, " ".join(f"v{(i * 7 + k) % 31}" for k in range(20 * i))) for i in range(30)] + [(2000, "Ab ab " * 30), (2001, "é\x0bß\x1c " * 40), (2002, "tail " * 100_000)]
    got = sorted((tuple(r) for r in runs.op13(frame(spark, rows)).collect()), key=repr)
    long = [x for x in got if x[0] == 2002]
    assert long == [(2002, 1, 0, 100_000, 1, 100_000_000, sha("0,100000,1\n"), sha("tail"))]
    assert [x for x in got if x[0] != 2002] == brute_op13(rows[:-1])
    assert sum(x[1] > 0 for x in got) > 20
    assert runs.op13(frame(spark, [])).collect() == []


def test_collapse(spark):
    rows = [(1, "a b\n" * 20 + "c"), (2, " x " * 30), (3, "plain text"), (4, None), (5, "")]
    df = frame(spark, rows)
    out = runs.collapse_runs(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: "a b\nc", 2: " x  ", 3: "plain text", 4: None, 5: ""}


def test_runs_are_linear():
    r = random.Random(1)
    for s in ([0] * 100_000, [0, 1] * 50_000, [r.randrange(50) for _ in range(30_000)] * 3, [r.randrange(2) for _ in range(50_000)]):
        began = time.time()
        runs.runs(s)
        assert time.time() - began < 15


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
}


def brute_pii(t):
    out = [(k, *m.span()) for k, (p, ok) in BASE.items() for m in re.finditer(p, t or "") if ok(m[0])]
    return sorted(out, key=lambda x: (x[1], list(BASE).index(x[0]), x[2]))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z", "0", "1", "25", "4", "9", "255", "256", "4111", "1111", "@", ".", "-", "+", " ", "(", ")", "_", "%", "é", "\n", "a@b.c", "+1", "1.2.3.4"]), max_size=40).map("".join))
def test_base_patterns(t):
    found = pii.scan(t)
    assert [x[:3] for x in found if not x[3]] == brute_pii(t)


DISGUISED = [
    ("email", "write to [[john.doe [at] example [dot] com]] now"), ("email", "[[john (at) example.com]]"), ("email", "([[john{AT}example{DOT}co{DOT}uk]])"), ("email", "or [[john at example dot com]]."), ("email", "see [[j.doe at example.com]] please"),
    ("email", "[[jоhn.dоe@exаmple.com]]"), ("email", "[[a​lice@exam​ple.com]]"), ("email", "[[user&#64;example&#46;org]]"), ("email", "[[john @ example . com]]"), ("email", "[[john_at_example_dot_com]]"), ("email", "[[john-at-example-dot-com]]"),
    ("email", "[[maria arroba ejemplo punto es]]"), ("email", "[[info@example dot com]]"), ("email", "\U0001f600 [[ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ]] \U0001f600"), ("email", "[[max at beispiel punkt de]]"), ("email", "[[john[@]example[.]com]]"), ("email", "[[john underscore doe dash 7 at example dot com]]"),
    ("phone", "call [[plus four four two zero seven nine four six zero nine five eight]] today"), ("phone", "[[+１ (５５５) ０１２-３４５６]]"), ("phone", "[[+1 (5O3) 555-O123]]"), ("phone", "ring [[five five five oh one two three four seven six]]"), ("phone", "[[+١٢٣ ٤٥٦ ٧٨٩]]"), ("phone", "[[five five five o one two three four seven six]]"),
    ("phone", "[[double five five, one two three, nine eight seven, triple zero]]"), ("phone", "[[+33 un deux trois quatre six six sept huit neuf]]"), ("phone", "[[+1‑202‑555‑0143]]"),
    ("card", "my card: [[four one one one one one one one one one one one one one one one]]"), ("card", "[[vier eins eins eins - eins eins eins eins - eins eins eins eins - eins eins eins eins]]"), ("card", "no. [[4111 l111 1111 1111]] 12"), ("card", "[[４111 1111 1111 1111]]"),
    ("ip", "host [[192[.]168[.]10[.]1]] up"), ("ip", "[[192 dot 168 dot 10 dot 1]]"), ("ip", "[[one nine two dot one six eight dot zero dot one]]"), ("ip", "[[192(dot)168(dot)0(dot)1]]"), ("ip", "[[１９２．168．0．1]]"),
]


@pytest.mark.parametrize("kind, text", DISGUISED)
def test_disguised(kind, text):
    """The span is that of the source, in code points, wherever characters before it were rewritten."""
    for before in ("", "​Ａ (at) one two three; so "):
        t = before + text
        a, b = t.index("[["), t.index("]]") - 2
        t = t.replace("[[", "", 1).replace("]]", "", 1) if "[[[" not in t else t
        assert (kind, a, b, True) in pii.scan(t), [(k, t[x:y]) for k, x, y, _ in pii.scan(t)]


CLEAN = [
    "look at example.com for more", "they met at noon, dot. He left.", "one two three four five six seven eight nine ten eleven", "ten nine eight seven six five four three two one", "x at und.34 and at home.", "array[at] = (dot) product", "version 1 . 2 . 3", "été – « déjà vu », 1 234 567",
    "chapter one. two. three. four.", "zero zero zero zero zero zero zero zero zero zero zero zero zero", "Саша сказал: 12", "A at B", "1O l0 0O", "one six two", "un deux trois, un deux trois", "uno o dos o tres", "see @ 5 . 30 pm",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert pii.scan(text) == []


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["ab", "о", "​", "x1", " ", "１"]), st.booleans()), max_size=12))
def test_mapping(parts):
    """Each place that is mapped back holds what it was made from."""
    source = "".join(x for x, _ in parts)
    edits, at = [], 0
    for x, gone in parts:
        if gone:
            edits.append((at, at + len(x), "" if x == "​" else "<>"))
        at += len(x)
    r = pii.Rewritten(source, edits)
    assert r.text == "".join(("" if x == "​" else "<>") if gone else x for x, gone in parts)
    for a in range(len(r.text)):
        for b in range(a + 1, len(r.text) + 1):
            x, y, changed = r.back(a, b)
            assert 0 <= x < y <= len(source)
            assert changed == ("<" in r.text[a:b] or ">" in r.text[a:b] or any(a < s < b and s == e for s, e, _, _ in r.pieces))
            if not changed:
                assert source[x:y] == r.text[a:b]


def test_pii_query(spark):
    rows = corpus() + [(300, "a@b.c +1 (202) 555-0143, 4111111111111111, 1.2.3.4 and j at d dot org"), (301, "4111-1111-1111-1111 " * 3), (301, "x" * 200_000 + "@y.zz")]
    got = {(r.doc_id, r.base_sha256): r for r in pii.op11(frame(spark, rows)).collect()}
    assert pii.op11(frame(spark, rows)).count() == len(rows)
    for d, t in rows:
        base = brute_pii(t)
        r = got[d, sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in BASE)
        assert not set(r.spans.split(",")) - {""} < {f"{k}:{a}:{b}" for k, a, b in base}
    r = next(r for (d, _), r in got.items() if d == 300)
    assert r.n_added == 1 and r.spans.endswith("email:55:69")
    assert pii.op11(frame(spark, [])).collect() == []


def test_redacted(spark):
    df = frame(spark, [(1, "mail a@b.cc or j (at) d (dot) org!"), (2, None), (3, "")])
    out = pii.redact_pii(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: "mail [EMAIL] or [EMAIL]!", 2: None, 3: ""}


def test_pii_is_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a dot " * 50_000, "a at " * 60_000, "one " * 80_000, "+1" * 150_000, "a@" * 150_000, "@" * 300_000, "(at)" * 80_000, "1 " * 150_000, "O0" * 150_000, "a at b dot c " * 25_000, "(  " * 100_000, "one. " * 60_000, "double " * 50_000, "&#0" * 100_000, "a_at_b_dot_" * 30_000, "+" + "." * 300_000, "plus " * 60_000, "​" * 200_000, "1 dot " * 60_000, "@ " * 150_000, "12-" * 100_000):
        began = time.time()
        pii.scan(t)
        assert time.time() - began < 6, t[:20]
