"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def decontam(docs, items):
    """docs: (doc_id, text) pairs, items: (item_id, text) pairs."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    wins = defaultdict(set)
    for item, text in items:
        w = split(text)
        if w:
            m = min(10, len(w))
            for i in range(len(w) - m + 1):
                wins[tuple(w[i : i + m])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for m in range(1, 11):
            for i in range(len(w) - m + 1):
                if (g := tuple(w[i : i + m])) in wins:
                    hit.update(range(i, i + m))
                    found |= wins[g]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def quality(docs):
    """The base figures of (doc_id, text) pairs."""
    out = []
    for doc, text in docs:
        text = text or ""
        w = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        out.append((doc, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    return out


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs):
    """(doc_id, n_shingles, component_id)"""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    u, v = sorted((find(a), find(b)))
                    root[v] = u
    return [(d, len(sets[d]), find(d)) for d in ids]


def crc(ids) -> int:
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def rans(docs):
    out, start = [], 0
    for (doc, _), ids in zip(sorted(docs), token_ids([t for _, t in sorted(docs)])):
        out.append((doc, start, len(ids) + 1, crc(ids + [2])))
        start += len(ids) + 1
    return out


def check_packing(docs, pieces, room=2048):
    """pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). Returns the number of sequences and of ids."""
    ids = {d: x + [1] for (d, _), x in zip(docs, token_ids([t for _, t in docs]))}
    at, seq = defaultdict(list), defaultdict(list)
    for d, start, n, c, total, s, off in pieces:
        assert n > 0 and total == len(ids[d]) and c == crc(ids[d][start : start + n])
        at[d].append((start, n))
        seq[s].append((off, n))
    for d in ids:
        end = 0
        for start, n in sorted(at[d]):
            assert start == end
            end += n
        assert end == len(ids[d])
    for x in seq.values():
        end = 0
        for off, n in sorted(x):
            assert off == end
            end += n
        assert end <= room
    return len(seq), sum(map(len, ids.values()))


def secrets(docs):
    """doc_id, n_assign, n_access, n_hex, base_sha256"""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = []
    for doc, text in docs:
        text = text or ""
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        n = Counter(x[2] for x in found)
        out.append((doc, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)))))
    return out


def held(doc, remainder):
    return zlib.crc32(str(doc).encode()) % 5 == remainder


def turing(counts, gt=5):
    """Good-Turing discounts with Katz's correction, from the counts themselves."""
    of = Counter(counts)
    out = {0: 0.0}
    for r in range(1, gt + 1):
        try:
            k = (gt + 1) * of[gt + 1] / of[1]
            d = ((r + 1) * of[r + 1] / of[r] / r - k) / (1 - k) if k < 1 else 0
        except ZeroDivisionError:
            d = 0
        out[r] = d if 0 < d < 1 else 1 - 1 / (2 * r)
    return out


def katz(docs, order=2, gt=5):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; and the sums of P(. | h) over all words for
    some contexts h of each length."""
    import math

    split = {i: SPACED.findall((t or "").translate(LOWER)) for i, (_, t) in enumerate(docs)}
    counts = [None] + [Counter() for _ in range(order)]
    padded = {i: ["<s>"] * (order - 1) + w + ["</s>"] for i, w in split.items()}
    for i, (d, _) in enumerate(docs):
        if not held(d, 1):
            t = padded[i]
            for n in range(1, order + 1):
                counts[n].update(tuple(t[k - n + 1 : k + 1]) for k in range(order - 1, len(t)))
    d = [None] + [turing(c.values(), gt) for c in counts[1:]]
    kept = lambda c, n: float(c) if c > gt else c * d[n][c]
    uni = Counter({w: c for (w,), c in counts[1].items()})
    n_all, types = sum(uni.values()), len(uni)
    mass = sum(kept(c, 1) for c in uni.values())
    total = n_all if n_all - mass > 1e-9 * n_all else n_all + 1
    unknown = 1 - mass / total
    follow = [None, None] + [{} for _ in range(2, order + 1)]
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            follow[n].setdefault(g[:-1], {})[g[-1]] = c
    weights = {}

    def prob(h, w):
        if not h:
            return kept(uni[w], 1) / total if w in uni else unknown
        seen = follow[len(h) + 1].get(h)
        if seen is None:
            return prob(h[1:], w)
        if h not in weights:
            c, q = sum(seen.values()), sum(kept(x, len(h) + 1) for x in seen.values())
            by = c + 1 if q >= c * (1 - 1e-9) else c
            weights[h] = by, (by - q) / by / (1 - sum(prob(h[1:], x) for x in seen))
        by, alpha = weights[h]
        return kept(seen[w], len(h) + 1) / by if w in seen else alpha * prob(h[1:], w)

    out = []
    for i, (doc, _) in enumerate(docs):
        t = padded[i]
        own = t[order - 1 :]
        base = sum(math.log10((uni[x] + 0.5) / (n_all + 0.5 * (types + 1))) for x in own)
        s = sum(math.log10(prob(tuple(t[k - order + 1 : k]), t[k])) for k in range(order - 1, len(t)))
        out.append((doc, held(doc, 1), len(own), sum(uni[x] > 0 for x in own), n_all, base, s))
    some = [h for n in range(2, order + 1) for h in sorted(follow[n], key=lambda h: -len(follow[n][h]))[:3] + list(follow[n])[:3]]
    return out, [sum(prob(h, w) for w in [*uni, None]) for h in some]


def repeats(docs, size=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256"""
    least = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if least.get(w, d) >= d:
                least[w] = d
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if least[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def kept(docs, share=0.02, many=20, left_words=20, left_share=0.25):
    """(doc_id, words in lines that too many distinct texts of a host have, kept) of (doc_id, text, host) rows."""
    low = lambda x: re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    lines = lambda t: [y for x in (t or "").split("\n") if (y := low(x))]
    texts = defaultdict(set)
    for _, t, host in docs:
        texts[host].add(t)
    common = {host: {x for x, n in Counter(x for t in own for x in set(lines(t))).items() if n > many and n > share * len(own)} for host, own in texts.items()}
    out = []
    for doc, t, host in docs:
        n = len(SPACED.findall(t or ""))
        gone = sum(len(x.split(" ")) for x in lines(t) if x in common[host])
        failed = quality([(doc, t)])[0][6]
        out.append((doc, gone, not failed and not (gone and (n - gone < left_words or n - gone < left_share * n))))
    return out
