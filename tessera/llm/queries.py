"""The queries of this subpackage: name to function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.chat import op7
from tessera.llm.classifier import op5
from tessera.llm.common import table
from tessera.llm.decontam import op1
from tessera.llm.importance import op12
from tessera.llm.jaccard import op2
from tessera.llm.katz import op3
from tessera.llm.packing import op8
from tessera.llm.pii import op11
from tessera.llm.quality_rules import FIGURES, op9
from tessera.llm.rans import op10
from tessera.llm.runs import op13
from tessera.llm.secrets import op6
from tessera.llm.suffix_dedup import op4


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_decontamination": lambda s, d: op1(s, docs(s, d), table(s, d, "benchmark")),
        "op2_ngram_jaccard": lambda s, d: op2(s, docs(s, d)),
        "op3_katz_backoff": lambda s, d: op3(s, docs(s, d)),
        "op4_suffix_dedup": lambda s, d: op4(s, docs(s, d)),
        "op5_quality_classifier": lambda s, d: op5(s, docs(s, d), table(s, d, "labels")),
        "op6_secret_scan": lambda s, d: op6(docs(s, d)),
        "op7_chat_formatting": lambda s, d: op7(table(s, d, "conversations")),
        "op8_packing": lambda s, d: op8(docs(s, d)),
        "op9_quality_rules": lambda s, d: op9(s, docs(s, d)),
        "op10_rans_ids": lambda s, d: op10(s, docs(s, d)),
        "op11_pii": lambda s, d: op11(docs(s, d)),
        "op12_importance": lambda s, d: op12(s, docs(s, d), table(s, d, "benchmark")),
        "op13_periodic_runs": lambda s, d: op13(docs(s, d)),
        "pipeline": corpus_pipeline.run,
        # What SQL can tell of op6, op9 and op11: their figures without the method's own spans and verdicts.
        "base_secret_counts": lambda s, d: op6(docs(s, d)).select("doc_id", "n_assign", "n_access", "n_hex"),
        "base_quality_figures": lambda s, d: op9(s, docs(s, d)).select("doc_id", *FIGURES),
        "base_pii_counts": lambda s, d: op11(docs(s, d)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone"),
    }


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT m FROM wins),
grams AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lengths WHERE len(w) >= m)),
hits AS (SELECT DISTINCT doc_id, m, i, item FROM grams JOIN wins USING (m, win)),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)"""

OP2 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END, ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach AS (SELECT a AS doc_id, b AS to_id FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.to_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(to_id) AS m FROM reach GROUP BY doc_id) r USING (doc_id)"""


OP4 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i + 1:i + 50] AS s FROM (SELECT *, unnest(range(0, octet_length(b) - 49)) AS i FROM d WHERE octet_length(b) >= 50)),
smallest AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM w JOIN smallest USING (s) WHERE m < doc_id),
spans AS (SELECT doc_id, min(j) AS a, max(j) + 1 AS e FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS g FROM gone) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
kept AS (SELECT doc_id, sum(e - a) AS n, count(*) AS k, string_agg(hex(b[p + 1:a]), '' ORDER BY a) || hex(any_value(b)[max(e) + 1:]) AS h FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, coalesce(k.k, 0) AS n_spans, sha256(CASE WHEN k.h IS NULL THEN d.b ELSE unhex(k.h) END) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

BASE_SECRETS = f"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

BASE_QUALITY = r"""
WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN repeats USING (doc_id)"""


# crc32 of a text's bytes, by its table.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))) AS tab"


def _crc(x: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda y: CAST('0x' || y AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295)"


BASE_PII = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
CAST(len(list_filter(card, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[-i] AS INT) ELSE (2 * CAST(x[-i] AS INT)) // 10 + (2 * CAST(x[-i] AS INT)) % 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
CAST(len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM found"""

OP12 = f"""
WITH crc AS ({_CRC_TABLE}),
texts AS (SELECT 0 AS target, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, item_id, {_WORDS} FROM benchmark),
grams AS (SELECT target, id, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT target, id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM texts, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)),
counted AS (SELECT target, id, g, count(*) AS c FROM grams GROUP BY ALL),
hashed AS (SELECT g, {_crc("g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM counted), crc),
sums AS (SELECT bucket, coalesce(sum(c) FILTER (target = 0), 0) AS s, coalesce(sum(c) FILTER (target = 1), 0) AS t FROM counted JOIN hashed USING (g) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS gain FROM sums),
weights AS (SELECT id AS doc_id, CAST(sum(c) AS BIGINT) AS f, CAST(sum(c * gain) AS BIGINT) AS weight FROM counted JOIN hashed USING (g) JOIN gains USING (bucket) WHERE target = 0 GROUP BY id),
scored AS (SELECT doc_id, coalesce(f, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n,
coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM (SELECT id AS doc_id, w FROM texts WHERE target = 0) LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 5 // 100 AS k FROM scored WHERE n >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM scored s LEFT JOIN placed USING (doc_id)"""

# Stretches of 16 words or more that stand d words on again are those of the runs of period d.
OP13 = rf"""
WITH crc AS ({_CRC_TABLE}),
cut AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc)),
tails AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM cut),
docs AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN w[:a] || list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1]) ELSE w END AS w FROM (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM tails)),
grams AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 16], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, n - 15)) AS i FROM docs WHERE n >= 24)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i),
islands AS (SELECT doc_id, d, min(i) AS s, max(i) + 16 + d - min(i) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS k FROM pairs) GROUP BY doc_id, d, k),
runs AS (SELECT doc_id, s, len, min(d) AS q FROM islands WHERE len >= greatest(24, 3 * d) GROUP BY doc_id, s, len),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM runs GROUP BY doc_id),
best AS (SELECT r.* FROM runs r WHERE NOT EXISTS (FROM runs o WHERE o.doc_id = r.doc_id AND (o.len * r.q > r.len * o.q OR o.len * r.q = r.len * o.q AND (o.s < r.s OR o.s = r.s AND o.q < r.q)))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS txt FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, n)) AS i FROM docs) LEFT JOIN (SELECT *, true AS out FROM gone) USING (doc_id, i) WHERE out IS NULL GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli, sha256(coalesce(l.txt, '')) AS runs_sha256, sha256(coalesce(k.txt, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express. Scores, packings, files and lexing are held against plain Python in tests/llm."""
    out = {"op1_decontamination": OP1, "op2_ngram_jaccard": OP2, "op4_suffix_dedup": OP4, "op12_importance": OP12, "op13_periodic_runs": OP13, "base_secret_counts": BASE_SECRETS, "base_quality_figures": BASE_QUALITY, "base_pii_counts": BASE_PII}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
