"""Cases that lie beyond bounds which operators once had."""

import hashlib
import os
import random
import sys

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tessera.llm import chat, classifier, jaccard, packing, quality_rules, rans, secrets, suffix_dedup  # noqa: E402


def test_template_of_many_lines(spark):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    shared = "\n".join(words(f"t{chr(97 + k)}", 6) for k in range(20))
    letters = lambda i: chr(97 + i // 26) + chr(97 + i % 26)  # noqa: E731  (digits count as equal)
    own = lambda i: "\n".join(f"own{letters(i)} line{letters(k)}" for k in range(5))
    rows = [(i, f"{own(i)}\n{shared}", "s") for i in range(60)]  # 120 words of 130 are the template's
    rows += [(100 + i, f"{words('copy', 30)}\n{words('other', 30)}", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_line_words, r.kept) for r in quality_rules.op9(spark, df).collect()}
    assert all(got[i] == (120, False) for i in range(60)) and all(got[i] == (0, True) for i in range(100, 160))


def test_place_asks_every_sequence():
    """Each piece goes where a look at all sequences sends it, and is cut only where none has room."""
    r, cuts = random.Random(1), 0
    for n, middle in ((3000, 5), (400, 6.5), (1, 5)):
        lengths = [min(2047, max(1, round(r.lognormvariate(middle, 1)))) for _ in range(n)]
        k = -(-sum(lengths) // 2048)
        used, cost = [0] * k, [0.0] * k
        for i, start, m, s, off in packing.place(lengths):
            left = lengths[i] - start
            with_room = [(cost[x], x) for x in range(k) if used[x] + left <= 2048]
            if with_room:
                assert (m, s) == (left, min(with_room)[1])
            else:
                assert used[s] == min(used) and m == 2048 - used[s]
                cuts += 1
            assert off == used[s]
            used[s], cost[s] = used[s] + m, cost[s] + m + packing.QUADRATIC * m * m
    assert cuts


def test_long_runs(spark):
    """Stretches of over 65,535 equal bytes that two documents share, as whole runs and with different ends."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    r = random.Random(4)
    own = ["".join(r.choice("bcdefghij klmnop") for _ in range(300)) for _ in range(5)]
    long, more = "a" * 100_000, "-=" * 40_000
    rows = [(1, long), (2, own[0] + long), (3, own[1] + more + own[2]), (4, own[3] + more + own[4]), (5, own[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.op4(spark, df).collect()}
    want = {1: (0, 0, sha(long)), 2: (100_000, 1, sha(own[0])), 3: (0, 0, sha(rows[2][1])), 4: (80_000, 1, sha(own[3] + own[4])), 5: (300, 1, sha(""))}
    assert got == want


def test_runs_of_any_length(spark):
    """70,000 and 200,000 equal bytes, blanks, and a period of 4, against brute force over two documents."""
    for unit, n in (("a", 70_000), ("a", 200_000), (" ", 70_000), ("abcd", 20_000)):
        rows = [(1, unit * n), (2, "b " + unit * n)]
        got = {x.doc_id: (x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.op4(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = {d: tuple(x) for d, _, *x in brute.repeats(rows)}
        assert got == want and want[2][0] >= len(unit) * n


def test_long_transcripts(spark):
    """Transcripts of many blocks and chunks, by number and by lines, are those of one pass over all their rows."""
    r = random.Random(6)
    says = ["hello?", "Sure, here is it", "- a\n- b", "what is this\nplease", "You are a helper", "fine", "Assistant: done", "x\ny\nz"]
    rows = [(1, t, None, r.choice(says)) for t in range(1500)]
    rows += [(2, t, None, "it goes on\nand on " + str(t)) for t in range(1100)]  # one turn throughout
    rows += [(None, None, r.choice([None, "user", "bot"]), f"{i}\n" * 30) for i in range(600)]
    rows += [(4, t, None, r.choice(says)) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted(((x.conv_id, x.turn, x.role, x.n_lines, x.rendered) for x in chat.format_chats(df).collect()), key=repr)
    want = []
    for c in (1, 2, None, 4):
        mine = sorted({x[1:] for x in rows if x[0] == c}, key=lambda x: [(v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x])
        want += [(c, *x) for x in chat.turns(mine)]
    assert got == sorted(want, key=repr)


def test_secrets_of_any_length_and_form():
    r = random.Random(8)
    value = "".join(r.choice("abcXYZ0189+/") for _ in range(5000))
    short = "Zk93+xQp77/aa"
    forms = [f'private_key = "{value}"', f"private_key={value}", f"<passphrase>{value}</passphrase>", f"set private_key {value}", f"auth\t=\t'{short}'", f"access_key\t:\t{short}", f'db_pwd: str = "{short}"', f"db_pwd: Optional[str] = '{short}'", f'db_pwd: &str = "{short}"', f"set db_pwd {short}", f"set -x db_pwd '{short}'", f'settings: passphrase = "{short}"', f"set the passphrase = {short}"]
    for text in forms:
        hidden = value if value in text else short
        a = text.index(hidden)
        assert ("literal", a, a + len(hidden)) in secrets.scan(text), text[:60]
        assert hidden[-8:] not in secrets.redacted(text)
    assert secrets.scan("set the table, set passphrase to something; db_pwd: str = None") == []


def test_verify_reads_each_rows_texts():
    """Rows of a doc_id that repeats with different texts are compared by their own, in any order."""
    one, two = (" ".join(f"{x}{i}" for i in range(30)) for x in "vw")
    for ta, tb in (([one, two, None], [two, two, two]), ([two, two], [one, two])):
        batch = pa.record_batch([pa.array([1] * len(ta), pa.int64()), pa.array([2] * len(ta), pa.int64()), pa.array(ta), pa.array(tb)], ["a", "b", "ta", "tb"])
        assert [len(x) for x in jaccard._verify([batch])] == [1]


VALUE = "Zk93+xQp77/aa"


@pytest.mark.parametrize(
    "text",
    [
        f"set db_password {VALUE}", f"run --db-pw {VALUE} --verbose", f"run --db-pw={VALUE}", f'pw\t=\t"{VALUE}"', f'pw =\n    "{VALUE}"', f"db:\n  pw: |\n    {VALUE}\n  host: x", f"pw: >-\n  {VALUE}\nx: 1", f"pw:\n  {VALUE}\n", f'pw = """{VALUE}"""', f"pw = f'{VALUE}'",
        f'cfg["db_pw"] = "{VALUE}"', f'{{"db_pw": "{VALUE}"}}', f'const char *db_pw = "{VALUE}";', f'var dbPw string = "{VALUE}"', f'String dbPw = "{VALUE}";', f"db_pwd: Optional[str] = '{VALUE}'", f'pw => "{VALUE}"', f"pw := `{VALUE}`", f'pw = Secret("{VALUE}")', f"<apiPw>{VALUE}</apiPw>",
        f"export DB_PW={VALUE}", f"[db]\ndb_pw={VALUE}\nhost = x", f'pw = k\nk = "{VALUE}"', f'k = "{VALUE}"\nj = k\nauth_pw = j', f'auth_pw = j\nj = k\nk = "{VALUE}"', f'pw = /* here */ "{VALUE}"',
    ],
)
def test_syntaxes(text):
    """The value, and nothing else, of each syntax of source, shell, YAML and INI files that the docstring names."""
    assert [text[a:b] for a, b in secrets.literals(text)] == [VALUE]


def test_joined_values():
    """Each part of a joined value is a span; names within it stand for what they are given."""
    parts = lambda t: [t[a:b] for a, b in secrets.literals(t)]
    for text in ('pw = "Zk93+xQ" + "p77/aa"', 'pw = ("Zk93+xQ"\n      "p77/aa")', '$db_pw = "Zk93+xQ" . "p77/aa";', "pw = 'Zk93+xQ' \\\n 'p77/aa'", 'pw = a + "p77/aa"\na = "Zk93+xQ"'):
        assert set(parts(text)) >= {"p77/aa"} and "p77/aa" not in secrets.redacted(text), text
    for text in ("don't say the key: it isn't nice, can't tell", "password = get_password()", 'label_key = "plain words"', "The key = a concept of great importance", "a = b\nb = a\npw = a", "key: value\nother:\n  - x", 'pw = "', "pw = '''", '"""', "=" * 50_000, "pw" + "=" * 50_000):
        assert parts(text) == [], text[:50]


@pytest.mark.parametrize(
    "text",
    [
        f'#define PRIVATE_KEY "{VALUE}"', f'os.environ.get("DB_PASSWORD", "{VALUE}")', f"x = os.getenv('API_KEY') or '{VALUE}'", f"db_pwd = os.getenv('K') or '{VALUE}'", f"pw = x ? '{VALUE}' : 'b'", f"pw = x ? y : '{VALUE}'", f'pw = f("{VALUE}", 1)', f'pw = Secret(value="{VALUE}")', f'{{"credentials": ["{VALUE}"]}}',
        f'<add key="dbpwd" value="{VALUE}"/>', f"a0=1&password={VALUE}&b=2", f"pw = x == 1 ? '{VALUE}' : other", f"pw = '{VALUE}' if debug else None", f"- name: DB_PASSWORD\n  value: {VALUE}\n", f'{{"name": "DB_PASSWORD", "value": "{VALUE}"}}', f"pw = (('{VALUE}'))", f'pw = env.X ?? "{VALUE}"', f'pw = env.X || "{VALUE}"',
        f'pw = [\n "{VALUE}",\n "short"\n]', "pw: Map<" + "A, " * 200 + f'B> = "{VALUE}"', "pw = " + "(" * 500 + f'"{VALUE}"' + ")" * 500, f'setProperty("app.secret", "{VALUE}");', f'pw = get("db_password") or "{VALUE}"',
    ],
)
def test_more_syntaxes(text):
    assert [text[a:b] for a, b in secrets.literals(text)] == [VALUE]


def test_phrases_and_keys():
    """Blanks are for passphrases; a key's name within a call is no value."""
    for text, want in (('passphrase = "open sesame now"', ["open sesame now"]), ("db_password: 'correct horse battery staple'", ["correct horse battery staple"])):
        assert [text[a:b] for a, b in secrets.literals(text)] == want
    for text in ('password = "Please enter your password"', 'password = config.get("db_password")', 'password = input("Enter password: ")', 'password = os.environ["DB_PASSWORD"]', 'f("name", "value")', "password = x == 1", 'passphrase_hint = "open sesame now"', 'token = "a b c d e"', 'password = get("open sesame now")', "key = open(path, 'r')", 'api_key = "plain words here"'):
        assert secrets.literals(text) == [], text


_NAMES = {"db_password": True, "apiKey": True, "AUTH_TOKEN": True, "host": False, "retries": False, "page_title": False}
_LITERALS = {"Zk93+xQp77/aa": True, "hunter2-Xy99z": True, "none": False, "abc": False, "${DB_PW}": False, "xxxxxxxx": False}
_FORMS = ["{n} = '{v}'", '{n}: "{v}"', "{n} := `{v}`", '"{n}" => "{v}"', "String {n} = \"{v}\";", "#define {n} \"{v}\"", "--{n} '{v}'", "<{n}>{v}</{n}>", "{n} = f('{v}', 2)", "{n} = x or '{v}'", "{n} = x ? '{v}' : y", "cfg['{n}'] = '{v}'", "put('{n}', '{v}')", "{n} = ['{v}']", "{n}: Optional[str] = '{v}'", "set {n} '{v}'"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(_FORMS), st.sampled_from(sorted(_NAMES)), st.sampled_from(sorted(_LITERALS))), max_size=8), st.booleans())
def test_small_grammar(lines, constants):
    """Programs of a small grammar, of which it is known by their making where the secrets are. With constants a value
    comes by way of a name of its own, which is given it further down."""
    text, below, want = "", "", []
    for k, (form, name, literal) in enumerate(lines):
        own = f"c{k}z"
        if constants and "'{v}'" in form and "(" not in form and "[" not in form:
            text += form.format(n=name, v="\0").replace("'\0'", own) + "\n"
            below += f"{own} = '{literal}'\n"
            want += [(own, literal)] if _NAMES[name] and _LITERALS[literal] else []
        else:
            begin = len(text)
            text += form.format(n=name, v=literal) + "\n"
            if _NAMES[name] and _LITERALS[literal]:
                at = text.index(literal, begin)
                want.append((at, at + len(literal)))
    text += below
    want = {(text.index(f"{x[0]} = '") + len(x[0]) + 4, text.index(f"{x[0]} = '") + len(x[0]) + 4 + len(x[1])) if isinstance(x[0], str) else x for x in want}
    assert set(secrets.literals(text)) == want, text


def test_lexing_is_linear():
    import time

    for text in (
        "key set " + "-set " * 200_000, "&".join(f"a{i}=1" for i in range(100_000)) + "&key=1", "key=" * 100_000, "&".join(f"key{i}=abcdefg" for i in range(60_000)), "pw=f(" * 100_000, "pw=(" * 100_000, "pw=[" * 100_000, "a: ," * 200_000 + "key", "key = a + " * 60_000, "key=f('k', " * 60_000, "pw = x ? " * 60_000,
        "pw = 'a' or " * 60_000, "x > x = " * 100_000 + "key", "pw = k " * 100_000 + "k = '" + "ab1" * 100_000 + "'", "pw = k + k + k + k\n" * 20_000 + "k = '" + "ab1" * 100_000 + "'", "name='x' value='y' " * 50_000 + "key", "pw = x if " * 60_000, "set key " * 100_000, 'pw("k", ' * 60_000, "&k" * 300_000 + "key",
    ):
        began = time.time()
        secrets.literals(text)
        assert time.time() - began < 12, text[:20]
    began = time.time()
    for text in ("pw = x " * 40_000, "'" * 100_000 + " key", '"""' * 30_000 + " key", "/*" * 50_000 + "key", "<key>" * 40_000, "key: |\n" * 20_000, "key=" * 20_000, "[" * 100_000 + "key", "key = " + "(" * 50_000):
        secrets.literals(text)
    assert time.time() - began < 30


def test_kept_against_brute_force(spark):
    """Verdicts and words in common lines of hosts of several sizes, with copies, nulls, repeated lines and odd blanks."""
    r = random.Random(12)
    word = lambda: r.choice("ab cd ef gh ij kl".split()) + r.choice("klmnopqrst") + r.choice("uvwxyz")
    line = lambda n: " ".join(word() for _ in range(n))
    boiler = ["Accept All Cookies 12", "accept  all cookies 99 ", "\tShare this page now", line(9), line(30)]
    rows = []
    for i in range(400):
        host = r.choice(["a", "a", "a", "b", None, "c"])
        own = [line(r.randint(1, 12)) for _ in range(r.randint(1, 6))]
        text = own + [b for b in boiler if r.random() < (0.5 if host in ("a", None) else 0.1)] + own[:1] * r.choice([0, 0, 1])
        r.shuffle(text)
        rows.append((i, "\n".join(text), host))
    rows += [(1000 + i, rows[5][1], "b") for i in range(60)] + [(2000 + i, None, "b") for i in range(3)] + [(3000, "", "a"), (3001, " \n\x0b", None), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = sorted(((x.doc_id, x.n_line_words, x.kept) for x in quality_rules.op9(spark, df).collect()))
    want = sorted(brute.kept(rows))
    assert got == want
    assert sum(1 for _, n, k in want if n and not k) > 10 and sum(1 for _, n, k in want if n and k) > 10 and len({x[2] for x in want}) == 2
    assert sorted(x.doc_id for x in quality_rules.filter_quality(spark, df).collect()) == [d for d, _, k in want if k]


def test_sequence_numbers():
    """No two blocks have numbers in common, whatever their place, and what doesn't fit is an error."""
    places = [(p, b) for p in (0, 1, 2, 4095, (1 << 21) - 1) for b in (0, 1, 4095, 4096, 4097, (1 << 20) - 1)]
    first = sorted(packing.sequence_base(p, b, 1 << 22) for p, b in places)
    assert all(y - x >= 1 << 22 for x, y in zip(first, first[1:])) and 0 <= first[0] and first[-1] + (1 << 22) <= 1 << 63
    for part, block, n in ((1 << 21, 0, 1), (0, 1 << 20, 1), (0, 0, (1 << 22) + 1)):
        with pytest.raises(OverflowError):
            packing.sequence_base(part, block, n)


def test_files_of_ids(spark, tmp_path, monkeypatch):
    """Files by themselves, named by a manifest: what another attempt left is never read, and damage is told."""
    monkeypatch.setattr(rans, "SEGMENT", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        _files_of_ids(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _files_of_ids(spark, tmp_path):
    rows = [(i, f"some words of text number {i} " * (i % 5)) for i in range(100)] + [(None, "x"), (3, None), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(7)).repartition(3)
    folder = f"file://{tmp_path}/segments"
    rans.write_ids(df, folder).write.parquet(str(tmp_path / "lost"))  # an attempt that no manifest names
    rans.write_ids(df, folder).write.parquet(str(tmp_path / "manifest"))
    manifest = spark.read.parquet(str(tmp_path / "manifest"))
    files = {r.file for r in manifest.collect()}
    assert len(files) >= 4 and files < set(os.listdir(tmp_path / "segments"))
    out = rans.read_ids(manifest, folder)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString() and "Window" not in out._jdf.queryExecution().executedPlan().toString()
    told = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect()), key=lambda x: x[1])
    assert [x[0] for x in told] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0)) and len(told) == len(rows)
    assert all(x[1] + x[2] == y[1] for x, y in zip(told, told[1:])) and told[0][1] == 0
    name = sorted(files)[1]
    data = bytearray((tmp_path / "segments" / name).read_bytes())
    data[-1] ^= 1
    (tmp_path / "segments" / name).write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        out.collect()
    assert rans.op10(spark, df.where("false")).count() == 0


@pytest.mark.parametrize("limit", [3, 40, 1 << 15])
def test_piece_with_many_contexts(spark, monkeypatch, limit):
    """A rule of dashes or blanks in many contexts: its windows go apart, and what repeats is the same."""
    r = random.Random(9)
    monkeypatch.setattr(suffix_dedup, "SPLIT", limit)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    own = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows = [(i, own(30) + ("-" * 60 if i % 2 else " " * 33) + own(r.choice([3, 30])) + (f"{own(9)} shared by some of them and longer than fifty bytes {i % 4} {own(4)}" if i % 3 else "")) for i in range(160)]
    rows += [(1000 + i, rows[i][1][20:]) for i in range(0, 160, 7)] + [(2000, "-" * 700), (2001, " " * 90 + "-" * 90), (None, rows[3][1]), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((x.doc_id, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.op4(spark, df).collect()), key=repr)
    want = sorted(((d, *x) for d, _, *x in brute.repeats([(suffix_dedup.LAST if d is None else d, t) for d, t in rows])), key=repr)
    assert got == sorted(((None if d == suffix_dedup.LAST else d, *x) for d, *x in want), key=repr) and sum(x[1] > 0 for x in got) > 30


def test_labels_of_nothing(spark, monkeypatch):
    """Labels of documents that aren't there don't take the place of others in the sample."""
    monkeypatch.setattr(classifier, "SAMPLE_ROWS", 40)
    seen = []
    monkeypatch.setattr(classifier, "train", lambda rows: seen.append(len(rows)) or (classifier.np.zeros(1 << classifier.BITS, classifier.np.float32), 0.0))
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(0, 4000, 50)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    classifier.fit(spark, docs, labels)
    assert seen == [40]


def test_clashing_columns_of_chats(spark):
    rows = [(1, 1, "user", "hello?"), (1, 2, None, "Sure, here is it"), (2, None, None, "")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    odd = plain.withColumns({c: F.lit(9) for c in ("line", "block", "n_lines", "rendered", "key", "lines", "part", "state")})
    told = lambda df: sorted(map(repr, chat.format_chats(df).collect()))
    assert told(odd) == told(plain)
