"""The pipeline's stages against plain Python."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    docs = table(spark, SF, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r.text for r in docs.collect()}
        pairs = list(before.items())
        if name == "quality_rules":
            assert set(after) == {x[0] for x in brute.quality(pairs) if not x[6]}
        elif name == "ngram_jaccard":
            assert set(after) == {d for d, _, c in brute.near(pairs) if c == d}
        elif name == "decontamination":
            assert set(after) == {x[0] for x in brute.decontam(pairs, items) if not x[5]}
        elif name == "secret_scan":
            assert set(after) == set(before) and sum(sum(x[1:4]) for x in brute.secrets(list(after.items()))) == 0
    pieces = [tuple(r) for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()]
    brute.check_packing(sorted(after.items()), pieces)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " x", "en", None, 1), (None, text, None, "s", None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:4]:
            d = stage(spark, d, SF)
            assert d.columns == docs.columns
        assert corpus_pipeline.STAGES[4][1](spark, d, SF).count() in (0, 2)


def test_lines_and_no_benchmark(spark, tmp_path):
    """A line rule that removes documents, and a benchmark without items, which removes none."""
    r = random.Random(3)
    own = lambda i, n: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{r.choice('klmnop')}{r.choice('qrstuv')}{k}" for k in range(n))
    line = "this line is on each page of the host and says nothing at all that anyone would want to keep in a corpus"
    rows = [(i, f"{own(i, 5)}\n{line}" if i < 60 else own(i, 40), "s") for i in range(120)]
    docs = spark.createDataFrame([(d, t, "en", h, len(t)) for d, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(d for d, _, k in brute.kept(rows) if k) == list(range(60, 120))
    assert stages["decontamination"](spark, kept, str(tmp_path)).count() == 60
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in pieces.select("doc_id").collect()} == set(range(60, 120))
