"""Graphs from one reading of each text are those of the tables."""

import random

import pytest

from tessera.operators import graph
from tessera.operators.extract import call_table, extract, unnest
from tessera.queries import queries
from tessera.unit_queries import QUERIES


def _files(spark):
    r = random.Random(7)
    names = [f"{n}{k}" for n in ("f", "A::g", "B::g", "h") for k in range(3)]
    rows = []
    for i in range(12):
        own = r.sample(names, 6)
        rows.append((i, "\n".join(f"int {n}({r.choice(['int a', 'long a', ''])}) {{ {' '.join(f'{c}(1);' for c in r.choices([*own, 'g0', 'g1', 'puts', 'x.h0', 'f9'], k=4))} }}" for n in [*own, *own[:2]])))
    return spark.createDataFrame([*rows, (99, None), (100, "int x;")], "file_id long, text string").repartition(3)


def test_one_reading(spark):
    parsed = extract(_files(spark)).cache()
    f = unnest(parsed, "functions")
    by_tables = graph.resolve_calls(call_table(f), f)
    told = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert told(graph.resolved_calls(parsed)) == told(by_tables) and graph.edges(by_tables).count() > 50
    d = graph.degrees(f.selectExpr("file_id", "unique_fqn AS id"), graph.edges(by_tables))
    assert told(graph.call_degrees(parsed)) == told(d)
    assert graph.call_degrees(parsed.where("file_id > 98")).count() == 0


@pytest.mark.parametrize("name", ["priority_order", "calls_resolved", "call_degrees", "external_calls", "unit_edges"])
def test_scans(spark, name):
    """One scan and one reading in Python, and no job before an action."""
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    df = (queries() | QUERIES)[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Relation [") == 1
    # Reading a table's schema is a job; the query itself has none.
    assert len(tracker.getJobIdsForGroup(None)) - before <= 1
