"""Derivation edges: repeated and null rows, counts, tasks that grow with the rows."""

from pyspark.sql import functions as F

from talespark.operators import provenance


def test_relations_and_counts(spark, monkeypatch):
    used = [(a, s) for a in range(40) for s in (a % 7, a % 5, a % 5, None)] + [(None, 1), (90, 1)]
    made = [(a, 100 + s) for a in range(40) for s in (a % 3, a % 2)] + [(None, 1), (91, 1), (3, None)]
    want = {(a, s, d) for a, s in used for b, d in made if a == b and None not in (a, s, d)}
    monkeypatch.setattr(provenance, "TASK_ROWS", 5)
    u, g = (spark.createDataFrame(x, "activity int, entity int") for x in (used, made))
    r = provenance.relations(u, g)
    assert sorted(map(tuple, r.collect())) == sorted(want)
    assert r.select(F.spark_partition_id()).distinct().count() > 10  # small tables, yet not brought together
    got = {x["dst"]: (x["edges"], x["sources"]) for x in provenance.edge_counts(u, g).collect()}
    assert got == {d: (sum(e[2] == d for e in want), len({e[1] for e in want if e[2] == d})) for d in {e[2] for e in want}}
    assert provenance.edge_counts(u.limit(0), g).count() == 0
