"""Edges and contexts against plain Python."""

import random

from trawl.operators import graph

SCHEMA = "id long, symbols_defined array<string>, symbols_used array<string>, file_role string"


def data():
    r = random.Random(2)
    names = [f"s{i}" for i in range(25)]
    rows = [(i, r.sample(names, r.randint(0, 3)), r.sample(names, r.randint(0, 6)), r.choice(["test", "x", None])) for i in range(60)]
    return rows + [(100 + i, ["everywhere"], ["s1"], "x") for i in range(12)] + [(200, [], None, None), (201, None, ["everywhere"], "x")]


def plain(rows, definers):
    defs = {}
    for i, d, _, _ in rows:
        for s in set(d or []):
            defs.setdefault(s, []).append(i)
    return {(i, j) for i, d, u, _ in rows if d is not None and u is not None for s in set(u) - set(d) for j in defs.get(s, []) if len(defs[s]) <= definers and i != j}


def test_edges_and_context(spark):
    rows = data()
    chunks = spark.createDataFrame(rows, SCHEMA)
    links = graph.edges(chunks, "id")
    want = plain(rows, graph.DEFINERS)
    assert {(e.caller, e.callee) for e in links.collect()} == want and len(want) > 50
    hits = spark.createDataFrame([(1, 0), (1, 3), (2, 3), (2, 200), (2, 7)], "q long, id long")
    role = {r[0]: r[3] for r in rows}
    got = {g.id: g for g in graph.context(hits, links, chunks, "id", "id", listed=4).collect()}
    assert set(got) == {0, 3, 7, 200}
    for i, g in got.items():
        calls, back = sorted(j for a, j in want if a == i), [a for a, j in want if j == i]
        by, tests = sorted(a for a in back if role[a] != "test"), sorted(a for a in back if role[a] == "test")
        assert (g.calls, g.called_by, g.tests) == (calls[:4], by[:4], tests[:4]) and (g.n_calls, g.n_called_by, g.n_tests) == (len(calls), len(by), len(tests))


def test_neighbours(spark):
    links = spark.createDataFrame([(1, 2), (3, 1), (2, 9)], "caller long, callee long")
    hits = spark.createDataFrame([(7, 1, 0.8), (7, 9, 0.1)], "q long, id long, score double")
    got = [(g.id, g.score, g["rank"]) for g in graph.neighbours(hits, links, "q", "id").orderBy("rank").collect()]
    assert got == [(1, 0.8, 1), (2, 0.4, 2), (3, 0.4, 3), (9, 0.1, 4)]
