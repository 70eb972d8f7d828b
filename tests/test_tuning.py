"""Query classes, the grid against plain Python, routes, and texts that documents hold whole."""

import math
import random

from pyspark.sql import functions as F

from trawl.operators import evals, tuning


def test_query_types(spark):
    want = {
        "src/api/user.ts": "path", "worker.py": "path", "in src/api where": "path", "getUser": "symbol", "max_retries": "symbol", "Config.maxSize": "symbol", "std::move": "symbol", "run()": "symbol", "sha256": "symbol",
        "TypeError: x is undefined": "error", "segfault at 0x7fff12ab": "error", "how are chunks packed": "question", "is it cached": "question", "chunks are packed greedily?": "question",
        "vector search": "keywords", "": "keywords", "a long text about nothing in particular": "prose",
    }
    df = spark.createDataFrame([*((k, v) for k, v in want.items()), (None, "keywords")], "q string, want string")
    bad = df.where(tuning.query_type("q") != F.col("want")).collect()
    assert bad == []


def plain(words, vectors, gold, k, w, depth):
    out = {}
    for q in {g[0] for g in gold}:
        grades = {i: g for x, i, g in gold if x == q}
        score = {}
        for hits, weight in ((words, w), (vectors, 1.0)):
            for x, i, r in hits:
                if x == q:
                    score[i] = score.get(i, 0) + weight / (k + r)
        order = sorted(score, key=lambda i: (-round(score[i], 8), i))[:depth]
        got = sum((2 ** grades.get(i, 0) - 1) / math.log2(r + 2) for r, i in enumerate(order))
        ideal = sum((2**g - 1) / math.log2(r + 2) for r, g in enumerate(sorted(grades.values(), reverse=True)[:depth]))
        if ideal > 0:
            out[q] = round(got / ideal, 6)
    return out


def test_grid_equals_plain_python(spark):
    r = random.Random(3)
    hits = lambda: [(q, i, n + 1) for q in range(6) for n, i in enumerate(r.sample(range(30), 12))]
    words, vectors = hits(), hits()
    gold = [(q, i, r.randint(0, 3)) for q in range(5) for i in r.sample(range(30), 4)] + [(9, 1, 2)]
    frame = lambda rows, last: spark.createDataFrame(rows, f"q long, d long, {last} int")
    scores = tuning.grid_ndcg(frame(words, "rank"), frame(vectors, "rank"), frame(gold, "grade"), "q", "d", (5, 60), (0.8, 2.0), 5)
    got = {(s.q, s.k, s.w): s.ndcg for s in scores.collect()}
    want = {(q, k, w): v for k in (5, 60) for w in (0.8, 2.0) for q, v in plain(words, vectors, gold, k, w, 5).items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    types = spark.createDataFrame([(q, "even" if q % 2 == 0 else "odd") for q in range(6)], "q long, type string")
    cells = tuning.by_type(scores, types, "q")
    best = {c.type: (c.k, c.w) for c in tuning.chosen(cells).collect()}
    for t in best:
        means = {(k, w): [v for (q, k2, w2), v in want.items() if (k2, w2) == (k, w) and q < 6 and (q % 2 == 0) == (t == "even")] for k in (5, 60) for w in (0.8, 2.0)}
        top = max(round(sum(v) / len(v), 6) for v in means.values())
        assert abs(sum(means[best[t]]) / len(means[best[t]]) - top) < 2e-6


def test_routes(spark):
    words = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "q long, d long, rank int")
    other = spark.createDataFrame([(1, 11, 1), (2, 12, 1)], "q long, d long, rank int")
    types = spark.createDataFrame([(1, "symbol"), (2, "prose")], "q long, type string")
    routes = spark.createDataFrame([("symbol", 5, 2.0)], "type string, k int, w double")
    got = {(r.q, r.d): (round(r.score, 8), r["rank"]) for r in tuning.routed_fusion({"words": words, "other": other}, "words", types, routes, "q", "d").collect()}
    assert got == {(1, 10): (round(2 / 6, 8), 2), (1, 11): (round(2 / 7 + 1 / 6, 8), 1), (2, 10): (round(1 / 61, 8), 1), (2, 12): (round(1 / 61, 8), 2)}


def test_holders_equal_a_search_of_all_pairs(spark):
    r = random.Random(8)
    words = ["the", "a", "of", "rare1", "rare2", "x", "é漢"]
    docs = [(i, "".join(r.choice(words) + r.choice([" ", "  ", "\n"]) for _ in range(r.randint(0, 40)))) for i in range(120)] + [(500, None), (501, "")]
    items = [(i, d[1][a : a + r.randint(1, 30)]) for i, d in enumerate(docs[:60]) if d[1] for a in [r.randrange(len(d[1]))]] + [(900, "nowhere to be found here"), (901, None), (902, ""), (903, "x"), (904, "the")]
    got = evals.holders(spark.createDataFrame(items, "i long, text string"), spark.createDataFrame(docs, "d long, text string"), "i", "d")
    want = sorted((i, d) for i, t in items if t for d, x in docs if x and t in x)
    assert sorted((g.i, g.d) for g in got.collect()) == want
    long = spark.createDataFrame([(1, "one two three four"), (2, "two three four five six")], "i long, text string")
    assert [(g.i, g.d) for g in evals.holders(long, spark.createDataFrame([(7, "zero one two three four five")], "d long, text string"), "i", "d").collect()] == [(1, 7)]


def test_the_same_file_by_its_end_or_its_name(spark):
    rows = [("src/a.py", "a.py", True), ("a.py", "/x/src/a.py", True), ("x/b.py", "y/b.py", True), ("x/b.py", "y/c.py", False), (None, "a.py", None)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(~evals.same_file_loosely("a", "b").eqNullSafe(F.col("want"))).count() == 0
