"""Renames by similarity against a plain greedy choice over all pairs."""

import random

from trawl.operators import renames

SCHEMA = "path string, text string"


def plain(base, target, least):
    base, target = dict(base), dict(target)
    gone, new = {p: base[p] or "" for p in base if p not in target}, {p: target[p] or "" for p in target if p not in base}
    out = [("modified", p, None, None) for p in base if p in target and (base[p] or "") != (target[p] or "")]
    for q in sorted(new):
        same = sorted(p for p in gone if gone[p] == new[q])
        if same:
            out.append(("renamed", q, same[0], 1.0))
            del gone[same[0]]
    for _, q, _, _ in [x for x in out if x[0] == "renamed"]:
        new.pop(q, None)

    def count(t):
        c = {}
        for x in t.split("\n"):
            c[x] = c.get(x, 0) + 1
        return c

    size = lambda t: len(t.encode()) + 1
    pairs = []
    for p, x in gone.items():
        for q, y in new.items():
            a, b = count(x), count(y)
            both = sum(min(n, b.get(line, 0)) * (len(line.encode()) + 1) for line, n in a.items())
            if both >= least * max(size(x), size(y)):
                pairs.append((-round(both / max(size(x), size(y)), 6), p, q))
    for s, p, q in sorted(pairs):
        if p in gone and q in new:
            out.append(("renamed", q, p, -s))
            del gone[p], new[q]
    return sorted([*out, *(("deleted", p, None, None) for p in gone), *(("added", q, None, None) for q in new)], key=str)


def check(spark, base, target, least=0.5):
    got = renames.diff_similar(spark.createDataFrame(base, SCHEMA), spark.createDataFrame(target, SCHEMA), least=least)
    assert sorted(((r.action, r.file_path, r.previous_path, r.similarity) for r in got.collect()), key=str) == plain(base, target, least)


def test_random_trees(spark):
    r = random.Random(4)
    for least in (0.5, 0.8):
        line = lambda: r.choice(["}", "", "return x", *(f"line {r.randrange(400)}" for _ in range(12))])
        base = [(f"a/{i}", "\n".join(line() for _ in range(r.randint(1, 25)))) for i in range(40)]
        target = []
        for p, t in base:
            parts = t.split("\n")
            for _ in range(r.choice([0, 0, 1, 2, 8])):
                parts[r.randrange(len(parts))] = line()
            kind = r.random()
            if kind < 0.5:
                target.append((p.replace("a/", "b/"), "\n".join(parts)))
            elif kind < 0.8:
                target.append((p, "\n".join(parts)))
        check(spark, base, target + [("c/new", "all of\nit new")], least)


def test_near_copies_chains_nulls_and_empty_files(spark):
    body = "\n".join(f"shared {i}" for i in range(20))
    base = [("g1", body + "\nx"), ("g2", body + "\ny"), ("n", None), ("e", ""), ("only", "nothing like it")]
    target = [("h1", body + "\ny\nz"), ("h2", body + "\nx"), ("h3", body), ("m", ""), ("k", None)]
    check(spark, base, target)
    check(spark, base, [])
    check(spark, [], target)


def test_lines_that_all_files_share_propose_nothing(spark):
    same = "\n".join(["license"] * 10)
    base, target = [(f"g{i}", f"{same}\nown {i}\nmore of {i}\nand {i} again and again, so that it is half of the file" + "!" * 80) for i in range(60)], [(f"h{i}", f"{same}\nother {i}" + "?" * 120) for i in range(60)]
    check(spark, base, target)


def test_groups_of_near_copies_take_few_jobs(spark, monkeypatch):
    """Ties in a group once went one pair a round, each with tables of its own."""
    calls, was = [], renames.written
    monkeypatch.setattr(renames, "written", lambda df, name: calls.append(name) or was(df, name))
    body = "\n".join(f"shared {i}" for i in range(20))
    base = [(f"g{i:02}", f"{body}\nold {i:02}") for i in range(25)]
    check(spark, base, [(f"h{i:02}", f"{body}\nnew {i:02}") for i in range(20)])
    assert len(calls) < 12
