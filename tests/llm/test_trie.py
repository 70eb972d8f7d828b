"""Prefix tries against plain Python, with what tables may hold."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from trawl.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, grp long, part int, digest string, lent int, shared int"


def head(c):
    return c - c % 100, zlib.crc32(str(c).encode()) % 6


def check(spark, rows, lent, parts=4):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA).repartition(parts)
    more = (F.col("grp") - F.col("grp") % 100, F.crc32(F.col("grp").cast("string").cast("binary")) % 6) if lent else ()
    got = [(g.conv_id, g.depth, g.parent_conv_id, g.n_convs, g.n_children, g.n_leaves, g.saved_tokens, g.ends_sha256) for g in trie.prefix_trie(df, *more).collect()]
    want = trie.brute_trie(rows, head if lent else None)
    assert len(got) == len(want) and set(got) == want
    return got


@pytest.mark.parametrize("lent", [False, True])
def test_small_alphabet(spark, lent):
    r = random.Random(3)
    rows = [(c, i, r.choice(["user", None]), r.choice(["a", "bb", None, "é漢"])) for c in range(0, 420, 2) for i in range(r.randint(1, 9))]
    check(spark, rows, lent)


def test_one_conversation_of_many_partitions(spark):
    rows = [(7, i, "user", f"t{i % 50}") for i in range(6000)] + [(8, i, "user", f"t{i % 50}") for i in range(4500)] + [(c, 0, "user", "t0") for c in range(200, 260)]
    got = check(spark, rows, False, 8)
    assert max(g[1] for g in got) == 6000
    check(spark, rows, True, 8)


def test_many_equal_conversations(spark):
    rows = [(c, i, "user", "x" * i) for c in range(300, 900) for i in range(4)] + [(5, 0, "user", ""), (6, 0, "user", "q")]
    got = check(spark, rows, False)
    assert max(g[3] for g in got) == 602


def test_nulls_ties_and_turnless(spark):
    # 101 takes turns from 100, which is not there, and has fewer own turns than it leaves out
    few = next(c for c in range(101, 200) if head(c)[1] >= 3)
    rows = [(few, 0, "a", "b"), (few, 1, "a", "c"), (None, 0, "x", "y"), (3, None, "n", "first"), (3, 0, "m", "second"), (3, 0, "m", "second"), (3, 0, None, None)]
    got = check(spark, rows, True)
    assert (0, 3) in {(g[1], g[0]) for g in got}
    check(spark, rows, False)


def test_long_text_negative_ids_and_empty_table(spark):
    rows = [(-7, 0, "u", "ab" * 1_000_000), (-7, 1, "u", "z"), (9, 0, "u", "ab" * 1_000_000)]
    assert max(g[6] for g in check(spark, rows, False)) == 2_000_000
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_flushes_and_merges(spark, monkeypatch):
    """Partial tries of any size give the same nodes."""
    r = random.Random(9)
    rows = [(c, i, "u", r.choice("ab")) for c in range(1, 99) for i in range(r.randint(1, 7))]
    monkeypatch.setattr(trie, "MERGED", 2)
    monkeypatch.setattr(trie, "SPAN", 2)
    check(spark, rows, True, 6)


def test_names_of_prefixes():
    a, b = trie.Prefix(), trie.Prefix()
    turns = [bytes([i]) * 32 for i in range(200)]
    names = []
    for t in turns:
        a.add(t)
        names.append(a.name)
    assert len(set(names)) == 200
    for t in turns[:73]:
        b.add(t)
    c = trie.Prefix(b.length, [list(r) for r in b.runs])
    for t in turns[73:]:
        c.add(t)
    assert c.name == names[-1]
