"""The JSON-lines source against plain reads, for ranges of any size."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from trawl.sources import files, line_source


def test_ranges_own_the_lines_that_begin_in_them(monkeypatch):
    monkeypatch.setattr(line_source, "READ", 7)
    r = random.Random(1)
    for _ in range(200):
        raw = "".join(r.choice(["a", "bc", "\n", "\r\n", "é"]) for _ in range(r.randint(0, 40))).encode()
        want, at = [], 0
        for line in raw.split(b"\n"):
            if line or at + len(line) < len(raw):
                want.append((at, line.removesuffix(b"\r")))
            at += len(line) + 1
        for size in (1, 3, 10, 1000):
            got = [x for a in range(0, len(raw), size) for x in line_source.lines_of(io.BytesIO(raw), a, min(a + size, len(raw)))]
            assert got == want


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub").mkdir()
    lines = [json.dumps({"id": str(i), "ok": i % 3 != 0, "hyde_questions": [f"q{i}"]}) for i in range(500)]
    (tmp_path / "a.jsonl").write_bytes("\n".join([*lines[:200], "  ", "{cut", "[1]", "3"]).encode() + b"\n\xff\xfe{}\n")
    (tmp_path / "sub" / "b.jsonl").write_text("\r\n".join(lines[200:]))
    (tmp_path / "sub" / "c.txt").write_text("not this one")
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "_hidden.jsonl").write_text("{}")
    return tmp_path


def test_rows_and_bad_lines(spark, tree):
    rows = line_source.read_lines(spark, f"file://{tree}", glob="*.jsonl", range=700)
    assert rows.count() == 504 and rows.where("ok").count() == 500
    assert {(r.problem, r.n) for r in rows.where("not ok").groupBy("problem").agg(F.count("*").alias("n")).collect()} == {("json", 1), ("no object", 2), ("encoding", 1)}
    assert rows.rdd.getNumPartitions() > 20
    first = rows.where(F.col("path").endswith("b.jsonl")).orderBy("at").first()
    assert first.at == 0 and json.loads(first.line)["id"] == "200"


def test_equals_the_tolerant_read(spark, tree):
    for name in ("a.jsonl", "sub/b.jsonl"):
        got = line_source.read_sidecars(spark, f"file://{tree}/{name}", files.QUESTION, range=1000).select("id", "_bad")
        want = files.read_tolerant(spark, f"file://{tree}/{name}").select("id", "_bad")
        key = lambda df: sorted((str(r.id), r._bad) for r in df.collect())
        # a list and a number are JSON, but no record
        assert [x for x in key(got) if x[0] != "None"] == [x for x in key(want) if x[0] != "None"]
    assert got.where("_bad").count() == want.where("_bad").count()


def test_files_are_pruned_before_they_are_read(spark, tree):
    reader = line_source.Reader({"path": f"file://{tree}", "glob": "*.jsonl", "mostBytes": "15000"})
    assert {p.path.rsplit("/", 1)[-1] for p in reader.partitions()} == {"a.jsonl"}
    reader = line_source.Reader({"path": f"file://{tree}", "exclude": "a*"})
    assert {p.path.rsplit("/", 1)[-1] for p in reader.partitions()} == {"b.jsonl", "c.txt"}
    reader = line_source.Reader({"path": f"file://{tree}", "prefix": f"{tree}/sub/b"})
    assert {p.path.rsplit("/", 1)[-1] for p in reader.partitions()} == {"b.jsonl"}
    assert line_source.read_lines(spark, f"file://{tree}", glob="nothing*").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        line_source.read_lines(spark, f"file://{tree}/nowhere").count()
