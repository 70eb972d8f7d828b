"""Functions and operators on literals with known answers, and against plain Python."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trawl.functions import code, paths, text, vectors
from trawl.operators import chunking, evals, incremental, jobs, questions, search
from trawl.plans.catalog import Catalog, Codebase, clamped, payload_filter
from trawl.sources import files
from trawl.streaming import watch


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("token", "parts"),
    [("HTTP_x", ["http_x", "http", "htt"]), ("MAX_SIZE", ["max_size", "max", "size", "ma", "size"]), ("HTTPServer", ["httpserver", "http", "server"]), ("getV2Token", ["getv2token", "get", "token"])],
)
def test_tokens(spark, token, parts):
    assert one(spark, token, text.lexical_tokens) == parts


@pytest.mark.parametrize(("token", "bucket"), [("getauthtoken", 794213), ("le", 608032), ("zz9", 504932)])
def test_buckets(spark, token, bucket):
    assert one(spark, token, text.sparse_bucket) == bucket


def test_identifiers(spark):
    assert one(spark, "a/b.py_3", text.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a/b.py_3"))
    assert one(spark, "f.py", lambda c: text.chunk_id(c, F.lit(0))) == "chunk-" + hashlib.sha256(b"f.py:0").hexdigest()[:16]
    assert one(spark, "/My Repo/Ünder!", text.slug) == "my-repo-nder"
    assert one(spark, "a\u0001b", text.sanitize) == "a b" and one(spark, None, text.sanitize) == "[empty embedding input]"
    assert len(one(spark, "x" * 20_000, text.sanitize)) == 12_000 + len(text.CUT_MARK)
    assert one(spark, "Where  is it.:", text.normalize_question) == "Where is it?"
    assert one(spark, "abcd", text.trigrams) == ["abc", "bcd"] and one(spark, "ab", text.trigrams) == []


@pytest.mark.parametrize(("path", "role"), [("a/tests/x.py", "test"), ("src/api/u.ts", "route"), ("prisma/s.prisma", "model"), ("p/config.ts", "config"), ("ui/A.tsx", "ui"), ("x/README.md", "docs"), ("x/run.sh", "script"), ("x/worker.py", "service"), ("x/y.py", "unknown")])
def test_roles(spark, path, role):
    assert one(spark, path, lambda c: code.file_role(c, code.language(c))) == role


@pytest.mark.parametrize(("path", "factor"), [("p/a.json", 0.5), ("a.config.ts", 0.6), ("x.test.tsx", 0.7), ("s.css", 0.6), ("y.lock", 0.3), ("m.py", 1.0)])
def test_penalties(spark, path, factor):
    assert one(spark, path, paths.path_penalty) == factor


def test_confidence_and_files(spark):
    s = spark.createDataFrame([(0.8, False), (0.5, False), (0.1, False), (0.1, True)], "s double, e boolean")
    assert [r[0] for r in s.select(paths.confidence("s", F.col("e"))).collect()] == ["high", "medium", "low", "high"]
    f = spark.createDataFrame([("test.py",), ("test.js",), ("test.txt",), ("node_modules/test.js",)], "p string")
    assert [r["p"] for r in f.where(paths.should_index("p", include="*.py,*.js")).collect()] == ["test.py", "test.js"]
    assert one(spark, "x/bundle.js", lambda c: paths.generated(c, F.lit("y" * 20_001))) and not one(spark, "x/a.py", lambda c: paths.generated(c, F.lit("y" * 20_001)))
    assert not one(spark, "static/tailwind.css", paths.should_index) and one(spark, "a/b/c.py", lambda c: paths.matches_any(c, ["a/**/c.py"]))
    assert one(spark, "apps/web/x.ts", paths.slice_id) == "apps/web" and one(spark, "x.ts", paths.slice_id) == "root"


SOURCE = "import os, sys as s\nfrom a.b import c\n\nclass Big(Base):\n    pass\n\ndef run(x, y) -> int:\n    return db.execute(x)\n"


def test_code(spark):
    df = code.describe(spark.createDataFrame([("src/big.py", SOURCE)], "path string, text string")).first()
    assert df["language"] == "python" and df["symbols_defined"] == ["Big", "run"] and df["imports"] == ["a.b", "os", "sys"]
    assert df["signature"] == "class Big(Base):" and df["chunk_type"] == "class" and df["side_effects"] == ["database"]
    assert "execute" in df["symbols_used"] and "run" not in df["symbols_used"] and df["when_to_use"] == "Use this result when investigating Big, run."
    js = code.describe(spark.createDataFrame([("src/a.ts", "import x from 'y'\nexport const go = (a) => 1\nenum Kind {}")], "path string, text string")).first()
    assert js["symbols_defined"] == ["Kind", "go"] and js["imports"] == ["y"] and js["chunk_type"] == "function"


def test_chunkers():
    lines = [f"line {i} " + "x" * (i % 90) for i in range(200)]
    t = "\n".join(lines)
    out = list(chunking.pack_lines(t))
    assert all(len(c) <= 1500 for c, *_ in out) and out[0][1] == 1 and out[-1][2] == 200
    assert {n for _, a, z in out for n in range(a, z + 1)} == set(range(1, 201))
    assert all(c == "\n".join(lines[a - 1 : z]) for c, a, z in out)
    assert [len(c) for c, *_ in chunking.pack_lines("y" * 3200)] == [1500, 1500, 200]
    late = list(chunking.pack_lines_late(t))
    assert all(c == "\n".join(lines[a - 1 : z]) for c, a, z in late)
    found = chunking.boundary_chunks("import x\n\ndef a():\n  1\n\nclass B:\n  2\n", "python")
    assert [c.split("\n")[0] for c, *_ in found] == ["import x", "def a():", "class B:"]
    assert chunking.boundary_chunks("def a():\n  1\n", "python") == [] and chunking.boundary_chunks("int x;", "c") == []


def test_json_replies():
    good = {"a": [1, "}"]}
    assert questions.extract_json(json.dumps(good)) == (json.dumps(good), "direct")
    assert questions.extract_json("x ```json\n{\"a\": 1}\n``` y") == ('{"a": 1}', "extracted")
    assert questions.extract_json('so {"a": {"b": "}"}} there') == ('{"a": {"b": "}"}}', "extracted")
    assert questions.extract_json('list ["a", "]"] ok') == ('["a", "]"]', "extracted")
    assert questions.extract_json("```\nnot json\n``` then ```json\n[1]\n```") == ("[1]", "extracted")
    assert questions.extract_json('{"a": "\\d"}') == ('{"a": "\\\\d"}', "repaired_escapes")
    assert json.loads(questions.extract_json('{"a": "C:\\\\Users", "b": "x\\d"}')[0]) == {"a": "C:\\Users", "b": "x\\d"}
    assert questions.extract_json("none") == (None, "error") and questions.extract_json(None)[1] == "error" and questions.extract_json('{"open": "')[1] == "error"


def test_grades():
    golden = [{"file": "a", "grade": None}, {"file": "a", "grade": 3}, {"file": "b", "grade": 0}]
    got = evals.score_ranked([{"file": "b"}, {"file": "a"}], golden, 5)
    assert got["mrr"] == 0.5 and got["recall"] == 1.0  # a grade of 0 is no hit
    first = evals.score_ranked([{"file": "a"}], golden, 5, best_grade=False)
    best = evals.score_ranked([{"file": "a"}], golden, 5)
    assert first["ndcg"] < best["ndcg"] and evals.score_ranked([], [{"file": "a"}], 5)["ndcg"] == 0.0


def test_watch_queue(spark):
    from pyspark.sql import functions as F

    from trawl.streaming import watch

    e = spark.createDataFrame([("a", "add", 1), ("a", "change", 2), ("b", "add", 3), ("b", "unlink", 4), ("c", "add", 5), ("d", "unlink", 6), ("d", "add", 7)], "path string, kind string, at long")
    indexed = spark.createDataFrame([("c",), ("d",)], "path string")
    q = watch.queue_of(e, indexed, "path", "kind", "at").cache()
    assert {(r["path"], r["added_at"]) for r in q.collect()} == {("a", 1), ("d", 7)}  # b is gone, c is indexed already
    assert [r["path"] for r in watch.still_indexed(e, indexed, "path", "kind").collect()] == ["c"]
    assert watch.next_batch(q, "path", paused=True).count() == 0 and [r["path"] for r in watch.next_batch(q, "path", 1).collect()] == ["a"]
    for n in (1, 2, 3):
        q = watch.after_batch(q.select("path", "added_at", "retries"), spark.createDataFrame([("a", False)], "path string, ok boolean"), "path", F.lit(100 + n).cast("long")).cache()
        got = {r["path"]: (r["state"], r["retries"]) for r in q.collect()}
        assert got == {"a": ("failed" if n == 3 else "queued", n), "d": ("queued", 0)}


def test_digest_context_hash_is_that_of_sorted_json(spark):
    import hashlib

    rows = [("s/é", 'a "q" \\ \t \x0b\x1f \\u000B', None, "m", "h"), ("", "", "", "", "")]
    d = spark.createDataFrame(rows, "slice_id string, module_purpose string, digest_version string, digest_model string, slice_content_hash string")
    got = [r[0] for r in d.select(text.digest_context_hash(*d.columns)).collect()]
    want = [hashlib.sha256(json.dumps({c: v or "" for c, v in zip(d.columns, r)}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for r in rows]
    assert got == want


def test_evaluation():
    r = [{"file": f} for f in ("x", "y", "g")]
    s = evals.score_ranked(r, [{"file": "g", "grade": 3}], 10)
    assert s["mrr"] == pytest.approx(1 / 3) and s["ndcg"] == pytest.approx(0.5) and s["recall"] == 1
    ranged = [{"file": "g", "start_line": 1, "end_line": 5, "grade": 1}, {"file": "g", "start_line": 4, "end_line": 9, "grade": 3}]
    s = evals.score_ranked([{"file": "g", "start_line": 5, "end_line": 6}, {"file": "g", "start_line": None, "end_line": None}], ranged, 10)
    assert s["ndcg"] == pytest.approx(7 / (7 + 1 / 1.584962500721156))
    assert evals.score_ranked([], [], 5) == {"recall": 0.0, "mrr": 0.0, "ndcg": 0.0}


def test_percentile_status_guard(spark):
    v = spark.range(1, 21).select(F.col("id").cast("double").alias("v"))
    assert v.agg(evals.nearest_rank("v", 0.95)).first()[0] == 19
    st = spark.createDataFrame([(5, 0), (3, 1), (0, 2)], "d int, e int").select(jobs.shard_status("d", "e").alias("s"))
    assert [r["s"] for r in st.collect()] == ["published", "partial", "failed"]
    n = spark.range(100)
    assert incremental.guarded_stale(n, n.where("id >= 20"), "id").count() == 20
    with pytest.raises(ValueError):
        incremental.guarded_stale(n, n.where("id >= 21"), "id")


def test_checkpoint_fold(spark):
    log = [(i, "pending", 0) for i in range(100)] + [(i, "hyde_done", 1) for i in range(30)] + [(i, "upserted", 2) for i in range(10)]
    got = incremental.latest(spark.createDataFrame(log, "k int, stage string, seq int"), "k", "seq", ["stage"])
    assert Counter(r["stage"] for r in got.collect()) == {"pending": 70, "hyde_done": 20, "upserted": 10}


def test_fusion(spark):
    r = spark.createDataFrame([(1, 7, 1), (1, 7, 1), (1, 8, 2)], "q int, d int, rank int")
    got = {x["d"]: x["score"] for x in search.rrf(r, "q", ["d"]).collect()}
    assert got == {7: round(2 / 61, 8), 8: round(1 / 62, 8)}
    h = spark.createDataFrame([(1, 5, "code", None, 0.6), (1, 6, "hyde", 5, 0.8)], "q int, i int, kind string, parent int, score double")
    assert search.parent_boost(h, "q", "i", "kind", "parent").first()["score"] == pytest.approx(1.0)
    ranked = spark.createDataFrame([(q, d, n) for q in (1, 2) for n, d in enumerate("abc", 1)] + [(3, "x", 1)], "q int, d string, rank int")
    failing = search.listwise_rerank(ranked, "q", lambda hits: 1 / 0, 2).collect()  # fails as it runs, in the tasks
    assert sorted((x["q"], x["d"], x["rank"], x["reranked"], x["fallback"]) for x in failing) == [(1, "a", 1, False, True), (1, "b", 2, False, True), (2, "a", 1, False, True), (2, "b", 2, False, True), (3, "x", 1, False, False)]
    named = search.listwise_rerank(ranked.where("q = 1"), "q", lambda hits: [2, 9, 2, -1, 0]).collect()
    assert sorted((x["rank"], x["d"]) for x in named) == [(1, "c"), (2, "c"), (3, "a")]


def test_catalog(spark):
    chunks = spark.createDataFrame([(i, f"p/{i}.{'md' if i == 1 else 'py'}", i != 2, "code", None, ["t", str(i)]) for i in range(4)], "chunk_id int, file_path string, active boolean, kind string, parent_chunk_id int, tags array<string>")
    vecs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id int, embedding array<double>")
    book = Catalog()
    book.register("a", Codebase(chunks, vecs))
    with pytest.raises(ValueError):
        book.info()
    with pytest.raises(KeyError):
        book.use("b")
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id int, query_vec array<double>")
    hits = sorted(book.use("a").search(q).collect(), key=lambda r: r["rank"])
    assert [h["vec_id"] for h in hits] == [1, 3, 0] and hits[0]["score"] == pytest.approx(0.6)  # 2 is inactive; the penalty moves no rank
    assert [h["vec_id"] for h in sorted(book.search(q, resort=True).collect(), key=lambda r: r["rank"])] == [3, 0, 1]
    assert payload_filter(chunks, {"tags": ["1", "3"], "kind": "code"}).count() == 2 and payload_filter(chunks, {"tags": "t"}).count() == 4
    assert clamped() == (5, 50) and clamped(99, 3) == (20, 20) and book.unregister("a") == 1 and book.slugs() == []


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.png").write_bytes(b"\x89")
    (tmp_path / "src" / "node_modules" / "c.js").write_text("1")
    (tmp_path / "src" / "nul.py").write_bytes(b"a\0b")
    got = files.read_tree(spark, f"{tmp_path}/src").collect()
    assert [(r["path"], r["text"], r["sha256"]) for r in got] == [("a.py", "x = 1\n", hashlib.sha256(b"x = 1\n").hexdigest())]
    p = tmp_path / "r.jsonl"
    p.write_text('{"chunk_id":"1","repo_slug":"s","file_path":"f","source_sha256":"h","text":"t"}\n{"chunk_id":"2"}\n{"action":"tombstone","file_path":"g","repo_slug":"s"}\n')
    assert files.read_records(spark, str(p)).count() == 1
    kept, gone = files.read_changes(spark, str(p))
    assert kept.count() == 1 and [r["file_path"] for r in gone.collect()] == ["g"]
    q = tmp_path / "q.jsonl"
    q.write_text('{"id":"1","ok":true,"hyde_questions":["a?"]}\n\nbroken\n{"id":"2","ok":false}\n')
    rows = files.read_tolerant(spark, str(q))
    assert rows.count() == 3 and rows.where("_bad").count() == 2
    g = tmp_path / "g.json"
    g.write_text('[{"query":"q","answer_files":["a","b"]},{"id":"i","query":"r","relevant":[{"file":"c","grade":2}]}]')
    golden = {r["query"]: r for r in files.read_golden(spark, str(g)).collect()}
    assert [x["file"] for x in golden["q"]["relevant"]] == ["a", "b"] and golden["r"]["relevant"][0]["grade"] == 2
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    files.publish(old, f"{tmp_path}/s0")
    new = files.upsert_parquet(spark, f"{tmp_path}/s0", f"{tmp_path}/s1", spark.createDataFrame([(2, "c", 0), (3, "d", 0)], "k int, v string, seq int"), "k", "seq")
    assert sorted((r["k"], r["v"]) for r in new.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    reg = spark.createDataFrame([("p", "/w"), ("q", "/w/x")], "name string, root string")
    cwd = spark.createDataFrame([("/w/x/y",), ("/w/z",), ("/v",)], "cwd string")
    assert sorted((r["cwd"], r["name"]) for r in files.longest_prefix(cwd, reg, "cwd", "root").collect()) == [("/w/x/y", "q"), ("/w/z", "p")]


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    assert tuple(v.select(vectors.norm("a"), vectors.dot("a", "b"), vectors.cosine("a", "b")).first()) == pytest.approx((5.0, 24.0, 0.96))
    h = hashlib.sha256(b"s:0").digest()
    want = [round(int.from_bytes(h[i : i + 2], "big", signed=True) / 32768, 6) for i in range(0, 32, 2)]
    assert one(spark, "s", lambda c: vectors.pseudo_embedding(c, 16)) == pytest.approx(want)


def test_state_and_streams(spark, tmp_path):
    state = spark.createDataFrame([("a", "c0"), ("b", "c0")], "slug string, active_commit string")
    done = spark.createDataFrame([("a", 5, 5, "c1"), ("b", 5, 4, "c1")], "slug string, total int, published int, target_commit string")
    assert sorted((r["slug"], r["active_commit"]) for r in incremental.advance_state(state, done, "slug").collect()) == [("a", "c1"), ("b", "c0")]
    rows = [(f"p{i % 2}", f"2024-01-01 00:00:0{i}", i) for i in range(6)]
    df = spark.createDataFrame(rows, "path string, t string, n int").select("path", F.to_timestamp("t").alias("ts"), "n")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = watch.read_events(spark, f"{tmp_path}/in")
    watch.run_once(stream, f"{tmp_path}/c", watch.upsert_sink(f"{tmp_path}/out", "path", "n"))
    assert sorted((r["path"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out/snapshot=0").collect()) == [("p0", 4), ("p1", 5)]
    watch.run_once(stream, f"{tmp_path}/c", watch.upsert_sink(f"{tmp_path}/out", "path", "n"))  # nothing new: nothing written
    assert not (tmp_path / "out" / "snapshot=1").exists()


def test_anchors_are_not_sessions(spark):
    e = spark.createDataFrame([("g", t) for t in (0, 200, 290, 310, 600, 611)] + [("h", 5)], "g string, t long")
    got = sorted((r["g"], r["batch"], r["size"], r["first_ms"]) for r in jobs.anchored_batches(e, "g", "t").collect())
    assert got == [("g", 0, 3, 0), ("g", 1, 2, 310), ("g", 2, 1, 611), ("h", 0, 1, 5)]




def test_batched_calls(spark):
    from trawl.operators import batches

    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(texts) > 1 and any("bad" in t for t in texts) or any(t == "bad" for t in texts):
            raise RuntimeError
        return [[float(len(t))] for t in texts]

    assert len(batches.halved(["a", "bad", "ccc", "d"], flaky, batches.fallback_of)) == 4 and calls[0] == 4
    waits, left = [], [1, 1]

    def soon():
        if left:
            left.pop()
            raise OSError
        return "ok"

    assert batches.retried(soon, jitter=0, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        batches.retried(lambda: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)
    call = batches.with_fallback(lambda x: 1 / 0, lambda x: x, lambda e: isinstance(e, ZeroDivisionError))
    assert call(3) == 3 and call(4) == 4
    df = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id int, text string")
    got = batches.embed(df, "id", "text", lambda: lambda ts: [[float(len(t))] for t in ts], parallel=3, batch=4)
    assert {r["id"]: r["embedding"] for r in got.collect()} == {i: [float(i)] for i in range(20)}


def test_shard_machine(spark):
    from trawl.operators import batches

    s = spark.createDataFrame([("j", 0), ("j", 1), ("k", 0)], "job string, seq int")
    e = [("j", 0, 1, "running", None), ("j", 0, 2, "done", "o1"), ("j", 0, 3, "done", "o2"), ("j", 0, 4, "failed", None), ("j", 1, 1, "done", "x"), ("j", 1, 2, "running", None), ("j", 1, 3, "failed", None), ("j", 1, 4, "running", None)]
    ev = spark.createDataFrame(e, "job string, seq int, t int, event string, output string").withColumn("at", F.timestamp_seconds("t"))
    got = batches.applied(s, ev, "job", "seq", "at")
    assert sorted(tuple(r) for r in got.collect()) == [("j", 0, "done", 1, "o1"), ("j", 1, "running", 2, None), ("k", 0, "pending", 0, None)]
    c = batches.committed(got, "job", spark.createDataFrame([("j", 2), ("k", 2), ("l", 1)], "job string, expected int"))
    assert sorted(tuple(r) for r in c.collect()) == [("j", 2, 2, True, False), ("k", 2, 1, False, False), ("l", 1, 0, False, False)]


def test_golden_filter(spark):
    from trawl.operators import batches

    q = spark.createDataFrame([("A b", [("x",)]), (" a B", [("x",)]), ("c", [("gone",)]), ("d", [])], "query string, relevant array<struct<file:string>>")
    kept = batches.valid_golden(q, spark.createDataFrame([("x",)], "path string"))
    assert kept.count() == 1 and kept.first()["id"].startswith("golden-") and batches.drop_rate(q, kept).first()["drop_rate"] == 0.75


def test_tracked_files(spark, tmp_path):
    import shutil
    import subprocess

    if not shutil.which("git"):
        pytest.skip("no git")
    for name in ("kept.py", "left.py", "deep/also kept.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    assert files.tracked(spark, str(tmp_path)) is None
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "add", "kept.py", "deep"], check=True)
    listed = files.tracked(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.read_tree(spark, str(tmp_path), listed=listed).collect()) == ["deep/also kept.ts", "kept.py"]
    assert files.read_tree(spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize(("value", "name"), [("src/a b.py", "src-a-b-py"), ("--x_1--", "x_1"), ("äé/2", "äé-2"), ("./", "slice"), (None, "slice")])
def test_safe_filename(spark, value, name):
    assert one(spark, value, text.safe_filename) == name


def test_floor_rank(spark):
    rows = [("a", float(x)) for x in [1, 1, 1, 2, 9]] + [("b", 5.0)]
    got = {p: {r["k"]: r["value"] for r in evals.floor_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", p).collect()} for p in (0.0, 0.5, 0.6, 0.95, 1.0)}
    want = {p: {k: (own := sorted(v for x, v in rows if x == k))[min(int(p * len(own)), len(own) - 1)] for k in "ab"} for p in got}
    assert got == want


def test_chunks_leave_before_their_batch_is_through():
    """A task holds some chunks at a time, not those of all texts of an Arrow batch."""
    import pyarrow as pa
    from pyspark.sql import types as T

    class Docs:
        schema = T.StructType([T.StructField("id", T.LongType())])

        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            return run

    seen, n = [], 3 * chunking.MOST_ROWS
    run = chunking._each(Docs(), "id", ["t"], lambda t: seen.append(t) or [(0, t)], "k bigint, chunk string")
    batch = lambda text: pa.RecordBatch.from_pydict({"id": list(range(n)), "t": [text] * n})
    out = run(iter([batch("a")]))
    first = next(out)
    assert len(seen) == first.num_rows == chunking.MOST_ROWS
    assert first.num_rows + sum(b.num_rows for b in out) == n
    assert next(run(iter([batch("long" * 1000)]))).num_rows <= chunking.MOST_CHARS // 4000 + 1
