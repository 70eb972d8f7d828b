"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to), so the flow has one node for a
pattern, not for a document. A pattern sends its words to the quotas of its sources; its first pass over its
documents is free, each further one costs more than the last (1, 2, ...), so repeats come last and are spread
evenly. In a pattern, whole passes go to every document; what is left of the flow goes to documents in seeded hash
order, the last of them in part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.shared import WORD, blocks, boxed, carried, unboxed, written

#: Weights of the sources in order, repeating (fixed by the contract of the query).
WEIGHTS = (5.0, 2.0, 1.0)
#: So many patterns at most are sent to the documents; more are joined by a shuffle, with the same result.
MOST_SENT = 20_000
RESULTS = ("_size", "_members", "_source_size", "_target", "_taken")


def water_fill(sizes: list[float], weights: list[float], total: float, cap: float = 3.0) -> list[float]:
    """Shares of total by weight; none above cap times its size, the excess shared again by weight until none is above."""
    target, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > cap * sizes[i] * weight]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left -= sum(target[i] for i in over)
        full = set(over)
        free = [i for i in free if i not in full]
    return target


def _layers(room: list[int], members: list[tuple[int, ...]], users: list[dict[int, int]], left: list[int]) -> tuple[dict[int, int], dict[int, int], bool]:
    """How far patterns and sources are from words that are still to be sent, and whether a source with room is among them."""
    patterns = {i: 0 for i, r in enumerate(room) if r > 0}
    sources: dict[int, int] = {}
    frontier, depth = list(patterns), 0
    while frontier:
        new = []
        for i in frontier:
            for j in members[i]:
                if j not in sources:
                    sources[j] = depth
                    new.append(j)
        if any(left[j] > 0 for j in new):
            return patterns, sources, True
        frontier, depth = [], depth + 1
        for j in new:
            for i in users[j]:
                if i not in patterns:
                    patterns[i] = depth
                    frontier.append(i)
    return patterns, sources, False


def _block(room: list[int], members: list[tuple[int, ...]], users: list[dict[int, int]], left: list[int], patterns: dict[int, int], sources: dict[int, int]) -> None:
    """A blocking flow along the layers: words go from patterns with room to sources, which may hand a pattern's earlier words on."""
    arcs = {i: iter([j for j in members[i] if sources.get(j) == d]) for i, d in patterns.items()}
    backs = {j: iter([i for i in users[j] if patterns.get(i) == d + 1]) for j, d in sources.items()}
    head, tail = {i: next(a, None) for i, a in arcs.items()}, {j: next(b, None) for j, b in backs.items()}
    for start in [i for i, d in patterns.items() if not d]:
        while room[start] > 0:
            way, i = [], start  # (pattern, source it sends to) so far
            while True:
                j = head[i]
                if j is None:
                    if not way:
                        break
                    _, j = way.pop()  # what j would hand on from i has no way
                    tail[j] = next(backs[j], None)
                    i = way[-1][0] if way else start
                    if way and way[-1][1] == j:
                        way.pop()
                    continue
                if left[j] > 0:
                    way.append((i, j))
                    break
                back = tail[j]
                if back is None:
                    head[i] = next(arcs[i], None)
                elif not users[j].get(back):
                    tail[j] = next(backs[j], None)
                else:
                    way.append((i, j))
                    i = back
            if not way:
                break
            push = min(room[start], left[way[-1][1]], *(users[way[k][1]][way[k + 1][0]] for k in range(len(way) - 1)))
            for k, (a, j) in enumerate(way):
                users[j][a] = users[j].get(a, 0) + push
                if k + 1 < len(way):
                    users[j][way[k + 1][0]] -= push
            room[start] -= push
            left[way[-1][1]] -= push


def min_cost_flow(capacity: list[int], members: list[tuple[int, ...]], quota: list[int], passes: int = 3) -> list[int]:
    """Words that each pattern sends; its k-th pass over its documents costs k a word (0 for the first).

    Only the arcs into patterns cost, so a shortest path costs what the pass of its first arc does: all of a pass is
    sent before any of the next, each by a maximum flow in blocking flows (patterns to sources, and back where a
    source hands on). Patterns of the same members share what theirs sends, in proportion to their words.
    """
    groups: dict[tuple[int, ...], list[int]] = {}
    for i, m in enumerate(members):
        groups.setdefault(tuple(sorted(m)), []).append(i)
    kinds = list(groups)
    words = [sum(capacity[i] for i in groups[m]) for m in kinds]
    users: list[dict[int, int]] = [{} for _ in quota]
    left, sent = list(quota), [0] * len(kinds)
    for _ in range(passes):
        room = list(words)
        while True:
            patterns, sources, found = _layers(room, kinds, users, left)
            if not found:
                break
            _block(room, kinds, users, left, patterns, sources)
            users = [{i: f for i, f in u.items() if f} for u in users]
        sent = [x + w - r for x, w, r in zip(sent, words, room, strict=True)]
    out = [0] * len(capacity)
    for m, total, n in zip(kinds, sent, words, strict=True):
        seen = 0
        for i in groups[m]:
            before, seen = seen, seen + capacity[i]
            # whole passes for all, then what is left by their words
            out[i] = total // n * capacity[i] + (total % n * seen // n - total % n * before // n) if n else 0
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _parts(patterns: DataFrame, sources: DataFrame) -> DataFrame:
    """patterns with _part: patterns that no chain of shared sources joins are of different parts, and their flows have nothing to do with each other."""
    placed = patterns.select("_members", F.posexplode("_members").alias("_at", "_name")).join(sources, F.col("_name").eqNullSafe(F.col("_source")))
    first = placed.groupBy("_members").agg(F.min("_place").alias("_first"))
    joined = placed.join(first.withColumnRenamed("_members", "_m"), F.col("_members").eqNullSafe(F.col("_m"))).where("_place <> _first")
    edges = written(joined.select(F.col("_first").alias("a"), F.col("_place").alias("b")).distinct(), "shared-sources")
    out = patterns.join(first.withColumnRenamed("_members", "_m"), F.col("_members").eqNullSafe(F.col("_m"))).drop("_m")
    if edges.isEmpty():
        return out.withColumnRenamed("_first", "_part")
    roots = components(edges, "a", "b").withColumnRenamed("node", "_first")
    return out.join(roots, "_first", "left").withColumn("_part", F.coalesce("root", "_first")).drop("_first", "root")


def _solved(patterns: DataFrame, sources: DataFrame, passes: int) -> DataFrame:
    """_m (members), _source_size, _target (by member) and _sent (words) of each pattern: one flow for each part, in the task that it is dealt to."""
    parted = _parts(patterns, sources)
    each = parted.select("_part", "_members", "words", F.posexplode("_members").alias("_at", "_name")).join(sources, F.col("_name").eqNullSafe(F.col("_source")))
    told = each.groupBy("_part", "_members", "words").agg(F.array_sort(F.collect_list(F.struct("_at", "_place", "_size", "_goal"))).alias("_s"))  # a pattern's sources
    dealt = told.repartition("_part").sortWithinPartitions("_part", "_members")

    def run(batches):
        for t in blocks(batches, "_part", 1):
            part = t.column("_part").to_numpy()
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            members, words, told = (t.column(c) for c in ("_members", "words", "_s"))
            sent = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                own = told.slice(lo, hi - lo).to_pylist()
                goal = {x["_place"]: x["_goal"] for s in own for x in s}
                at = {p: i for i, p in enumerate(sorted(goal))}
                sent += min_cost_flow(words.slice(lo, hi - lo).to_pylist(), [tuple(at[x["_place"]] for x in s) for s in own], [round(goal[p]) for p in sorted(goal)], passes)
            sizes, goals = ([[x[k] for x in s] for s in told.to_pylist()] for k in ("_size", "_goal"))
            yield pa.RecordBatch.from_arrays([members.combine_chunks(), words.combine_chunks(), pa.array(sizes, pa.list_(pa.int64())), pa.array(goals, pa.list_(pa.float64())), pa.array(sent, pa.int64())], ["_m", "_words", "_source_size", "_target", "_sent"])

    return dealt.select("_part", "_members", "words", "_s").mapInArrow(run, "_m array<string>, _words long, _source_size array<long>, _target array<double>, _sent long")


def mix(docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id", keep: list[str] | None = None, passes: int = 3, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """The keep columns of docs, _size, _members, _source_size and _target (arrays, by member) and _taken, the words the mix takes.

    members: array of a document's sources (null: one source, null). Sources by code point, null last, weigh WEIGHTS
    in turn and share all words by water_fill. _taken is at most passes times _size. Documents of size 0 take 0.
    Reruns agree: the order in a pattern is a seeded hash of the id. Rows that repeat an id are documents of their own.
    The driver holds a row for each source. Patterns are solved where they lie: those that share no source, even
    through others, are flows of their own, each in one task. Documents stay where they are, but for one of buckets
    hash ranges in each pattern, in which the flow ends. Texts of any length count by their size alone. Columns of docs
    with a result's name give way. An empty table gives no rows.
    """
    keep = carried(docs, keep, RESULTS)
    spark = docs.sparkSession
    own = F.coalesce(members, F.array(F.lit(None).cast("string")))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col))
    columns, inner = boxed(docs, keep)
    sized = docs.select(*columns, docs[f"`{id_col}`"].alias("_id"), F.array_sort(F.array_distinct(own)).alias("_members"), size.alias("_size"), hashed.alias("_hash"))
    sized = written(sized.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - int(math.log2(buckets))).cast("int")), "sized")
    parts = sized.groupBy("_members", "_bucket").agg(F.sum("_size").alias("words"))
    patterns = written(parts.groupBy("_members").agg(F.sum("words").alias("words")), "patterns")
    found = patterns.select("words", F.explode("_members").alias("_name")).groupBy("_name").agg(F.sum("words").alias("words")).collect()  # a row for each source
    if not found:
        nothing = sized.select(*inner, "_size", "_members", F.array().cast("array<long>").alias("_source_size"), F.array().cast("array<double>").alias("_target"), F.lit(0).cast("long").alias("_taken"))
        return unboxed(nothing, keep, RESULTS)
    found.sort(key=lambda r: (r["_name"] is None, r["_name"] or ""))
    total = patterns.agg(F.sum("words")).first()[0]
    target = water_fill([r["words"] for r in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))], total, passes)
    sources = spark.createDataFrame([(r["_name"], i, r["words"], float(t)) for i, (r, t) in enumerate(zip(found, target, strict=True))], "_source string, _place long, _size long, _goal double")
    plan = _solved(patterns, sources, passes)
    whole = F.when(F.col("_words") > 0, F.floor(F.col("_sent") / F.col("_words"))).otherwise(0).cast("long")
    plan = written(plan.withColumn("_whole", whole).withColumn("_rest", F.col("_sent") - F.col("_whole") * F.col("_words")).drop("_words", "_sent"), "plan")
    before = Window.partitionBy("_m").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_members").eqNullSafe(F.col("_m"))
    sent = F.broadcast(plan) if plan.count() <= MOST_SENT else plan.hint("merge")
    starts = parts.join(sent, same).withColumn("_start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = starts.where((F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("words"))).select(F.col("_m").alias("_q"), F.col("_bucket").alias("_end"), "_start")
    told = written(plan.join(ends, F.col("_m").eqNullSafe(F.col("_q")), "left").drop("_q"), "plan")  # a row for each pattern
    dealt = sized.join(F.broadcast(told) if told.count() <= MOST_SENT else told.hint("merge"), same)
    base = F.col("_whole") * F.col("_size")
    out = [*inner, "_size", "_members", "_source_size", "_target"]
    plain = dealt.where(F.col("_end").isNull() | (F.col("_bucket") != F.col("_end"))).select(*out, (base + F.when(F.col("_bucket") < F.col("_end"), F.col("_size")).otherwise(0)).cast("long").alias("_taken"))
    order = Window.partitionBy("_m").orderBy("_hash", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    edge = dealt.where(F.col("_bucket") == F.col("_end")).withColumn("_seen", F.col("_start") + F.coalesce(F.sum("_size").over(order), F.lit(0)))
    edge = edge.select(*out, (base + F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_seen")))).cast("long").alias("_taken"))
    return unboxed(plain.unionByName(edge), keep, RESULTS)


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, **more) -> DataFrame:
    """mix for documents of one source each: the keep columns, size, source_size, target and taken."""
    keep = [id_col] if keep is None else keep
    mixed = mix(docs, F.array(F.col(source_col).cast("string")), word_count(F.col(text_col)), id_col, keep, **more)
    return mixed.select(*keep, F.col("_size").alias("size"), F.col("_source_size")[0].alias("source_size"), F.col("_target")[0].alias("target"), F.col("_taken").alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes of a document: whole ones only, a part counts from a half up."""
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(copies > 0).drop("_copy", "size", "source_size", "target", "taken")
