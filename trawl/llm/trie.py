"""Prefix trie of conversations: a node for each distinct sequence of first turns, from the root of no turns.

Turns are range-sorted by conversation, so one with very many turns is many partitions (ragged.py). What names a node
is a digest of its turns that no partitioning changes: the digests of the largest aligned runs of 8 ** L turns that
make up the prefix, with its length. So a partition in the middle of a conversation needs only the few runs before it.
Each partition combines the nodes that it meets into a partial trie; partial tries are merged by node, counts and
members' ends alike. Subtree sums go up chains: all nodes with the same smallest member are one path, cut into blocks
of depths; and chains hang on chains, whose totals come by pointer doubling, in rounds of the logarithm of their depth.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.ragged import BITS, FAN, climb, finish, largest, range_sorted, stretches, with_spans
from trawl.llm.shared import lean, small_batches, written

#: Nodes and ends of a partial trie before it is sent and a new one begun.
MOST = 100_000
#: Partial tries that one merge brings together.
MERGED = 1024
#: Depths of a chain that are summed together.
SPAN = 4096

ROOT = hashlib.sha256(b"root").digest()


def combine(kids: list[bytes]) -> bytes:
    return hashlib.sha256(b"run" + b"".join(kids)).digest()


class Prefix:
    """The names of growing prefixes; runs holds, level by level, the digests of the runs that no larger one holds."""

    def __init__(self, length: int = 0, runs: list[list[bytes]] | None = None):
        self.length, self.runs = length, runs or [[]]

    def add(self, turn: bytes) -> None:
        self.length += 1
        level, x = 0, turn
        while True:
            if level == len(self.runs):
                self.runs.append([])
            self.runs[level].append(x)
            if len(self.runs[level]) < FAN:
                return
            x, self.runs[level] = combine(self.runs[level]), []
            level += 1

    @property
    def name(self) -> bytes:
        if not self.length:
            return ROOT
        return hashlib.sha256(b"prefix" + self.length.to_bytes(8, "little") + b"".join(x for r in reversed(self.runs) for x in r)).digest()


def shared_turns(conv: int, most: int = 6) -> int:
    """How many first turns a conversation takes from its base, unless told otherwise."""
    return zlib.crc32(str(conv).encode()) % most


def rebuilt(turns: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """turns (grp, turn, digest, chars) as own rows (kind 1), and before them the first `shared` rows (most at most) of the conversation base names (kind 0)."""
    first = Window.partitionBy("grp").orderBy("turn", "digest")
    heads = turns.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)  # cut in each task before it is shuffled
    bases = turns.select("grp").distinct().select("grp", base.alias("_base"), shared.alias("_shared"))
    lent = bases.join(heads.select(F.col("grp").alias("_base"), "_n", "digest", "chars"), "_base").where(F.col("_n") <= F.col("_shared"))
    lent = lent.select("grp", F.lit(0).alias("kind"), F.col("_n").cast("long").alias("turn"), "digest", "chars")
    return lent.unionByName(turns.select("grp", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "digest", "chars"))


def _place(rank: int, lent: int, shared: int) -> int:
    """Rebuilt turns among the first rank rows, of which lent are another's and the next shared own ones are left out."""
    return rank if rank <= lent else max(lent, rank - shared)


def _peaks(spanned: DataFrame) -> DataFrame:
    """part and runs (level, idx, hash) of the prefix before it, for the partitions that begin inside a conversation."""
    cut = spanned.where(F.col("total").isNotNull())
    columns = ["grp", "start", "total", "kind", "digest", "lent", "shared", "part"]

    @lean
    def local(batches):
        for grp, first, total, held in stretches(batches, columns):
            lent, shared, part = held[0][2:5]
            at, end = _place(first, lent, shared), _place(first + len(held), lent, shared)
            kept = [r[1] for k, r in enumerate(held, first) if k < lent or k >= lent + shared]
            assert len(kept) == end - at
            out = list(largest(climb(kept, at, None, combine))) if kept else []
            yield pa.RecordBatch.from_pydict(
                {"grp": pa.array([grp] * len(out), pa.int64()), "total": pa.array([total] * len(out), pa.int64()), "part": pa.array([part] * len(out), pa.int32()), "level": pa.array([x[0] for x in out], pa.int32()), "idx": pa.array([x[1] for x in out], pa.int64()), "hash": pa.array([x[2] for x in out], pa.binary())}
            )

    ragged = written(cut.select(*columns).mapInArrow(local, "grp bigint, total bigint, part int, level int, idx bigint, hash binary"), "runs")
    most = ragged.agg(F.max("total")).first()[0]
    spark = spanned.sparkSession
    if most is None:
        return spark.createDataFrame([], "part int, runs array<struct<level:int,idx:bigint,hash:binary>>")
    nodes = finish(ragged, most, combine, ragged_end=False).select("grp", "level", "idx", "hash")
    before = F.when(F.col("start") <= F.col("lent"), F.col("start")).otherwise(F.greatest("lent", F.col("start") - F.col("shared")))
    starts = cut.where(F.col("start") > 0).groupBy("part", "grp").agg(F.first(before).alias("at"))
    top = 1
    while FAN**top <= most:
        top += 1
    level = starts.select("part", "grp", "at", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    low, high = F.expr(f"shiftleft(shiftright(at, {BITS} * (level + 1)), {BITS})"), F.expr(f"shiftright(at, {BITS} * level)")
    wanted = level.where(high > low).select("part", "grp", "level", F.explode(F.sequence(low, high - 1)).alias("idx"))
    found = wanted.join(nodes, ["grp", "level", "idx"])
    return found.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("level", "idx", "hash"))).alias("runs"))  # FAN - 1 of a level at most


def partial_tries(turns: DataFrame) -> DataFrame:
    """Nodes of each partition's partial trie: node, parent, depth, chars (of the last turn), conv_id (smallest member),
    n_convs, ends (decimal ids of the members that end here, ascending, comma-joined, or null), and order (part, piece)."""
    dealt = range_sorted(turns.withColumn("shared", F.col("shared").cast("int")), ["grp", "kind", "turn", "digest"])
    spanned = with_spans(dealt, lent=F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)))
    begun = _peaks(spanned)
    rows = spanned.join(F.broadcast(begun.withColumnRenamed("part", "_part")), F.col("part") == F.col("_part"), "left")
    columns = ["grp", "start", "total", "kind", "digest", "chars", "lent", "shared", "part", "runs"]

    @lean
    def gather(batches):
        trie: dict[bytes, list] = {}
        state = {"conv": None, "prefix": Prefix(), "rank": 0, "lent": 0, "piece": 0, "part": 0, "ends": 0}

        def meet(name, parent, depth, chars, conv, fresh):
            node = trie.get(name)
            if node is None:
                trie[name] = [parent, depth, chars, conv, int(fresh), []]
            elif fresh:
                node[4] += 1

        def sent() -> Iterator[pa.RecordBatch]:
            piece, state["piece"], state["ends"] = state["piece"], state["piece"] + 1, 0
            items = list(trie.items())
            trie.clear()
            for i in range(0, len(items), 8192):
                some = items[i : i + 8192]
                yield pa.RecordBatch.from_pydict(
                    {"node": pa.array([k for k, _ in some], pa.binary()), "parent": pa.array([v[0] for _, v in some], pa.binary()), "depth": pa.array([v[1] for _, v in some], pa.int64()), "chars": pa.array([v[2] for _, v in some], pa.int64()), "conv_id": pa.array([v[3] for _, v in some], pa.int64()),
                     "n_convs": pa.array([v[4] for _, v in some], pa.int64()), "ends": pa.array([",".join(map(str, v[5])) if v[5] else None for _, v in some], pa.string()), "part": pa.array([state["part"]] * len(some), pa.int32()), "piece": pa.array([piece] * len(some), pa.int32())}
                )

        def over(last):
            """The conversation's last row here has passed; last: it has none elsewhere."""
            if last:
                trie.setdefault(state["prefix"].name, [None, state["prefix"].length, 0, state["conv"], 0, []])[5].append(state["conv"])
                state["ends"] += 1

        for grp, first, total, held in stretches(batches, columns):
            lent_all, shared, part, runs = held[0][3:7]
            state["part"] = part
            if state["conv"] != grp:
                levels: list[list[bytes]] = [[]]
                for r in runs if first and runs else ():
                    while len(levels) <= r["level"]:
                        levels.append([])
                    levels[r["level"]].append(r["hash"])
                lent = lent_all if total is not None else sum(r[0] == 0 for r in held)
                at = _place(first, lent, shared)
                state |= {"conv": grp, "prefix": Prefix(at, levels), "rank": first, "lent": lent}
                if not first:
                    meet(ROOT, None, 0, 0, grp, True)
            prefix, lent = state["prefix"], state["lent"]
            for kind, digest, chars, *_ in held:
                rank = state["rank"]
                state["rank"] += 1
                if rank >= lent and rank < lent + shared:
                    continue
                parent = prefix.name
                prefix.add(digest)
                meet(prefix.name, parent, prefix.length, chars, grp, True)
                if len(trie) >= MOST:
                    yield from sent()
            whole = total if total is not None else first + len(held)
            if state["rank"] == whole:
                over(True)
            if len(trie) + state["ends"] >= MOST:
                yield from sent()
        if trie:
            yield from sent()

    return rows.select(*columns).mapInArrow(gather, "node binary, parent binary, depth bigint, chars bigint, conv_id bigint, n_convs bigint, ends string, part int, piece int")


def merged(partial: DataFrame, parts: int) -> DataFrame:
    """Partial nodes summed by node, MERGED partial tries at a time, round after round."""

    def together(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy("node", *by).agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))

    rows = partial.drop("ends", "piece")
    while parts > MERGED:
        rows = together(rows.withColumn("part", F.floor(F.col("part") / MERGED).cast("int")), "part")
        parts = -(-parts // MERGED)
    return together(rows.drop("part"))


def end_digests(partial: DataFrame) -> DataFrame:
    """node and ends_sha256. Partitions hold ascending conversations, so a node's lists, in their order, are one
    ascending list; its digest reads them as they come and holds one at a time."""

    def digest(batches):
        node, held = None, None
        for b in batches:
            names, sums = [], []
            for n, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if n != node:
                    if held is not None:
                        names.append(node)
                        sums.append(held.hexdigest())
                    node, held = n, hashlib.sha256(ends.encode())
                else:
                    held.update(b",")
                    held.update(ends.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.binary()), "ends_sha256": pa.array(sums, pa.string())})
        if held is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([held.hexdigest()], pa.string())})

    lists = partial.where(F.col("ends").isNotNull()).select("node", "part", "piece", "ends")
    return lists.repartition("node").sortWithinPartitions("node", "part", "piece").mapInArrow(digest, "node binary, ends_sha256 string")


def chain_totals(chains: DataFrame, sums: list[str]) -> DataFrame:
    """chains (conv_id, up: the chain it hangs on or null, and sums) with each sum over all chains below it too.

    Doubling: after k rounds a chain has the sums of the chains up to 2 ** k - 1 below it, and up is the one 2 ** k above.
    """
    rows = written(chains.select("conv_id", "up", *sums), "chains")
    while not rows.where(F.col("up").isNotNull()).isEmpty():
        below = rows.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("conv_id")).agg(*(F.sum(s).alias(f"_{s}") for s in sums))
        above = rows.select(F.col("conv_id").alias("up"), F.col("up").alias("_up")).where(F.col("_up").isNotNull())
        rows = rows.join(below, "conv_id", "left").join(above, "up", "left")
        rows = written(rows.select("conv_id", F.col("_up").alias("up"), *((F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums)), "chains")
    return rows.select("conv_id", *sums)


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id, n_children, n_leaves and saved_tokens to nodes (node, parent, depth, chars, conv_id, n_convs)."""
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    sums = ["leaves", "saved"]
    # All nodes of one smallest member are one path; the first of them hangs on a node of another.
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"), F.min_by("parent", "depth").alias("parent"), *(F.sum(s).alias(s) for s in sums))
    hung = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"), F.col("depth").alias("up_depth"))
    chains = written(chains.join(hung, "parent", "left").select("conv_id", "depth", "up", "up_depth", *sums), "chains")
    totals = chain_totals(chains, sums)
    # What hangs on a node counts there, then all sums run from the chain's end upwards.
    added = chains.where(F.col("up").isNotNull()).select("conv_id", "up", "up_depth").join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("up_depth").alias("depth")).agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    held = nodes.join(added, ["conv_id", "depth"], "left").withColumns({s: F.col(s) + F.coalesce(f"_{s}", F.lit(0)) for s in sums}).drop(*(f"_{s}" for s in sums))
    held = written(held.withColumn("block", F.floor(F.col("depth") / SPAN)), "nodes")
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy("conv_id", "block").agg(*(F.sum(s).alias(f"_{s}") for s in sums)).withColumns({f"_{s}": F.coalesce(F.sum(f"_{s}").over(deeper), F.lit(0)) for s in sums})
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    heads = chains.select("conv_id", F.col("depth").alias("_first"), "up")
    return (
        held.withColumns({s: F.sum(s).over(inside) for s in sums})
        .join(blocks, ["conv_id", "block"])
        .withColumns({s: (F.col(s) + F.col(f"_{s}")).cast("long") for s in sums})
        .join(heads, "conv_id")
        .withColumn("parent_conv_id", F.when(F.col("depth") > F.col("_first"), F.col("conv_id")).otherwise(F.col("up")))
        .select("node", "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    )


def prefix_trie(conversations: DataFrame, base: Column | None = None, shared: Column | None = None, most: int = 5, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. (conv_id, depth) names a node.

    base and shared: columns over `grp` (the conversation), for conversations whose first turns are taken from another:
    its base's first `shared` turns (most at most) stand before its own turns after as many. Without them each is as it stands.

    Nulls: a null turn comes first; null roles and texts are empty; rows of a null conversation take no part. Turns of
    the same number stand by their digests, so repeated rows are turns of their own. A very long text counts by its
    digest; its characters are counted, never shuffled. A conversation of any number of turns is many partitions. An
    empty table gives no rows (there is no root without a member). Other columns are not read.
    """
    small_batches(conversations.sparkSession, 4096)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("grp"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    if base is None or shared is None:
        rows = turns.withColumns({"kind": F.lit(1), "shared": F.lit(0)})
    else:
        rows = rebuilt(written(turns, "turns"), base, shared, most).withColumn("shared", shared)
    partial = written(partial_tries(rows), "tries")
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    nodes = rolled_up(merged(partial, parts))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(end_digests(partial), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("node")


def brute_trie(rows: list[tuple], head=None) -> set[tuple]:
    """The nodes in plain Python, for tests. head(conv): (base, how many) or None."""
    own: dict = {}
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest(role or "", text or ""), role or "", text or ""))
    for v in own.values():
        v.sort(key=lambda r: r[:2])
    built = {}
    for c, v in own.items():
        b, h = head(c) if head else (None, 0)
        built[c] = [r[2:] for r in own.get(b, [])[:h]] + [r[2:] for r in v[h:]]
    members: dict = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children: dict = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = set()
    sums = {}
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        kids = children.get(k, [])
        saved = (len(m) - 1) * (len(k[-1][1]) if k else 0) + sum(sums[x][1] for x in kids)
        leaves = sum(sums[x][0] for x in kids) if kids else 1
        sums[k] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out
