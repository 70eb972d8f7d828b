"""SimHash near-dedup by the generalised pigeonhole.

A fingerprint has 64 bits. Two that differ in at most t bits, cut into m partitions with thresholds T1..Tm whose sum
is t - m + 1, differ in at most Ti bits in some partition i (a threshold of -1 leaves a partition out). Correlated
bits go into the same partition; thresholds come from dynamic programming on the candidate pairs that each
(partition, threshold) would make, estimated from the bit frequencies and correlations of all fingerprints. Every
distinct fingerprint is dealt to the keys of its partitions (for a threshold of one: the value with each bit left out
in turn); in each bucket the fingerprints are compared and leave a spanning forest of their links, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.shared import blocks, lean, small_batches, words, written

BITS = 64
#: Fingerprints of a bucket that one task compares; a fuller one is dealt again (links).
MOST = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of size words (fewer words: of all of them), A-Z lower-cased, repeats included."""
    from xxhash import xxh64_intdigest

    own = [w.encode("utf-8", "surrogatepass").translate(_LOWER) for w in words(text)]
    if not own:
        return np.zeros(0, np.uint64)
    raw = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(own))
    return np.fromiter((xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(own) - k + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """The keep columns of docs and fp (long: the fingerprint's 64 bits, signed); a column of docs with that name gives way."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "fp"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    @lean
    def run(batches):
        for b in batches:
            fps = np.asarray([simhash(shingle_hashes(t, shingle)) for t in b.column("__text__").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, F.col(text_col).alias("__text__")).mapInArrow(run, f"{kinds}, fp bigint")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits i and j set: 64 x 64 counts, summed over all rows."""

    @lean
    def run(batches):
        total, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = np.unpackbits(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(x), 1 << 16):
                both += np.rint(x[i : i + (1 << 16)].T @ x[i : i + (1 << 16)]).astype(np.int64)
            total += len(x)
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(BITS * BITS + 1), pa.int32()), "n": np.append(both.ravel(), total)})

    rows = fps.select("fp").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    out = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        out[r["i"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each starts at the free bit most correlated with others and takes its closest."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        own = [max(sorted(free), key=lambda i: sum(corr[i, j] for j in free))]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda i: sum(corr[i, j] for j in own))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def estimated_pairs(bits: list[int], both: np.ndarray, n: int, threshold: int) -> float:
    """Pairs that differ in at most threshold of these bits, by a chain of each bit on the closest one before it."""
    if threshold < 0:
        return 0.0
    p = np.diag(both) / max(n, 1)
    same = []
    for k, i in enumerate(bits):
        agree = p[i] ** 2 + (1 - p[i]) ** 2
        if k:
            p11 = np.array([both[i, j] / max(n, 1) for j in bits[:k]])
            q = np.array([p[j] for j in bits[:k]])
            joint = p11**2 + (p[i] - p11) ** 2 + (q - p11) ** 2 + (1 - p[i] - q + p11) ** 2
            agree = max(agree, float(np.max(joint / np.maximum(q**2 + (1 - q) ** 2, 1e-12))))
        same.append(min(agree, 1.0))
    chance = np.zeros(threshold + 1)
    chance[0] = 1.0
    for a in same:
        chance = chance * a + np.concatenate([[0.0], chance[:-1]]) * (1 - a)
    return n * n / 2 * float(chance.sum())


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (cost[i][T + 1] for T = -1, 0, 1) that sum to total at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for have, (c, ts) in best.items():
            for k, x in enumerate(row):
                t = have + k - 1
                if t not in new or c + x < new[t][0]:
                    new[t] = (c + x, [*ts, k - 1])
        best = new
    return best[total]


def plan_partitions(both: np.ndarray, n: int, distance: int, per_key: float = 40.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions used: the cheapest by pairs to compare plus keys to deal (per_key pairs each)."""
    plans = []
    for m in range(max(1, (distance + 2) // 2), min(8, distance + 2) + 1):
        parts = group_bits(both, n, m)
        cost = [[0.0, estimated_pairs(b, both, n, 0) + per_key * n, estimated_pairs(b, both, n, 1) + per_key * n * len(b)] for b in parts]
        if -m <= distance - m + 1 <= m:
            c, ts = allocate(cost, distance - m + 1)
            plans.append((c, [(b, t) for b, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def keys_of(fps: np.ndarray, plan: list[tuple[list[int], int]]) -> list[np.ndarray]:
    """A uint64 key for each fingerprint, one array for each partition and, at threshold 1, for each bit left out."""
    out = []
    for k, (bits, threshold) in enumerate(plan):
        for left in [None] if threshold == 0 else bits:
            mask = np.uint64(sum(1 << b for b in bits if b != left))
            salt = np.uint64(((k * 65 + (0 if left is None else left + 1)) * 0x9E3779B97F4A7C15) % (1 << 64))
            x = (fps & mask) ^ salt
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            out.append((x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53) ^ salt)
    return out


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each found one leaves the rest, so a dense group costs little."""
    out, rest = [], fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                out.extend((x, y) for y in found)
                frontier.extend(found)
    return out


def links(distinct: DataFrame, distance: int = 3, plan: list | None = None, most: int | None = None) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp) at most distance bits apart, whose components are those of all links.

    A bucket of more than most fingerprints (MOST) is dealt again by distance + 1 parts of the bits that its key leaves
    open: two that differ in at most distance bits agree in one of them.
    """
    most = MOST if most is None else most
    if plan is None:
        n, both = bit_statistics(distinct)
        plan = plan_partitions(both, n, distance)

    def deal(batches):
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            ks = keys_of(fps, plan)
            part = np.repeat(np.arange(len(ks), dtype=np.int32), len(fps))
            yield pa.RecordBatch.from_pydict({"key": np.concatenate(ks).view(np.int64), "fp": np.tile(fps, len(ks)).view(np.int64), "part": part})

    open_bits = [[b for b in range(BITS) if b not in bits] for bits, threshold in plan for _ in range(1 if threshold == 0 else len(bits))]

    def deal_again(batches):
        for b in batches:
            key, fps, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "part"))
            fps, out = fps.view(np.uint64), []
            for p in np.unique(part).tolist():
                at = part == p
                for sub in np.array_split(np.asarray(open_bits[p]), distance + 1):
                    mask = np.uint64(sum(1 << int(x) for x in sub))
                    x = (fps[at] & mask) ^ key[at].view(np.uint64) ^ mask
                    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                    out.append((x ^ (x >> np.uint64(33)), fps[at]))
            if out:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate([x for x, _ in out]).view(np.int64), "fp": np.concatenate([x for _, x in out]).view(np.int64)})

    @lean
    def match(batches):
        for t in blocks(batches, "key", 65_536):
            yield from _matched(t.column("key").to_numpy(), t.column("fp").to_numpy(), distance)

    dealt = distinct.select("fp").mapInArrow(deal, "key bigint, fp bigint, part int")
    crowded = written(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("key").alias("k")), "crowded")
    if not crowded.isEmpty():
        inside = dealt.join(crowded.hint("merge"), F.col("key") == F.col("k"), "left_semi").mapInArrow(deal_again, "key bigint, fp bigint")
        dealt = dealt.join(crowded.hint("merge"), F.col("key") == F.col("k"), "left_anti").select("key", "fp").unionByName(inside)
    else:
        dealt = dealt.select("key", "fp")
    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(match, "a bigint, b bigint").distinct()


def _matched(key: np.ndarray, fp: np.ndarray, distance: int):
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    fps = fp.view(np.uint64)
    edges = []
    small = np.repeat(sizes, sizes) <= 64
    for lag in range(1, int(min(64, sizes.max()))):
        same = (key[lag:] == key[:-lag]) & small[lag:]
        if not same.any():
            break
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= distance]
        if len(i):
            edges.append(np.stack([fp[i], fp[i + lag]]))
    for s, z in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        if found := forest(np.unique(fps[s : s + z]), distance):
            edges.append(np.asarray(found, np.uint64).T.view(np.int64))
    if edges:
        a, b = np.concatenate(edges, 1)
        yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, distance: int = 3, shingle: int = 3) -> DataFrame:
    """The keep columns of docs (default: the id), fp, and component_id, the smallest id reachable over links, its own included.

    Documents link if their fingerprints differ in at most distance bits; equal ones always do. Nulls: a null or
    empty text has fingerprint 0 and links like any other; a null id is never the smallest unless all are null.
    Repeated rows stay rows of one component. Texts of any length count whole. An empty table gives no rows. Columns
    of docs that are called fp or component_id give way to the results.
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in ("fp", "component_id")]
    at = written(fingerprints(docs, text_col, list(dict.fromkeys([*keep, id_col])), shingle), "fingerprints")
    return at.join(classes(at, id_col, distance).select("fp", "component_id"), "fp").select(*keep, "fp", "component_id")


def classes(at: DataFrame, id_col: str, distance: int) -> DataFrame:
    """fp, component_id, root (the component's smallest fingerprint) of each distinct fingerprint of at."""
    distinct = written(at.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    edges = links(distinct, distance)
    own = components(edges, "a", "b")
    named = distinct.join(own.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(named.select("fp", "root", "first").join(least, "root").select("fp", "component_id", "root", "first"), "classes")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (of rows that repeat it the least by all columns)."""
    names = [c for c in docs.columns if c.lower() != "fp"]
    at = written(fingerprints(docs, text_col, names, shingle), "fingerprints")
    found = classes(at, id_col, distance).where(F.col("first").eqNullSafe(F.col("component_id")))
    first = found.groupBy("root").agg(F.min(F.struct("fp", "component_id")).alias("x")).select(F.col("x.fp").alias("_fp"), F.col("x.component_id").alias("_id"))
    kept = at.join(first, (F.col("fp") == F.col("_fp")) & F.col(id_col).eqNullSafe(F.col("_id")))
    return least_rows(kept, "fp", names)


def least_rows(kept: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row of each key, the least by all names; where no key repeats no text is moved."""
    if kept.groupBy(key).count().where("count > 1").isEmpty():
        return kept.select(*names)
    return kept.groupBy(key).agg(F.min(F.struct(*names)).alias("_least")).select("_least.*")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
