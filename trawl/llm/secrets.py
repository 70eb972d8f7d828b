"""Secret scans, in DataFrame functions only: known shapes and a battery of randomness tests.

Base spans are known shapes: assignments, access keys, long hex runs. The battery looks at every run of 20 or more
characters of the base64 and URL alphabets. It infers the encoding (hex, base32, lower-case, lower-case with digits,
base64) and tests whether the symbols could be drawn at random from it: chi-squared uniformity, runs above and below
the middle of the alphabet, lag-1 serial correlation. A run that no test rejects is weighed against ordinary text:
how often the class of characters changes, and how often symbols collide. The two bounds are combined (Fisher), and
in each class of lengths the Benjamini-Hochberg step keeps the share of false discoveries below q; the p-values of
all rows enter as counts in bins of a tenth of a decade.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.shared import carried, written

#: Fixed values of the contract: the kinds in their order, what a match is, and which matches stay.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS, HEX, CANDIDATE = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
#: Chance that ordinary text changes its class of characters at a place, and that two of its characters are equal.
TEXT_CHANGE, TEXT_COLLISION = 0.08, 0.075
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "abcdefghijklmnopqrstuvwxyz", "alnum": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
BINS = 400
#: Matches of one text that are counted off together, in groups of groups.
SIZES = (4096, 64)


def _let(value: Column, body) -> Column:
    """body of value, which is computed once: a lambda's variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _groups(values: Column, size: int) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(values, g * size + 1, F.lit(size)))


def _before(values: Column, op, sizes: tuple[int, ...] = SIZES) -> Column:
    """For each place of an array of ints, op (a sum or a maximum, from 0) over what stands before it.

    A fold that gathers an array copies it at each step, so only the last of sizes, and the groups' totals, are folded.
    """
    zero = F.lit(0)
    if not sizes:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def run(v):
        inner = F.transform(_groups(v, sizes[0]), lambda g: F.struct(_before(g, op, sizes[1:]).alias("own"), F.aggregate(g, zero, op).alias("total")))
        bases = lambda i: _before(F.transform(i, lambda x: x["total"]), op, ())
        return _let(inner, lambda i: F.flatten(F.zip_with(i, bases(i), lambda x, base: F.transform(x["own"], lambda y: op(base, y)))))

    return _let(values, run)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _cut(text: Column, base: Column, cuts: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """The parts from..to of text, whose first character is at base. A part is counted off from the start of its group's text."""
    if not sizes:
        return F.transform(cuts, lambda c: F.substring(text, c["from"] - base + 1, c["to"] - c["from"]))

    def one(g):
        first, last = g[0]["from"], F.element_at(g, -1)["to"]
        return F.struct(F.substring(text, first - base + 1, last - first).alias("text"), first.alias("base"), g.alias("cuts"))

    return F.flatten(F.transform(F.transform(_groups(cuts, sizes[0]), one), lambda b: _cut(b["text"], b["base"], b["cuts"], sizes[1:])))


def _positions(text: Column, pattern: str, hint: Column, keep=None) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, by code points.

    Each find starts where the last one ended (\\G), takes the gap, then the match: linear in the text.
    """
    groups = r"\G(?s:(.*?))(" + pattern + ")"
    gaps, hits = (F.regexp_extract_all(text, F.lit(groups), F.lit(i)) for i in (1, 2))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    found = F.zip_with(gaps, hits, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size"), b.alias("hit")))

    def placed(f):
        before = _before(F.transform(f, lambda x: x["gap"] + x["size"]), _sum)
        return F.zip_with(f, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit")))

    out = _let(found, placed)
    return F.when(hint, out if keep is None else F.filter(out, lambda x: keep(x["hit"]))).otherwise(none)


def _encoding(s: Column) -> Column:
    return (
        F.when(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(s.rlike("^[A-Z2-7]+$"), "base32")
        .when(s.rlike("^[a-z]+$"), "lower")
        .when(s.rlike("^[a-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def _by_encoding(encoding: Column, per_name) -> Column:
    out = per_name("base64", ALPHABETS["base64"])
    for name, alphabet in ALPHABETS.items():
        if name != "base64":
            out = F.when(encoding == name, per_name(name, alphabet)).otherwise(out)
    return out


def _folded(s: Column, encoding: Column) -> Column:
    """Without padding; hex in lower case; URL symbols as those of base64."""
    bare = F.regexp_replace(s, "=", "")
    return F.when(encoding == "hex", F.lower(bare)).when(encoding == "base64", F.translate(bare, "-_", "+/")).otherwise(bare)


def _battery(t: Column) -> Column:
    """start, end, length class, whether a random draw is plausible, and log10 of the bound on the p-value under ordinary text."""
    s, n, k = t["s"], t["n"], t["k"]
    chars = F.split(s, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s, c, F.lit(""))), 2))
    chi = squares * k / n - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    halves = t["halves"]
    high = F.length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double")
    low = n - high
    expected = 2 * low * high / n + 1
    spread = F.greatest((expected - 1) * (expected - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
    z_runs = F.when((low == 0) | (high == 0), F.sqrt(n)).otherwise((F.regexp_count(halves, F.lit("0+|1+")) - expected) / F.sqrt(spread))
    mid, variance, v = (k - 1) / 2, (k * k - 1) / 12, t["values"]
    lagged = F.aggregate(F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), lambda a, b: (a - mid) * F.coalesce(b - mid, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    z_serial = lagged / (variance * F.sqrt(n - 1))
    limit = math.sqrt(2 * math.log(6 / 1e-3))  # three tests, one in a thousand random runs rejected
    plausible = (z_chi < limit) & (F.abs(z_runs) < limit) & (F.abs(z_serial) < limit)
    share = (F.regexp_count(t["classes"], F.lit(r"(.)\1*")) - 1) / (n - 1)
    inner = F.least(F.greatest(share, F.lit(1e-9)), F.lit(1 - 1e-9))
    q = TEXT_CHANGE
    kl = inner * F.log(inner / q) + (1 - inner) * F.log((1 - inner) / (1 - q))
    ln_changes = F.when(share > q, -(n - 1) * kl).otherwise(0.0)
    collisions = (squares - n) / (n * (n - 1))
    z_text = (TEXT_COLLISION - collisions) / F.sqrt(2 * TEXT_COLLISION * (1 - TEXT_COLLISION) / (n * (n - 1)))
    ln_collisions = F.when(z_text > 0, -z_text * z_text / 2).otherwise(0.0)
    both = ln_changes + ln_collisions
    ln_p = both + F.log(1 - both)  # Fisher: x (1 - ln x) for two independent p-values with product x
    return F.struct(
        t["start"].alias("start"),
        t["end"].alias("end"),
        F.least(F.floor(F.log2(n)), F.lit(12)).cast("int").alias("length_class"),
        plausible.alias("plausible"),
        F.least(F.floor(-ln_p / math.log(10) * 10), F.lit(BINS)).cast("int").alias("bin"),
    )


def _tested(found: Column) -> Column:
    bare = F.transform(found, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.regexp_replace(t["hit"], "=", "").alias("hit")))
    some = F.filter(bare, lambda t: F.length(t["hit"]) >= 16)
    named = F.transform(some, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["hit"].alias("hit"), _encoding(t["hit"]).alias("e")))
    plain = F.transform(named, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["e"].alias("e"), _folded(t["hit"], t["e"]).alias("s")))
    lower, upper, digit = ALPHABETS["lower"], ALPHABETS["lower"].upper(), "0123456789"
    ready = F.transform(
        plain,
        lambda t: F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            t["s"].alias("s"),
            F.length(t["s"]).cast("double").alias("n"),
            _by_encoding(t["e"], lambda _, a: F.lit(float(len(a)))).alias("k"),
            _by_encoding(t["e"], lambda _, a: F.transform(F.split(t["s"], ""), lambda c: (F.position(c, F.lit(a)) - 1).cast("double"))).alias("values"),
            _by_encoding(t["e"], lambda _, a: F.translate(t["s"], a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))).alias("halves"),
            F.translate(t["s"], lower + upper + digit + "/", "a" * 26 + "A" * 26 + "0" * 10 + "+").alias("classes"),
        ),
    )
    return F.transform(ready, _battery)


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _base (spans of known shapes, array<struct<start, kind, end>>) and _tested."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = _positions(text, ASSIGN, text.rlike(ASSIGN_HINT), keep=lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6)
    access = _positions(text, ACCESS, F.contains(text, F.lit("AKIA")))
    runs = _positions(text, HEX, text.rlike(HEX))
    tokens = _positions(text, CANDIDATE, text.rlike(CANDIDATE))
    found = docs.select(*docs.columns, assign.alias("__assign__"), access.alias("__access__"), runs.alias("__hex__"), tokens.alias("__tokens__"))
    as_spans = lambda c, kind: F.transform(F.col(c), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    base = F.array_sort(F.concat(as_spans("__assign__", 0), as_spans("__access__", 1), as_spans("__hex__", 2)))
    return found.select(*docs.columns, base.alias("__base__"), _tested(F.col("__tokens__")).alias("__tested__"))


def _limits(tested: DataFrame, q: float) -> DataFrame:
    """The smallest bin that Benjamini-Hochberg accepts, for each length class: at most 13 rows, from all rows' counts."""
    each = tested.select(F.explode("__tested__").alias("t")).select("t.length_class", "t.bin")
    counts = each.groupBy("length_class", "bin").count()
    own = Window.partitionBy("length_class")
    from_here = own.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_m", F.sum("count").over(own)).withColumn("_r", F.sum("count").over(from_here))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("_m") <= q * F.col("_r"))
    return passed.groupBy("length_class").agg(F.min("bin").alias("least"))


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, q: float = 0.01) -> DataFrame:
    """The keep columns of docs (default: all) and secrets, array<struct<start, kind, end>> by start, then kind.

    Kind counts into KINDS; start and end are code points, end exclusive. A random run that a base span holds is
    not listed again. Nulls: a null text counts as empty and has no spans. Each row is scanned on its own, whole;
    repeated rows get the same spans, an empty table gives no rows. Columns of any other name are carried,
    whatever it is; one called secrets gives way.
    """
    keep = carried(docs, keep, ("secrets",))
    # The caller's columns travel in one struct, so no name of theirs meets one of these.
    own = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(0)
    held = written(_scanned(docs.select(own.alias("__kept__"), F.col(f"`{text_col}`").alias("__text__")), "__text__").drop("__text__"), "secrets")
    limits = _limits(held, q).agg(F.map_from_entries(F.collect_list(F.struct("length_class", "least"))).alias("__limits__"))  # one row
    judged = held.join(F.broadcast(limits), F.lit(True), "left")
    passed = F.filter("__tested__", lambda t: t["plausible"] & (t["bin"] >= F.coalesce(F.try_element_at("__limits__", t["length_class"]), F.lit(BINS + 1))))
    free = F.filter(passed, lambda t: ~F.exists("__base__", lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"])))
    extra = F.transform(free, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    found = judged.select("__kept__", F.array_sort(F.concat("__base__", extra)).alias("__secrets__"))
    return found.select(*(F.col("__kept__").getField(c).alias(c) for c in keep), F.col("__secrets__").alias("secrets"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"))


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The text without its secrets: each run of overlapping spans becomes mark. A null text, or one without spans, stays."""
    text = F.col(text_col)

    def clean(spans):
        seen = _before(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        runs = F.filter(F.zip_with(spans, seen, lambda x, at: F.struct(at.alias("from"), x["start"].alias("to"))), lambda c: c["to"] >= c["from"])
        end = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
        rest = lambda z: F.struct(z.alias("from"), F.greatest(z, F.length(text)).alias("to"))
        return F.array_join(_let(F.concat(runs, F.array(_let(end, rest))), lambda cuts: _cut(text, F.lit(0), cuts)), mark)

    return scanned.withColumn(text_col, F.when(F.size("secrets") > 0, clean(F.col("secrets"))).otherwise(text))
