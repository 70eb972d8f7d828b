"""Dense vectors as arrays: dot product, norm, cosine, validity, and a deterministic stand-in for an embedding model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.helpers import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def valid(a, dimension: int | None = None) -> Column:
    v = col(a)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return ok & (F.size(v) == dimension) if dimension else ok


def pseudo_embedding(seed, dimension: int) -> Column:
    """Sixteen values from each SHA-256 of "seed:counter": big-endian signed 16-bit over 32768, six decimals."""
    blocks = -(-dimension // 16)

    def block(i: Column) -> Column:
        h = F.sha2(F.concat_ws(":", col(seed), i.cast("string")), 256)
        word = lambda k: F.conv(F.substring(h, k * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.round((word(k) - F.when(word(k) >= 32768, 65536).otherwise(0)) / 32768.0, 6))

    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), block)), 1, dimension)
