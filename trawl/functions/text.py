"""Text, hash and identifier functions as Columns; each is one expression that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.helpers import col

SPARSE_BUCKETS = 1_000_003
EMBED_CHARS, CUT_MARK = 12_000, "\n\n[... embedding text truncated ...]\n\n"
#: Fixed word list of the keyword extractor.
KEYWORD_STOP = ("from", "import", "return", "const", "let", "var", "this", "that", "with", "then", "else", "true", "false", "none", "null", "self")


def lexical_words(text) -> Column:
    """Identifiers and numbers as they stand."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[0-9]+)"), F.lit(1))


def lexical_tokens(text) -> Column:
    """Identifiers and numbers in lower case, each followed by its underscore and camel-case parts; parts of one letter drop, repeats stay."""

    def expand(t: Column) -> Column:
        low = F.lower(t)
        snake = F.filter(F.split(low, r"[_\\-]+"), lambda p: (p != "") & (p != low))
        camel = F.transform(F.regexp_extract_all(t, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+)"), F.lit(1)), F.lower)
        plain = t.rlike("^(?:[A-Z]?[a-z]+|[0-9]+)$")  # most tokens: one part, which is the token
        return F.when(plain, F.array(low)).otherwise(F.concat(F.array(low), snake, F.filter(camel, lambda p: (p != "") & (p != low))))

    return F.filter(F.flatten(F.transform(lexical_words(text), expand)), lambda t: F.length(t) > 1)


def query_terms(text) -> Column:
    return F.array_sort(F.array_distinct(lexical_tokens(text)))


def sparse_bucket(token) -> Column:
    """The first 8 bytes of the token's SHA-256, big-endian, modulo SPARSE_BUCKETS."""
    h = F.sha2(col(token), 256)
    head = F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % SPARSE_BUCKETS  # 60 bits fit a long, the last four follow
    return ((head * 16 + F.instr(F.lit("0123456789abcdef"), F.substring(h, 16, 1)) - 1) % SPARSE_BUCKETS).cast("int")


def sanitize(text) -> Column:
    """Control characters to spaces, runs of blanks to one, trimmed; long texts keep both ends around a mark."""
    plain = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\x00-\x08\x0B-\x1F]", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"^\s+|\s+$", "")
    half = EMBED_CHARS // 2
    cut = F.concat(F.left(plain, F.lit(half)), F.lit(CUT_MARK), F.right(plain, F.lit(half)))
    return F.when(plain == "", "[empty embedding input]").when(F.length(plain) > EMBED_CHARS, cut).otherwise(plain)


def fallback_text(text) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    return F.concat(F.lit("Embedding fallback for code-search chunk.\nOriginal text sha256: "), F.sha2(t, 256), F.lit("\nPreview:\n"), F.left(t, F.lit(1000)))


def content_hash(text) -> Column:
    return F.sha2(F.coalesce(col(text), F.lit("")), 256)


def chunk_id(path, index) -> Column:
    return F.concat(F.lit("chunk-"), F.left(F.sha2(F.concat_ws(":", col(path), col(index).cast("string")), 256), F.lit(16)))


def manifest_id(slug, base, target) -> Column:
    return F.left(F.sha2(F.concat_ws(":", col(slug), col(base), col(target)), 256), F.lit(16))


def uuid5(name, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """RFC 4122 version 5 of a name, by default in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(col(name), "UTF-8")))
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _json_text(c) -> Column:
    """A text as JSON, as Python writes it: what JSON asks to escape and nothing else, code points in lower case."""
    out = F.to_json(F.array(F.coalesce(col(c), F.lit(""))))
    out = F.substring(out, F.lit(2), F.length(out) - 2)
    for code in (11, 14, 15, *range(26, 32)):
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\u%04X" % code, r"$1\\u%04x" % code)
    return out


def digest_context_hash(slice_id, module_purpose, digest_version, digest_model, slice_content_hash) -> Column:
    """SHA-256 of a digest's five fields as JSON with sorted keys, a blank after each colon and comma; nulls count as empty."""
    fields = {"digest_model": digest_model, "digest_version": digest_version, "module_purpose": module_purpose, "slice_content_hash": slice_content_hash, "slice_id": slice_id}
    parts = [F.concat(F.lit(f'"{name}": '), _json_text(c)) for name, c in fields.items()]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def stable_json_hash(**fields) -> Column:
    """SHA-256 of the fields as JSON with sorted keys and no blanks."""
    return F.sha2(F.to_json(F.struct(*(col(c).alias(name) for name, c in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)


def slug(path, suffix: bool = False) -> Column:
    """Lower-case letters, digits and dashes, 40 at most; with suffix, eight digits of the path's SHA-1 follow."""
    base = F.left(F.regexp_replace(F.regexp_replace(F.lower(col(path)), r"[^a-z0-9-]+", "-"), r"^-+|-+$", ""), F.lit(40))
    return F.concat(base, F.lit("-"), F.left(F.sha1(F.encode(col(path), "UTF-8")), F.lit(8))) if suffix else base


def hyde_key(hash_, version, model) -> Column:
    return F.concat(F.lit("content:"), col(hash_), F.lit(":hyde:"), col(version), F.lit(":model:"), col(model))


def normalize_question(question) -> Column:
    """White space collapsed; ends in a question mark, which replaces trailing dots, colons and semicolons."""
    q = F.trim(F.regexp_replace(F.coalesce(col(question), F.lit("")), r"\s+", " "))
    return F.when((q == "") | q.endswith("?"), q).otherwise(F.concat(F.regexp_replace(q, r"[.:;]+$", ""), F.lit("?")))


def truncate_words(text, most: int = 120) -> Column:
    w = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(w, 1, most), " ")


def safe_filename(value) -> Column:
    """Letters, digits, - and _ stay, all else is -, none at the ends; slice if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.when(name == "", "slice").otherwise(name)


def trigrams(text) -> Column:
    """Distinct three-character windows of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))


def clamp(value, low: int, high: int) -> Column:
    return F.least(F.greatest(col(value), F.lit(low)), F.lit(high))
