"""Chunkers: text rows in, chunk rows out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.helpers import suffix

CHUNK, OVERLAP, CAP, LINES, LINES_CAP = 1500, 200, 4000, 120, 12_000
#: Chunks, and characters of them, that leave a task together.
MOST_ROWS, MOST_CHARS = 2048, 1 << 21

#: Fixed tables: languages by extension and the line starts that open a chunk.
BOUNDARY_LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".rb": "ruby", ".php": "php", ".sh": "bash", ".bash": "bash", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
}
_SCRIPT = (
    r"^export\s+(async\s+)?function\s+\w+",
    r"^(export\s+)?(async\s+)?function\s+\w+",
    r"^(export\s+)?class\s+\w+",
    r"^\s*(static\s+)?(async\s+)?\w+\s*\([^)]*\)\s*\{",
    r"^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\(",
    r"^(export\s+)?interface\s+\w+",
    r"^(export\s+)?type\s+\w+\s*=",
)
BOUNDARIES = {
    "javascript": _SCRIPT,
    "typescript": (*_SCRIPT, r"^(export\s+)?enum\s+\w+"),
    "python": (r"^(async\s+)?def\s+\w+", r"^class\s+\w+"),
    "go": (r"^func\s+(\(\w+\s+\*?\w+\)\s+)?\w+", r"^type\s+\w+\s+struct", r"^type\s+\w+\s+interface"),
    "rust": (r"^(pub\s+)?fn\s+\w+", r"^(pub\s+)?struct\s+\w+", r"^(pub\s+)?enum\s+\w+", r"^(pub\s+)?impl\b", r"^(pub\s+)?trait\s+\w+"),
    "java": (r"^\s*(public|private|protected|static|final|abstract|synchronized)*\s+(class|interface|enum)\s+\w+", r"^\s*(public|private|protected|static|final|abstract|synchronized)*\s+[\w<>\[\]]+\s+\w+\s*\("),
    "php": (r"^\s*(public|private|protected|static)\s+function\s+\w+", r"^\s*function\s+\w+", r"^\s*class\s+\w+"),
    "ruby": (r"^\s*def\s+\w+", r"^\s*class\s+\w+", r"^\s*module\s+\w+"),
    "bash": (r"^\s*\w+\s*\(\)\s*\{", r"^\s*function\s+\w+"),
}


def by_lines(docs: DataFrame, id_col: str, text_col: str, lines: int = LINES, cap: int = LINES_CAP) -> DataFrame:
    """Windows of lines lines, at most cap characters, blank ones dropped: id, chunk_index, start_line, end_line, chunk."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n", "\n")
    parts = docs.select(F.col(id_col), F.split(text, "\n").alias("_l"))
    starts = parts.select(id_col, "_l", F.explode(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / lines).cast("int"))).alias("chunk_index"))
    chunk = F.left(F.array_join(F.slice("_l", F.col("chunk_index") * lines + 1, F.lit(lines)), "\n"), F.lit(cap))
    out = starts.select(id_col, "chunk_index", (F.col("chunk_index") * lines + 1).alias("start_line"), F.least((F.col("chunk_index") + 1) * lines, F.size("_l")).alias("end_line"), chunk.alias("chunk"))
    return out.where(F.regexp_replace("chunk", r"\s+", "") != "")


def whole(docs: DataFrame, id_col: str, text_col: str, cap: int = CAP) -> DataFrame:
    """One chunk of a text, cut at cap characters."""
    return docs.select(id_col, F.lit(0).alias("chunk_index"), F.left(F.coalesce(F.col(text_col), F.lit("")), F.lit(cap)).alias("chunk"))


def by_characters(docs: DataFrame, id_col: str, text_col: str, size: int, most: int = 8) -> DataFrame:
    """Windows of size characters, most at most, blank ones dropped."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    n = F.least(F.greatest(F.ceil(F.length(t) / size), F.lit(1)), F.lit(most)).cast("int")
    out = docs.select(id_col, t.alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    out = out.select(id_col, "chunk_index", F.substring("_t", F.col("chunk_index") * size + 1, F.lit(size)).alias("chunk"))
    return out.where(F.regexp_replace("chunk", r"\s+", "") != "")


def pack_lines(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[str, int, int]]:
    """Lines packed greedily: a chunk closes before the line that would exceed size; its last lines, overlap at most, open the next."""
    held: list[tuple[int, str]] = []
    length = 0
    for number, line in enumerate(text.split("\n"), 1):
        for piece in [line[i : i + size] for i in range(0, len(line), size)] or [""]:
            if held and length + len(piece) + 1 > size:
                yield "\n".join(x for _, x in held), held[0][0], held[-1][0]
                keep, length = len(held), 0
                while keep and length + len(held[keep - 1][1]) + 1 <= overlap:
                    keep -= 1
                    length += len(held[keep][1]) + 1
                held = held[keep:]
            held.append((number, piece))
            length += len(piece) + 1
    if held:
        yield "\n".join(x for _, x in held), held[0][0], held[-1][0]


def pack_lines_late(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[str, int, int]]:
    """The older packer: a chunk closes after the line that reaches size; overlap counts bare lines; a blank rest drops."""
    lines = text.split("\n")
    held: list[str] = []
    length, start = 0, 1
    for number, line in enumerate(lines, 1):
        held.append(line)
        length += len(line) + 1
        if length >= size:
            yield "\n".join(held), start, number
            keep, length = len(held), 0
            while keep and length + len(held[keep - 1]) <= overlap:
                keep -= 1
                length += len(held[keep])
            held = held[keep:]
            start = number - len(held) + 1
    if "".join(held).strip():
        yield "\n".join(held), start, len(lines)


def boundary_chunks(text: str, lang: str | None, cap: int = CAP) -> list[tuple[str, int, int]]:
    """Slices between the lines that open a declaration, trimmed and cut at cap; none if there are fewer than two."""
    patterns = [re.compile(p.removeprefix("^"), re.ASCII) for p in BOUNDARIES.get(lang or "", ())]
    cuts, at = {0, len(text)}, 0
    for line in text.split("\n"):
        if any(p.match(text, at) for p in patterns):
            cuts.add(at)
        at += len(line) + 1
    ends = sorted(cuts)
    out = [(text[a:b].strip()[:cap], a, b) for a, b in zip(ends, ends[1:], strict=False)]
    out = [x for x in out if x[0]]
    return out if len(out) > 1 else []


def _each(docs: DataFrame, id_col: str, cols: list[str], f: Callable, schema: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    types = [pa.string() if x.endswith(" string") else pa.int64() for x in schema.split(",")]

    def run(batches):
        for b in batches:
            kind = b.schema.field(id_col).type
            held, size = [], 0
            for r in range(b.num_rows):  # a text at a time: neither a batch's texts nor its chunks stand in Python together
                own = b.column(id_col)[r].as_py()
                for row in f(*(b.column(c)[r].as_py() for c in cols)):
                    held.append((own, *row))
                    size += sum(len(x) for x in row if isinstance(x, str))
                    if len(held) >= MOST_ROWS or size >= MOST_CHARS:
                        yield batch(held, kind)
                        held, size = [], 0
            if held:
                yield batch(held, kind)

    def batch(rows, kind):
        first, *rest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(first, kind), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], [id_col, *names])

    return docs.select(id_col, *cols).mapInArrow(run, f"{id_col} {kind}, {schema}")


def greedy(docs: DataFrame, id_col: str, text_col: str, late: bool = False, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk_index, start_line, end_line, line_range, chunk of packed lines; sequential in a text, so Arrow batches."""
    pack = pack_lines_late if late else pack_lines

    def rows(text):
        return ((k, a, z, c) for k, (c, a, z) in enumerate(pack(text or "", size, overlap)))

    out = _each(docs, id_col, [text_col], rows, "chunk_index bigint, start_line bigint, end_line bigint, chunk string")
    both = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    return out.withColumn("line_range", F.when(F.col("start_line") == F.col("end_line"), F.col("start_line").cast("string")).otherwise(both))


def by_boundary(docs: DataFrame, id_col: str, text_col: str, path_col: str, cap: int = CAP) -> DataFrame:
    """id, chunk_index, start, end, chunk: declaration boundaries, or the whole text where a language has none or one chunk comes out."""
    table = F.create_map(*[F.lit(x) for pair in BOUNDARY_LANGUAGES.items() for x in pair])
    own = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.try_element_at(table, suffix(path_col)).alias("_lang"))

    def rows(text, lang):
        found = boundary_chunks(text, lang, cap) or [(text[:cap], 0, len(text))]
        return [(k, a, z, c) for k, (c, a, z) in enumerate(found)]

    return _each(own, id_col, ["_text", "_lang"], rows, "chunk_index bigint, start bigint, end bigint, chunk string")


def pack_bundles(files: DataFrame, path_col: str, text_col: str, groups: int, target: int = 25_000, per_file: int = 3000) -> DataFrame:
    """Files, each cut at per_file, in bundles of about target characters: bundle, members, chars. Packed in path order in each of groups hash groups, so no task sees all files."""
    own = files.select(F.pmod(F.xxhash64(path_col), F.lit(groups)).alias("g"), F.col(path_col).alias("p"), F.least(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(per_file)).alias("n"))

    def run(batches):
        g, held, chars, k = None, [], 0, 0
        for b in batches:
            for r in b.to_pylist():
                if held and (r["g"] != g or chars + r["n"] > target):
                    yield pa.RecordBatch.from_pydict({"bundle": [f"{g}-{k}"], "members": pa.array([held], pa.list_(pa.string())), "chars": pa.array([chars], pa.int64())})
                    k, held, chars = (k + 1 if r["g"] == g else 0), [], 0
                g = r["g"]
                held.append(r["p"])
                chars += r["n"]
        if held:
            yield pa.RecordBatch.from_pydict({"bundle": [f"{g}-{k}"], "members": pa.array([held], pa.list_(pa.string())), "chars": pa.array([chars], pa.int64())})

    return own.repartition("g").sortWithinPartitions("g", "p").mapInArrow(run, "bundle string, members array<string>, chars bigint")
