"""Which files are indexed, and what a path says about a hit."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.helpers import col, strings, suffix

#: Fixed lists of the file filter.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".json", ".prisma", ".md", ".mdx", ".css", ".scss", ".sql", ".sh", ".yml", ".yaml", ".py", ".html", ".xml", ".txt")
EXCLUDED_DIRS = (".git", ".next", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "qdrant_storage", "vendor", "vendors")
EXCLUDED_NAMES = ("bun.lockb", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")
EXCLUDED_SUFFIXES = (".log", ".map", ".min.css", ".min.js")
GENERATED_CSS = ("tailwind.css", "pipeline_tailwind.css")
MOST_BYTES, LONG_LINE = 1_000_000, 20_000
SOURCE_SKIP = r"^(\.|node_modules|venv|__pycache__|dist|build|\.agents|\.github|\.cursor|\.venv|\.claude)"
SOURCE_SKIP_EXT = r"(?i)\.(lock|map|min\.js|min\.css|woff2?|ttf|eot|ico|png|jpg|jpeg|gif|svg|pdf|zip|tar|gz|pyc)$"
INDEX_DIRS = (".agents", ".claude", ".cursor", ".git", ".github", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "venv")
INDEX_LOCKS = r"(?i)(^|/)(package-lock|pnpm-lock|yarn\.lock|uv\.lock|poetry\.lock|Pipfile\.lock)$"
INDEX_BINARY = r"(?i)\.(png|jpe?g|gif|webp|ico|pdf|zip|gz|tar|tgz|mp4|mov|mp3|wav|sqlite|db)$"
INDEX_EXT = r"(?i)\.(py|js|mjs|cjs|ts|tsx|jsx|svelte|html|css|scss|json|jsonc|ya?ml|toml|md|mdx|txt|sh|bash|sql|d2|env\.example)$"
INDEX_NAMES = r"(?i)(^|/)(Dockerfile|Makefile|Procfile|README|AGENTS\.md)$"
PENALTIES = ((r"\.(json|toml|yaml|yml)$", 0.5), (r"\.config\.(ts|js|mjs)$|\.md$", 0.6), (r"\.test\.(ts|js|tsx|jsx)$|\.spec\.(ts|js)$", 0.7), (r"\.(css|html|svg)$", 0.6), (r"\.(lock|gitignore)$", 0.3))


def glob_regex(pattern: str) -> str:
    """A shell glob over the whole path as a regular expression; * crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[^{inside[1:]}]" if inside.startswith("!") else f"[{inside}]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.sub(r"([^\w/])", r"\\\1", c)
        i += 1
    return f"(?s)^{out}$"


def matches_any(path, globs: str | list[str]) -> Column:
    """Whether a path matches one of the globs (a list, or comma-separated); /**/ also stands for one slash."""
    patterns = [g.strip() for g in globs.split(",") if g.strip()] if isinstance(globs, str) else list(globs)
    out = F.lit(False)
    for g in patterns:
        for p in dict.fromkeys([g, g.replace("/**/", "/")]):
            out = out | col(path).rlike(glob_regex(p))
    return out


def basename(path) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)/*$", 1)


def excluded(path, exclude: str = "") -> Column:
    p, name = col(path), F.lower(basename(path))
    out = matches_any(p, exclude) | F.arrays_overlap(F.split(p, "/"), strings(EXCLUDED_DIRS)) | name.isin(*EXCLUDED_NAMES)
    for s in EXCLUDED_SUFFIXES:
        out = out | name.endswith(s)
    return out | (name.isin(*GENERATED_CSS) & F.concat(F.lit("/"), F.lower(p)).contains("/static/"))


def generated(path, text) -> Column:
    """Over a megabyte, or a style, script or data file with a line of over 20,000 characters."""
    t = F.coalesce(col(text), F.lit(""))
    longest = F.array_max(F.transform(F.split(t, "\n"), F.length))
    return (F.octet_length(t) > MOST_BYTES) | ((longest > LONG_LINE) & suffix(path).isin(".css", ".js", ".json", ".xml"))


def should_index(path, text=None, include: str = "", exclude: str = "") -> Column:
    own = F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)  # the extension counts as written
    out = own.isin(*EXTENSIONS) & ~excluded(path, exclude)
    out = out & matches_any(path, include) if include else out
    return out & ~generated(path, text) if text is not None else out


def source_file(path) -> Column:
    p = col(path)
    return (p != "") & ~p.rlike(SOURCE_SKIP) & ~p.rlike(SOURCE_SKIP_EXT) & ~p.contains("node_modules") & ~p.contains("__pycache__")


def indexable(path) -> Column:
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    bad = F.arrays_overlap(F.split(p, "/"), strings(INDEX_DIRS)) | p.rlike(INDEX_LOCKS) | p.rlike(INDEX_BINARY)
    return ~bad & (p.rlike(INDEX_EXT) | p.rlike(INDEX_NAMES))


def digest_included(path, include: str = "", exclude: str = "") -> Column:
    name = F.lower(basename(path))
    out = F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1).isin(*EXTENSIONS) & ~F.arrays_overlap(F.split(col(path), "/"), strings(d for d in EXCLUDED_DIRS if d != "qdrant_storage"))
    out = out & ~name.isin(*EXCLUDED_NAMES) & ~matches_any(path, exclude)
    for s in EXCLUDED_SUFFIXES:
        out = out & ~name.endswith(s)
    return out & matches_any(path, include) if include else out


def path_penalty(path) -> Column:
    p = F.lower(F.coalesce(col(path), F.lit("")))
    out = F.lit(1.0)
    for pattern, factor in reversed(PENALTIES):
        out = F.when(p.rlike(pattern), F.lit(factor)).otherwise(out)
    return out


def confidence(score, exact) -> Column:
    return F.when((col(score) >= 0.75) | exact, "high").when(col(score) >= 0.45, "medium").otherwise("low")


def slice_id(path) -> Column:
    parts = F.filter(F.split(col(path), "/"), lambda x: x != "")
    two = (parts[0].isin("apps", "packages", "workers", "services", "src")) & (F.size(parts) >= 2)
    return F.when(F.size(parts) <= 1, "root").when(two, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.get(parts, F.lit(0)))


def digest_role(path) -> Column:
    p = F.lower(col(path))
    has = lambda *xs: p.rlike("|".join(re.escape(x) for x in xs))
    return (
        F.when(has("/test/", "/tests/", "__tests__", ".test.", ".spec.", "-test/"), "tests")
        .when(has("/docs/", "readme", ".md"), "docs")
        .when(has("wrangler", "package.json", "tsconfig", "config", ".yml", ".yaml", ".json"), "configuration")
        .when(has("worker", "handler", "route", "api", "server"), "runtime code")
        .otherwise("source code")
    )
