"""What a chunk of source code says about itself."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.helpers import col, sorted_set, suffix
from trawl.functions.paths import basename

#: Fixed tables: languages by extension, patterns by language, words that are no symbols, kinds of side effects.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascriptreact", ".ts": "typescript", ".tsx": "typescriptreact", ".json": "json", ".prisma": "prisma", ".md": "markdown", ".mdx": "mdx",
    ".css": "css", ".scss": "scss", ".sql": "sql", ".sh": "shell", ".yml": "yaml", ".yaml": "yaml", ".html": "html", ".xml": "xml", ".txt": "text",
}
SYMBOLS = {
    "python": (r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)\s*(?:->\s*[^:]+)?\s*:", r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:\([^)]*\))?\s*:"),
    "javascript": (
        r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(([^)]*)\)",
        r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
        r"^\s*(?:export\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)\b",
    ),
    "typescript": (
        r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(([^)]*)\)",
        r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*[:=]",
        r"^\s*(?:export\s+)?(?:class|interface|type|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)\b",
    ),
}
PY_IMPORT, PY_FROM = r"^\s*import\s+(.+)$", r"^\s*from\s+([A-Za-z0-9_\.]+)\s+import\s+(.+)$"
JS_IMPORTS = (r"^\s*import\s+.+?\s+from\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)")
NOT_USED = (
    "and", "as", "async", "await", "break", "case", "catch", "class", "const", "continue", "def", "delete",
    "do", "elif", "else", "except", "export", "false", "finally", "for", "from", "function", "if", "import",
    "in", "interface", "let", "new", "none", "not", "null", "or", "pass", "return", "self", "static",
    "switch", "this", "throw", "true", "try", "type", "var", "while", "with", "yield",
)
EFFECTS = (
    ("database", r"\b(commit|execute|insert|update|delete|save|query)\b"),
    ("network", r"\b(requests\.|httpx\.|fetch\(|axios\.|OpenAI\(|AsyncOpenAI\()"),
    ("filesystem", r"\b(open\(|write_text|read_text|unlink\(|rename\(|replace\()"),
    ("cache", r"\b(cache|redis|set_payload|upsert|delete_collection|create_collection)\b"),
    ("auth", r"\b(auth|token|login|logout|permission|session)\b"),
)
ROUTES = r"(@app\.route|Blueprint\(|router\.(get|post|put|patch|delete)|app\.(get|post|put|patch|delete))"


#: Fixed texts of a chunk's description; {} is what is put in.
CHUNK_FROM, USE_WHEN, CALLERS_OF, TESTS_OF, OUTLINE_OF = "{} chunk from {}", "Use this result when investigating {}.", "Find callers of {}", "Find tests covering {}", "Show outline for {}"


def filled(template: str, *values) -> Column:
    """A template with columns in the places of its braces."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, rest in zip(values, parts[1:], strict=True) for x in (col(v), F.lit(rest))))


def language(path) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("unknown"))


def pattern_language(lang) -> Column:
    lang = col(lang)
    return F.when(lang.startswith("typescript"), "typescript").when(lang.startswith("javascript"), "javascript").otherwise(lang)


def path_tokens(path) -> Column:
    return sorted_set(F.transform(F.filter(F.split(col(path), r"[^A-Za-z0-9_]+"), lambda t: t != ""), F.lower))


def file_role(path, lang) -> Column:
    p, lang = F.lower(col(path)), col(lang)
    has = lambda *xs: p.rlike("|".join(re.escape(x) for x in xs))
    return (
        F.when(has("/test/", "/tests/", "__tests__", ".test.", ".spec."), "test")
        .when(has("/route", "/routes", "/api/", "controller"), "route")
        .when(has("model", "schema", "prisma"), "model")
        .when(has("config", ".env", "settings") | lang.isin("json", "yaml"), "config")
        .when(lang.isin("typescriptreact", "javascriptreact", "html", "css", "scss") | p.endswith(".tsx") | p.endswith(".jsx"), "ui")
        .when(lang.isin("markdown", "mdx", "text"), "docs")
        .when(lang.isin("shell", "sql"), "script")
        .when(has("service", "client", "adapter", "worker"), "service")
        .otherwise("unknown")
    )


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    """Unicode classes and line anchors, as the patterns were written for."""
    return F.regexp_extract_all(text, F.lit("(?mU)" + pattern), F.lit(group))


def symbols_defined(text, lang) -> Column:
    t, by = F.coalesce(col(text), F.lit("")), pattern_language(lang)
    out = F.array().cast("array<string>")
    for name, patterns in SYMBOLS.items():
        out = F.when(by == name, F.concat(*[_all(t, p) for p in patterns])).otherwise(out)
    return sorted_set(F.filter(F.transform(out, F.trim), lambda s: s != ""))


def imports(text, lang) -> Column:
    t, by = F.coalesce(col(text), F.lit("")), pattern_language(lang)
    names = lambda raw: F.flatten(F.transform(raw, lambda r: F.transform(F.split(F.trim(r), ","), lambda p: F.trim(F.split(F.trim(p), " as ")[0]))))
    python = F.concat(names(_all(t, PY_IMPORT)), F.transform(_all(t, PY_FROM), F.trim))
    script = names(F.concat(*[_all(t, p) for p in JS_IMPORTS]))
    found = F.when(by == "python", python).when(by.isin("javascript", "typescript"), script).otherwise(F.array().cast("array<string>"))
    return sorted_set(F.filter(found, lambda x: x != ""))


def symbols_used(text, defined) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?U)\b([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1))
    kept = F.filter(F.array_distinct(found), lambda i: (F.length(i) > 1) & ~F.lower(i).isin(*NOT_USED))
    return F.slice(F.array_sort(F.array_except(kept, col(defined))), 1, 80)


def signature(text, defined) -> Column:
    """The first line that names a defined symbol or starts a declaration, 240 characters at most."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    start = r"(?U)^(async\s+def|def|class|export|function|const|let|var|interface|type|enum)\b"
    hit = F.filter(lines, lambda x: F.exists(col(defined), lambda s: F.contains(x, s)) | x.rlike(start))
    return F.left(F.coalesce(F.get(hit, F.lit(0)), F.lit("")), F.lit(240))


def chunk_type(lang, role, text, defined, sign) -> Column:
    lang, role, sign = col(lang), col(role), col(sign)
    return (
        F.when(role.isin("test", "config"), role)
        .when(lang.isin("markdown", "mdx"), "markdown")
        .when(lang == "html", "template")
        .when(lang.isin("css", "scss"), "style")
        .when(col(text).rlike(ROUTES), "route")
        .when(sign.rlike(r"(?U)\bclass\b"), "class")
        .when(sign.rlike(r"(?U)\b(def|function)\b|=>"), "function")
        .when(F.size(col(defined)) > 0, "symbol_block")
        .otherwise("module")
    )


def side_effects(text) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    return F.filter(F.array(*[F.when(t.rlike("(?iU)" + p), F.lit(name)) for name, p in EFFECTS]), lambda x: x.isNotNull())


def describe(df, path: str = "path", text: str = "text"):
    """Adds every metadata column of a chunk; later ones build on earlier ones."""
    p, t = F.col(path), F.col(text)
    out = df.withColumns({"language": language(p), "path_tokens": path_tokens(p), "side_effects": side_effects(t)})
    out = out.withColumns({"file_role": file_role(p, "language"), "symbols_defined": symbols_defined(t, "language"), "imports": imports(t, "language")})
    out = out.withColumns({"symbols_used": symbols_used(t, "symbols_defined"), "signature": signature(t, "symbols_defined")})
    out = out.withColumn("chunk_type", chunk_type("language", "file_role", t, "symbols_defined", "signature"))
    named = F.when(F.size("symbols_defined") > 0, F.array_join(F.slice("symbols_defined", 1, 3), ", ")).otherwise(basename(p))
    return out.withColumns(
        {
            "what_it_does": F.when(F.col("signature") != "", F.col("signature")).otherwise(filled(CHUNK_FROM, "chunk_type", p)),
            "when_to_use": filled(USE_WHEN, named),
            "file_skeleton": F.when(F.col("signature") != "", F.col("signature")).otherwise(F.array_join(F.slice("symbols_defined", 1, 8), ", ")),
            "next_queries": F.slice(F.concat(F.flatten(F.transform(F.slice("symbols_defined", 1, 2), lambda s: F.array(filled(CALLERS_OF, s), filled(TESTS_OF, s)))), F.array(filled(OUTLINE_OF, p))), 1, 4),
        }
    )
