"""Predicates and classifiers on paths, as column expressions that stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: language -> its file name extensions
EXTENSIONS = {
    "c": "c h", "cpp": "cc cpp cxx hh hpp hxx", "csharp": "cs", "css": "css less sass scss", "dart": "dart", "go": "go",
    "html": "htm html", "java": "java", "javascript": "cjs js jsx mjs", "json": "json", "kotlin": "kt kts", "lua": "lua",
    "markdown": "md mdx", "nix": "nix", "php": "php", "powershell": "ps1 psd1 psm1", "python": "py pyw", "ruby": "rb",
    "rust": "rs", "scala": "sc scala", "sql": "sql", "svelte": "svelte", "swift": "swift", "toml": "toml",
    "typescript": "ts tsx", "vue": "vue", "yaml": "yaml yml",
}
PARSED = ("javascript", "json", "python", "rust", "toml", "typescript", "yaml")

_IGNORED_DIRS = ".cache .code-review-graph .git .next .turbo bench benchmarks/out build coverage dist graphify-out node_modules public/static/charting_library target target-codex-test target-*"
_IGNORED_SUFFIXES = "*.7z *.DS_Store *.bz2 *.eot *.gif *.gz *.ico *.jpeg *.jpg *.lock *.map *.min.js *.mp3 *.mp4 *.ogg *.otf *.pdb *.pdf *.png *.rar *.svg *.tar *.ttf *.wasm *.wav *.webp *.woff *.woff2 *.zip"
_IGNORED_NAMES = ".gitkeep Cargo.lock Thumbs.db package-lock.json pnpm-lock.yaml yarn.lock"
IGNORED = [d + "/" for d in _IGNORED_DIRS.split()] + _IGNORED_SUFFIXES.split() + _IGNORED_NAMES.split()
PRESETS = {"monorepo": ".turbo/ build/ dist/ node_modules/ target/", "nextjs": "out/ .turbo/ .next/", "python": "*.pyc .venv/ __pycache__/ venv/", "rust": "target-codex-test/ target/", "tauri": "node_modules/ .next/ target/"}
_RISKY = "api auth billing config database db env migration payment permission route schema security session stripe".split()


def either(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def normalize(path: Column) -> Column:
    """Forward slashes, without leading ./ and /."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)*/*", "")


def ignore_match(path: Column, pattern: str) -> Column:
    """One ignore pattern: "x*/", "dir/", "*.ext", "*suffix" or a name; not a full glob."""
    pattern = pattern.strip().replace("\\", "/")
    while pattern.startswith(("./", "/")):
        pattern = pattern[2:] if pattern.startswith("./") else pattern[1:]
    if not pattern or pattern.startswith("#"):
        return F.lit(False)
    if pattern.endswith("*/"):
        return path.startswith(pattern[:-2])
    if pattern.endswith("/"):
        return (path == pattern[:-1]) | path.startswith(pattern)
    if pattern.startswith("*"):
        return path.endswith(pattern[1:])
    return (path == pattern) | path.startswith(pattern + "/")


def ignored(path: Column, more: list[str] = (), preset: str | None = None) -> Column:
    return either(ignore_match(path, p) for p in [*IGNORED, *more, *PRESETS.get(preset or "", "").split()])


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def language(path: Column) -> Column:
    """Language by the last extension, "unknown" for others."""
    names = F.create_map(*[F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts.split() for x in (e, lang)])
    return F.coalesce(F.try_element_at(names, extension(path)), F.lit("unknown"))


def support_level(lang: Column) -> Column:
    return F.when(lang.isin(*PARSED), "symbols-imports-calls").otherwise("file-loc-language")


def module(path: Column) -> Column:
    """crates/<x>, else the first segment."""
    parts = F.split(path, "/")
    return F.when((parts[0] == "crates") & (F.size(parts) >= 2), F.concat(F.lit("crates/"), F.get(parts, F.lit(1)))).otherwise(parts[0])


def is_test(path: Column) -> Column:
    return F.lower(path).rlike("test|spec")


def is_config_or_doc(path: Column) -> Column:
    return F.lower(path).rlike(r"(\.(json|md|toml|ya?ml)$)|config")


def is_risky(path: Column) -> Column:
    return F.lower(path).rlike("|".join(_RISKY))


def is_public(visibility: Column) -> Column:
    return F.coalesce(visibility.rlike("pub|export"), F.lit(False))


def skipped_by_update(path: Column) -> Column:
    """What the updater and the watcher leave out."""
    p = path
    first = [".code-review-graph/", ".git/", "build/", "dist/", "node_modules/", "target/"]
    return either([p.startswith(x) for x in first] + [p.contains("/" + x) for x in first[1:]] + [p.endswith(x) for x in (".lock", ".map", ".min.js", ".pdb", ".wasm")])


#: (kind of entry point, regular expression on the lower-cased path), the first that matches wins
ENTRYPOINTS = [
    ("nextjs_middleware", r"/middleware\.[jt]s$"),
    ("nextjs_api_route", r"(/route\.(tsx?|js)$)|/pages/api/"),
    ("nextjs_layout", r"/layout\.(tsx?|jsx)$"),
    ("nextjs_page", r"/page\.(tsx?|jsx)$"),
    ("server_action", r"action.*\.(tsx?|js)$"),
    ("rust_binary", r"(^|/)src/main\.rs$|/src/bin/"),
    ("rust_route_module", r"actix|axum|/routes/"),
    ("python_route", r"fastapi|/views\.py|/django/"),
    ("python_task", r"celery|task.*\.py$"),
    ("worker_or_consumer", r"consumer|queue|worker"),
    ("test_flow", r"spec|test"),
]


def entrypoint(path: Column) -> Column:
    """Kind of entry point of a file, null for none."""
    low = F.lower(path)
    return F.coalesce(*[F.when(low.rlike(rx), kind) for kind, rx in ENTRYPOINTS])


def glob_regex(pattern: str) -> str | None:
    """A glob as a regular expression; stars cross slashes. None for a broken pattern."""
    out, k, depth = "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            while pattern[k : k + 1] == "*":
                k += 1
            if pattern[k : k + 1] == "/" and out.endswith(("/", "")) and pattern[max(0, k - 3) : k] in ("**", "/**"):
                out += "(.*/)?"
                k += 1
            else:
                out += ".*"
            continue
        if c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                return None
            inner = pattern[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            k = end
        elif c == "{":
            depth, out = depth + 1, out + "("
        elif c == "}" and depth:
            depth, out = depth - 1, out + ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += c if c.isalnum() or c in "/_-" else "\\" + c
        k += 1
    return None if depth else f"^{out}$"


def test_command(path: Column, symbol: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return (
        F.when(path.endswith(".rs"), F.concat(F.lit("cargo test "), F.coalesce(symbol, stem)))
        .when(path.endswith(".py"), F.concat(F.lit("pytest "), F.concat_ws("::", path, symbol)))
        .when(path.rlike(r"\.[jt]sx?$"), F.concat(F.lit("pnpm vitest "), path))
        .otherwise(F.concat(F.lit("run tests covering "), path))
    )
