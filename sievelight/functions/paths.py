"""Predicates and projections on paths."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that are never scanned.
SKIP_DIRS = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "env", "ENV", "dist", "build", ".idea", ".vscode",
    ".mypy_cache", ".ruff_cache", ".pytest_cache", "htmlcov", ".tox", "eggs", ".eggs", ".sievelight",
)
# Languages by suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".go": "go", ".java": "java",
    ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".kt": "kotlin", ".swift": "swift", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".tf": "hcl",
}
# Names of languages for highlighting; any other suffix is text.
HIGHLIGHTED = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".java", ".rs", ".rb", ".php", ".c", ".cpp", ".sh", ".yml", ".yaml", ".json", ".toml",
)
#: Paths of tests, which the route and access engines leave out.
TEST_PATH = r"(?i)(?:^|[\\/])(?:tests?|spec|__tests__)[\\/]|(?:_test|\.test|\.spec|_spec)\.[a-z]+$"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """The last suffix of the name; a name that only begins with a dot has none."""
    return F.regexp_extract(name_of(path), r".(\.[^./]+)$", 1)


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(suffix_of(path)))


def highlight_language(path: str) -> str:
    """The language that a snippet of a file is shown in."""
    found = re.search(r".(\.[^./]+)$", path)
    end = found[1].lower() if found else ""
    return LANGUAGES[end] if end in HIGHLIGHTED else "text"


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRS))) | F.exists(parts, lambda p: p.endswith(".egg-info"))


def is_hidden(path: Column) -> Column:
    """A part that begins with a dot, unless the suffix as it stands is a known one."""
    hidden = F.exists(F.split(path, "/"), lambda p: p.startswith("."))
    return hidden & ~suffix_of(path).isin(*LANGUAGES)


def ignore_regex(patterns: list[str]) -> str | None:
    """One regular expression for all globs of the ignore files; None without any.

    A glob is tried on the whole path and on the name; one that ends in a
    slash also covers what lies below it.
    """
    found = []
    for p in patterns:
        tried = [(p, True)] + ([(p.rstrip("/") + "/*", False)] if p.endswith("/") else [])
        for glob, by_name in tried:
            body = fnmatch.translate(glob).removesuffix(r"\Z").removesuffix(r"\z").replace("(?>", "(?:")
            found.append(f"^(?:{body})$")
            if by_name:
                found.append(f"^(?:.*/)?(?:{re.sub(r'[.][*]', '[^/]*', body)})$")
    return "|".join(found) or None


def is_ignored(path: Column, patterns: list[str]) -> Column:
    regex = ignore_regex(patterns)
    return F.lit(False) if regex is None else path.rlike(regex)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def keep_files(path: Column, size: Column, patterns: list[str] = (), max_kb: int = 1000) -> Column:
    """All filters that need no content."""
    return ~in_skipped_dir(path) & ~is_hidden(path) & ~is_ignored(path, list(patterns)) & (size <= max_kb * 1024)


def relative(path: Column, root: str) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    return F.when(clean.startswith(base), F.substr(clean, F.lit(len(base) + 1))).otherwise(clean)
