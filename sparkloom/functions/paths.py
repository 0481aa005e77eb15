"""Functions of paths and shell commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Last part of a path, trailing slashes left out."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def parent_name(path: Column) -> Column:
    """Name of the directory that holds a file; empty without one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def suffix(path: Column) -> Column:
    """Suffix of a path with its dot, or ``(none)``: a leading dot or a last one opens none."""
    found = F.regexp_extract(path, r"(?:^|/)[^/]*[^/.][^/]*?(\.[^./]+)/*$", 1)
    return F.when(found == "", "(none)").otherwise(found)


def command_head(command: Column) -> Column:
    """Program of a shell command: its first word without opening brackets and directories, or ``(empty)``."""
    head = F.regexp_extract(F.regexp_replace(F.coalesce(command, F.lit("")), r"^[\s(]+", ""), r"^(\S+)", 1)
    return F.when(head == "", "(empty)").otherwise(F.regexp_extract(head, "[^/]*$", 0))


def lookup_form(query: Column) -> Column:
    """A path query without case, back slashes, a leading ``./`` and outer slashes."""
    plain = F.translate(F.lower(query), "\\", "/")
    return F.regexp_replace(F.regexp_replace(plain, r"^\.?/+", ""), "/+$", "")


def is_test_path(path: Column) -> Column:
    """Test code, by directory in any case or by the ending of its name in exact case."""
    by_directory = path.rlike(r"(?i)(^|/)(test|tests|testcomponent|componenttest|__tests__|__mocks__|spec)/")
    return by_directory | F.regexp_extract(path, "[^/]*$", 0).rlike(r"(Test|Tests|Spec|IT|ITCase|TestCase)\.[A-Za-z0-9]+$")


def is_generated_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)generated/")


def in_scope(path: Column, scope: str) -> Column:
    """The path belongs to a scope: main, test, or all."""
    if scope == "all":
        return F.lit(True)
    test = is_test_path(path)
    return (test if scope == "test" else ~test) & ~is_generated_path(path)


#: Language of a file by its suffix (fixed values); another suffix stands for itself.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "java": "java", "rs": "rust", "py": "python",
    "go": "go", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
    "swift": "swift", "kt": "kotlin", "scala": "scala", "dart": "dart",
}


def file_language(path: Column) -> Column:
    """Language of a file; empty without a suffix."""
    extension = F.regexp_extract(path, r"(?:^|/)[^/]*[^/.][^/]*?\.([^./]*)$", 1)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[extension], extension)


def query_form(query: Column) -> Column:
    """A query without white space around it and one leading ``@``."""
    return F.regexp_replace(F.regexp_replace(query, r"(?U)^\s+|\s+$", ""), "^@", "")


def episode_id(source: Column) -> Column:
    """Number of a podcast episode: the source itself if it is all digits, else the first filled parameter ``i`` of its
    address; null without one."""
    parameter = F.nullif(F.url_decode(F.regexp_extract(source, r"[?&]i=([^&#]+)", 1)), F.lit(""))
    return F.when(source.rlike(r"^\d+$"), source).otherwise(parameter)
