"""Column functions: identities, paths, surfaces, text and locators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# identities


def identity(prefix: str, *parts: Column | str) -> Column:
    """prefix:sha256 of the prefix and the parts, separated by NUL; a null part is marked, not skipped."""
    marked = [F.coalesce(col(p).cast("string"), F.lit("\x01null")) for p in parts]
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws(NUL, F.lit(prefix), *marked), 256))


def digest(value: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(value).cast("binary"), 256))


def canonical(*fields: Column | str) -> Column:
    """JSON text of the fields, nulls kept; name them in order of their names."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


# paths


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The last suffix with its dot, lower-case; empty for none, for a leading dot and for a trailing one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]+)$", 1))


def depth(path: Column | str) -> Column:
    return F.size(F.split(col(path), "/"))


def top_level(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), 1)


def safe_path(path: Column | str) -> Column:
    """Not empty, without NUL, edge slashes, and empty, '.' or '..' parts."""
    p = col(path)
    parts = F.split(p, "/")
    return (F.length(p) > 0) & ~F.contains(p, F.lit(NUL)) & ~F.exists(parts, lambda x: x.isin("", ".", ".."))


#: Media types by suffix.
MEDIA_TYPES = {
    ".md": "text/markdown", ".txt": "text/plain", ".py": "text/x-python", ".json": "application/json", ".toml": "application/toml",
    ".yaml": "application/yaml", ".yml": "application/yaml", ".xml": "application/xml", ".html": "text/html", ".css": "text/css",
    ".js": "text/javascript", ".ts": "text/typescript", ".rs": "text/x-rust", ".go": "text/x-go",
}
#: Names, directories and suffixes of change surfaces.
LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "uv.lock", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock")
MANIFESTS = ("pyproject.toml", "package.json", "cargo.toml", "go.mod", "composer.json", "gemfile")
VENDOR_DIRS, GENERATED_DIRS, TEST_DIRS = ("vendor", "vendored", "third_party", "third-party"), ("generated", "gen"), ("tests", "test", "__tests__")
TEST_NAMES = r"^test_|_test\.py$|\.(test|spec)\.(ts|tsx|js)$"
DOC_SUFFIXES, CONFIG_SUFFIXES = (".md", ".rst", ".adoc"), (".toml", ".yaml", ".yml", ".ini", ".cfg", ".json")
SOURCE_SUFFIXES = (
    ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".rs", ".go", ".java", ".kt", ".kts", ".c", ".h", ".cc", ".cpp",
    ".hpp", ".cs", ".rb", ".php", ".swift", ".scala", ".sh",
)


def media_type(path: Column | str) -> Column:
    pairs = [F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix(path)), F.lit("application/octet-stream"))


def _any_part(parts: Column, names: Iterable[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def change_surface(path: Column | str) -> Column:
    """The kind of file that a path's words tell; the first rule that fits counts."""
    p = F.lower(col(path))
    parts, name, ext = F.filter(F.split(p, "/"), lambda x: x != ""), basename(p), suffix(p)
    rules = [
        ("WORKFLOW", p.startswith(".github/workflows/")),
        ("LOCKFILE", name.isin(*LOCKFILES)),
        ("MANIFEST", name.isin(*MANIFESTS) | (name.startswith("requirements") & name.endswith(".txt"))),
        ("VENDORED", _any_part(parts, VENDOR_DIRS)),
        ("GENERATED", _any_part(parts, GENERATED_DIRS) | name.endswith(".min.js")),
        ("TEST", _any_part(parts, TEST_DIRS) | name.rlike(TEST_NAMES)),
        ("DOCS", F.coalesce(F.try_element_at(parts, F.lit(1)).isin("docs", "doc"), F.lit(False)) | name.startswith("readme") | name.startswith("changelog") | ext.isin(*DOC_SUFFIXES)),
        ("CONFIG", (name == "dockerfile") | name.startswith("docker-compose") | ext.isin(*CONFIG_SUFFIXES)),
        ("SOURCE", ext.isin(*SOURCE_SUFFIXES)),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for label, rule in rules[1:]:
        out = out.when(rule, label)
    return out.otherwise("UNKNOWN")


def path_group(path: Column | str) -> Column:
    parts = F.split(col(path), "/")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return (
        F.when(F.size(parts) == 1, F.lit("root"))
        .when((parts[0] == ".github") & (parts[1] == "workflows"), F.lit('path-prefix:".github/workflows"'))
        .otherwise(F.concat(F.lit("top-level:"), quoted(parts[0])))
    )


# text

LINE_BREAK = "\r\n|\n|\r"


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end starts no line."""
    parts = F.split(col(text), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def folded(text: Column | str) -> Column:
    """Lower-case with runs of whitespace as one space, for matching fragments."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"\s+", " "))


def contains_all(text: Column | str, fragments: Column | str) -> Column:
    """Whether a text holds every fragment, folded."""
    t = folded(text)
    return F.forall(col(fragments), lambda f: F.contains(t, folded(f)))


def pointer_escape(token: Column | str) -> Column:
    return F.replace(F.replace(col(token), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(token: Column | str) -> Column:
    return F.replace(F.replace(col(token), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def utc(text: Column | str) -> Column:
    """An ISO-8601 text in UTC with a final Z."""
    return F.date_format(F.to_utc_timestamp(F.to_timestamp(col(text)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds between two moments (timestamps or ISO-8601 texts); null if either isn't known."""
    at = lambda c: F.unix_seconds(F.try_to_timestamp(col(c).cast("string")))
    return at(end) - at(start)


def repository_name(locator: Column | str) -> Column:
    """owner/name of a repository's address or short name, without .git; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(col(locator)), r"^https?://[^/]+/", ""), r"(\.git)?/?$", "")
    return F.when(bare.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), bare)


# locators


def line_locator(path: Column | str, first: Column | str, last: Column | str) -> Column:
    return F.concat(col(path), F.lit(":L"), col(first).cast("string"), F.lit("-L"), col(last).cast("string"))


def location_kind(locator: Column | str) -> Column:
    c = col(locator)
    return (
        F.when(c.rlike(r"#\$path\.\w+$"), "artifact_metadata")
        .when(c.rlike(r":L\d+:C\d+-L\d+:C\d+(#.*)?$"), "text_range")
        .when(c.rlike(r":L\d+-L\d+$"), "text_lines")
        .when(c.rlike(r"#(.*/)?(entry_count|parent_count|event_count)$"), "derived_structure")
        .when(F.contains(c, F.lit("#")), "structured_value")
    )


def locator_lines(locator: Column | str) -> tuple[Column, Column]:
    """First and last line of a line or range locator; null for others."""
    pattern = r":L(\d+)(?::C\d+)?-L(\d+)(?::C\d+)?(?:#.*)?$"
    at = lambda k: F.when(col(locator).rlike(pattern), F.regexp_extract(col(locator), pattern, k).cast("int"))
    return at(1), at(2)


def kept_lines(text: Column | str) -> Column:
    """Lines with their ends, so that joined they are the text."""
    parts = F.split(col(text), r"(?<=\n)|(?<=\r)(?!\n)")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slice_rows(rows: Column | str, first: Column, last: Column) -> Column:
    """Lines first to last of kept_lines, 1-based and inclusive, ends as they were; null outside the text."""
    rows = col(rows)
    ok = (first >= 1) & (last >= first) & (last <= F.size(rows))
    return F.when(ok, F.array_join(F.slice(rows, first, last - first + 1), ""))


def slice_range(rows: Column | str, first: Column, start: Column, last: Column, end: Column) -> Column:
    """From byte `start` of a line of kept_lines to byte `end` (exclusive) of the same or a later one; null outside a line or where a character would be cut."""
    rows = col(rows)
    raw = lambda line: F.encode(F.try_element_at(rows, line), "UTF-8")
    head, tail = raw(first), raw(last)
    within = F.substring(head, start + 1, F.greatest(end - start, F.lit(0)))
    between = F.encode(F.array_join(F.slice(rows, first + 1, F.greatest(last - first - 1, F.lit(0))), ""), "UTF-8")
    across = F.concat(F.substring(head, start + 1, F.octet_length(head)), between, F.substring(tail, F.lit(1), end))
    part = F.when(first == last, within).otherwise(across)
    ok = (first >= 1) & (last >= first) & (start >= 0) & (end >= 0) & (start <= F.octet_length(head)) & (end <= F.octet_length(tail))
    return F.when(ok & F.is_valid_utf8(part), F.decode(part, "UTF-8"))
