"""Names, packages, languages and roles that follow from source paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories of a technical layer, and generic roots.
ROLE_DIRS = "services service controllers controller routes route api apis handlers handler views view urls endpoints resources".split()
ROOT_DIRS = "src lib app pkg internal source sources main cmd".split()
# Languages by extension.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".c": "c", ".h": "c", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin",
    ".cs": "csharp", ".scala": "scala", ".php": "php", ".lua": "lua", ".toc": "toc", ".f": "fortran", ".f90": "fortran", ".f95": "fortran", ".f03": "fortran", ".f08": "fortran",
}
# Endings that make a label a path; kinds that are no component; kinds that refer elsewhere.
CODE_ENDINGS = (".py", ".java", ".kt", ".ts", ".tsx", ".js", ".jsx", ".go", ".rb", ".cs")
NON_COMPONENT_KINDS = ("file", "module", "import", "variable")
REFERENCE_KINDS = ("import", "external", "file", "module", "variable")
TEST_DIRS = ("tests", "test", "testing", "__tests__")
ROLE_ENDING = r"(?i)[_-]?(service|controller|routes?|handler|view|api)$"
LOCATION = r"L?(\d+)(?:\s*-\s*L?(\d+))?"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension; a leading dot is no extension."""
    return F.regexp_replace(base_name(path), r"(?<=[^/])\.[^./]+$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def package_key(path: Column) -> Column:
    """The directory of a file, or <root>."""
    d = directory(path)
    return F.when(path.isNull() | (path == "") | d.isin("", "."), F.lit("<root>")).otherwise(d)


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)


def capability(path: Column) -> Column:
    """The nearest directory that names no layer or root, else the stem without its role ending."""
    parts = F.filter(F.split(directory(path), "/"), lambda p: ~p.isin("", ".") & ~F.lower(p).isin(*ROLE_DIRS, *ROOT_DIRS))
    bare = F.regexp_replace(file_stem(path), ROLE_ENDING, "")
    own = F.when(bare != "", bare).otherwise(file_stem(path))
    return F.when(path.isNull() | (path == ""), F.lit(None)).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), own))


def title_case(name: Column) -> Column:
    words = F.filter(F.split(F.trim(name), r"[_\-.\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("root")).otherwise(s)


def join_parts(parts: Column) -> Column:
    """Title-case words of path segments with a space between, immediate repeats once."""
    named = F.filter(F.transform(parts, title_case), lambda w: w != "")
    once = F.filter(named, lambda w, i: (i == 0) | (w != F.get(named, i - 1)))
    return F.array_join(once, " ")


def looks_like_path(text: Column) -> Column:
    out = text.contains("/")
    for e in CODE_ENDINGS:
        out = out | text.endswith(e)
    return out


def clean_name(label: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.regexp_replace(label, r"(?s)\(.*$", "")), r"^\.+", "")
    last = F.element_at(F.split(bare, r"\."), -1)
    return F.when(looks_like_path(label), file_stem(label)).otherwise(F.when(last != "", last).otherwise(label))


def baseline_kind(label: Column) -> Column:
    return F.when(looks_like_path(label), "file").when(label.contains("("), "function").when(label.rlike(r"^\p{Lu}[\p{L}\p{N}_]*$"), "class")


def line_range(location: Column) -> tuple[Column, Column]:
    """(start, end) of the first L?n or L?n-L?m; null where there is none."""
    number = lambda g: F.nullif(F.regexp_extract(location, LOCATION, g), F.lit("")).try_cast("int")
    return number(1), number(2)


def is_test_file(path: Column) -> Column:
    """Segment-wise: a test directory, or a stem that begins test_ or ends _test."""
    stem = file_stem(path)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_DIRS))) | stem.startswith("test_") | stem.endswith("_test")


def role(path: Column, label: Column, kind: Column) -> Column:
    """controller, api or service, in this order; null for other kinds, test files and the rest."""
    p, name = F.lower(F.coalesce(path, F.lit(""))), F.lower(label)
    parts, stem = F.split(p, "/"), file_stem(p)
    among = lambda *x: F.arrays_overlap(parts, F.array(*map(F.lit, x)))
    return (
        F.when(F.coalesce(kind, F.lit("")).isin(*NON_COMPONENT_KINDS) | is_test_file(p), F.lit(None))
        .when(among("controllers") | stem.contains("controller") | name.endswith("controller") | name.endswith("handler"), "controller")
        .when(among("routes", "route", "urls", "endpoints", "api", "apis") | stem.isin("routes", "urls", "endpoints", "route") | name.contains("route") | name.contains("endpoint"), "api")
        .when(among("services", "service") | stem.endswith("service") | stem.contains("_service") | name.endswith("service"), "service")
    )


def component_name(path: Column, suffix: str) -> Column:
    title = title_case(F.coalesce(capability(path), F.lit("Component")))
    return F.when(F.lower(title).endswith(suffix.lower()), title).otherwise(F.concat(title, F.lit(suffix)))


def sql_technology(path: Column) -> Column:
    p = F.lower(path)
    name = base_name(path)
    return F.when(p.contains("changelog"), "liquibase").when(p.contains("/db/migration/") | (name.startswith("V") & name.contains("__")), "flyway").otherwise("raw-sql")


def module_dotted(path: Column) -> Column:
    """The dotted module of a Python file; a package's __init__ is the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")


def file_tokens(path: Column) -> Column:
    words = F.filter(F.split(F.lower(path), r"[/_.\-]+"), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(F.lit("py")))


def ascii_lower(text: Column) -> Column:
    """Folds A to Z alone, as a case-insensitive lookup of the ASCII kind does."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
