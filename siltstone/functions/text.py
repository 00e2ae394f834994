"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might shall can this that these those it its not no so if as up out about into over after then than also"
).split()
#: Section names and the path segments that put a file there, in order of precedence.
SECTIONS = {
    "CLI": ["cli", "commands", "bin"],
    "Core": ["core", "engine", "kernel"],
    "Configuration": ["config", "configuration", "settings"],
    "Analysis": ["analysis", "parsers", "ast"],
    "Models": ["models", "entities", "schemas", "types"],
    "Services": ["services", "providers", "adapters"],
    "Routes": ["routes", "controllers", "handlers", "endpoints", "api"],
    "Components": ["components", "views", "pages", "layouts", "widgets"],
    "Hooks": ["hooks", "composables"],
    "Utilities": ["utils", "helpers", "lib", "common", "shared"],
    "Generators": ["generators", "templates", "renderers"],
    "Sync": ["sync", "replication"],
    "Deploy": ["deploy", "deployment", "providers"],
    "Tests": ["tests", "test", "__tests__", "spec"],
    "Middleware": ["middleware"],
    "Database": ["database", "db", "repositories", "dao"],
}
COMMIT_TYPES = ("feat", "fix", "docs", "refactor", "test", "chore", "perf", "ci", "style", "build")


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def composite_hash(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def line_count(text: Column) -> Column:
    """Parts between line feeds: 1 for an empty text."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up."""
    return F.ceil(utf16_length(text) / 4)


def tokenize(text: Column) -> Column:
    """Lower-cased alphanumeric words of two or more characters, without stopwords; repeats stay."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def logical_section(path: Column, fallback: bool = True) -> Column:
    """The first section, in order, that has any segment of the path; else the parent folder, capitalised, or API Reference."""
    parts = F.split(F.lower(path), "/")
    out = None
    for name, segments in SECTIONS.items():
        hit = F.arrays_overlap(parts, F.array(*map(F.lit, segments)))
        out = out.when(hit, name) if out is not None else F.when(hit, name)
    if not fallback:
        return out.otherwise("")
    own = F.split(path, "/")
    parent = F.element_at(own, -2)
    return out.when(F.size(own) > 1, F.concat(F.upper(F.substring(parent, 1, 1)), F.substr(parent, F.lit(2)))).otherwise("API Reference")


def directory_cluster(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def package_name(source: Column) -> Column:
    """@scope/pkg or the first segment."""
    parts = F.split(source, "/")
    return F.when(source.startswith("@"), F.concat_ws("/", parts[0], F.get(parts, F.lit(1)))).otherwise(parts[0])


def commit_type(message: Column) -> Column:
    found = F.regexp_extract(message, rf"^({'|'.join(COMMIT_TYPES)})(\([^)]*\))?:", 1)
    return F.when(found == "", "other").otherwise(found)


def naming_class(name: Column) -> Column:
    return (
        F.when(name.rlike("^[a-z][a-zA-Z0-9]*$"), "camelCase")
        .when(name.rlike("^[A-Z][a-zA-Z0-9]*$"), "PascalCase")
        .when(name.rlike("^[a-z][a-z0-9_]*$"), "snake_case")
    )


def kebab_case(name: Column) -> Column:
    """listAPIKeys: list-api-keys. Digits and other characters part nothing."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2"))


def anchor(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\w\s-]", ""), r"\s+", "-")


def word_bucket(word: Column, buckets: int = 256) -> Column:
    """h = 31 h + c over the characters in 32-bit arithmetic, absolute, modulo buckets."""
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295)))
    return (F.abs(F.when(h >= 2147483648, h - 4294967296).otherwise(h)) % buckets).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths and for a vector without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
