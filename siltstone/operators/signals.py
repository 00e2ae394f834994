"""What users of a code base meet: commands, routes, options, errors and components, from a table of symbols.

Symbols: file_path, sym_ordinal, id, parent_id, name, kind, exported, extends, decorators array<string>, parameters
array<string>, summary, type_annotation, module_doc. A null in any of these never matches. Results: signal, file_path,
sym_ordinal, name, detail, description.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
VERBS = ("get", "post", "put", "delete", "patch")
#: Parameter names that say nothing to a user.
GENERIC = ("options", "opts", "args", "config", "ctx", "context", "req", "res", "next")


# Each predicate reads the path once: a filter is moved below the projection that makes the path, and makes it anew for each use.


def is_cli(path: Column) -> Column:
    """In a folder of commands, or the entry file of a cli folder."""
    return F.lower(path).rlike(r"(?s)commands/|bin/|cmd/|^(?!.*(?:flows|utils)/)(?=.*cli/)(?:.*/)?(?:index|main)\.(?:ts|js)\z")


def is_route(path: Column) -> Column:
    return F.lower(path).rlike("routes/|controllers/|handlers/|endpoints/")


def is_config(path: Column) -> Column:
    return F.lower(path).rlike("config|schema|settings")


def is_component(path: Column) -> Column:
    return path.rlike(r"(?i:components/|views/|widgets/)|\.(tsx|jsx|vue|svelte)$")


def route_verb(name: Column, decorators: Column) -> Column:
    """The first verb that starts the name or occurs in a decorator, in upper case; else null."""
    out, told = None, F.lower(F.array_join(decorators, "\n"))
    for v in VERBS:
        hit = F.lower(name).startswith(v) | F.coalesce(told.contains(v), F.lit(False))
        out = out.when(hit, v.upper()) if out is not None else F.when(hit, v.upper())
    return out


def route_path(name: Column) -> Column:
    """getUserById: /user/by/id."""
    rest = F.regexp_replace(name, f"(?i)^({'|'.join(VERBS)})", "")
    low = F.concat(F.lower(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2)))
    return F.concat(F.lit("/"), F.lower(F.regexp_replace(low, "([A-Z])", "/$1")))


def useful_options(parameters: Column) -> Column:
    """Parameter names but for the generic ones; null where none stays."""
    kept = F.filter(parameters, lambda p: ~F.lower(p).isin(*GENERIC))
    return F.when(F.size(kept) > 0, kept)


def module_description(doc: Column) -> Column:
    """The lines of a module's doc in one, without a leading "... CLI - command" line; empty: null."""
    lines = F.filter(F.transform(F.split(doc, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    header = F.get(lines, F.lit(0)).rlike(r"(?i)^[\w\s]+cli\s*[—–-]")
    text = F.array_join(F.when((F.size(lines) > 1) & header, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines), " ")
    return F.nullif(text, F.lit(""))


def _shown(rows: DataFrame, signal: str, name: Column, detail: Column, description: Column) -> DataFrame:
    return rows.select(F.lit(signal).alias("signal"), "file_path", "sym_ordinal", name.alias("name"), detail.cast("string").alias("detail"), description.alias("description"))


# Conditions with the cheap parts first, so that few rows' paths are looked at.


def _is_command() -> Column:
    name, summary = F.lower("name"), F.lower("summary")
    named = name.contains("command") | name.contains("cmd") | F.coalesce(summary.contains("command"), F.lit(False))
    return F.col("exported") & F.col("kind").isin("function", "variable", "constant") & named & is_cli(F.col("file_path"))


def _is_routed() -> Column:
    return route_verb(F.col("name"), F.col("decorators")).isNotNull() & is_route(F.col("file_path"))


def _is_error() -> Column:
    base = F.coalesce(F.col("extends").endswith("Error"), F.lit(False))
    return (F.col("kind") == "class") & (base | F.col("name").endswith("Error") | F.col("name").endswith("Exception"))


def _is_shown() -> Column:
    return F.col("exported") & F.col("kind").isin("component", "function", "class") & F.col("name").rlike("^[A-Z]") & is_component(F.col("file_path"))


def cli_commands(symbols: DataFrame) -> DataFrame:
    from siltstone.functions.text import kebab_case

    raw = F.regexp_replace(F.regexp_replace("name", "(?i)(command|cmd)$", ""), "(?i)^register", "")
    return _shown(symbols.where(_is_command()), "command", kebab_case(raw), F.array_join(useful_options(F.col("parameters")), ","), F.coalesce(F.nullif("summary", F.lit("")), module_description(F.col("module_doc"))))


def routes(symbols: DataFrame) -> DataFrame:
    return _shown(symbols.where(_is_routed()), "route", route_path(F.col("name")), route_verb(F.col("name"), F.col("decorators")), F.col("summary"))


def config_options(symbols: DataFrame) -> DataFrame:
    """Children, with a type or a description, of exported interfaces, types and constants in the same file."""
    own = is_config(F.col("file_path"))
    parents = symbols.where(F.col("exported") & F.col("kind").isin("interface", "type", "constant") & own).select("file_path", F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    told = (F.coalesce("type_annotation", F.lit("")) != "") | (F.coalesce("summary", F.lit("")) != "")
    return _shown(symbols.where(F.col("parent_id").isNotNull() & told & own).join(parents, ["file_path", "parent_id"]), "option", F.concat_ws(".", "parent", "name"), F.col("type_annotation"), F.col("summary"))


def error_types(symbols: DataFrame) -> DataFrame:
    return _shown(symbols.where(_is_error()), "error", F.col("name"), F.col("extends"), F.col("summary"))


def components(symbols: DataFrame) -> DataFrame:
    return _shown(symbols.where(_is_shown()), "component", F.col("name"), F.array_join("parameters", ","), F.col("summary"))


def counts(symbols: DataFrame) -> DataFrame:
    """(signal, n) of all_signals(): all but the options, which need a join, are counted in one pass."""
    kinds = {"command": _is_command(), "route": _is_routed(), "error": _is_error(), "component": _is_shown()}
    sums = symbols.agg(*(F.count_if(hit).alias(kind) for kind, hit in kinds.items()))
    each = sums.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("signal"), F.col(kind).alias("n")) for kind in kinds))).alias("x")).select("x.signal", "x.n")
    options = config_options(symbols).groupBy("signal").agg(F.count("*").alias("n"))
    return each.where("n > 0").unionByName(options)


def all_signals(symbols: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(symbols) for f in (cli_commands, routes, config_options, error_types, components)])
