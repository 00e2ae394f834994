"""Rule findings over modules (path, language, line_count, ordinal), symbols and edges. Each gives (rule, severity, subject, ordinal)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import naming_class
from siltstone.operators.graph import cycle_members, degrees, orphans

#: Fixed values.
DATA_FILES = r"config|schema|\.(json|yaml|yml|toml|lock)$"
STANDALONE = r"index\.|main\.|app\.|utils|helpers|lib/|config|schema|\.(json|yaml|yml|toml)$"


def _finding(rows: DataFrame, rule: str, subject: str, many: int) -> DataFrame:
    """Severity is warning from more than many rows on; many below 0: always info."""
    total = rows.agg(F.count("*").alias("__n"))
    severity = F.when((F.lit(many) >= 0) & (F.col("__n") > many), "warning").otherwise("info")
    return rows.crossJoin(F.broadcast(total)).select(F.lit(rule).alias("rule"), severity.alias("severity"), F.col(subject).alias("subject"), F.col("ordinal").cast("bigint").alias("ordinal"))


def undocumented(symbols: DataFrame) -> DataFrame:
    bare = F.col("exported") & (F.coalesce("doc_summary", F.lit("")) == "") & (F.coalesce("ai_summary", F.lit("")) == "")
    return _finding(symbols.where(bare), "undocumented", "name", 20)


def circular(edges: DataFrame) -> DataFrame:
    return _finding(cycle_members(edges).withColumn("ordinal", F.lit(0)), "circular", "node", 0)


def oversized(modules: DataFrame, lines: int = 500, symbols: int = 30) -> DataFrame:
    big = ((F.col("line_count") > lines) | (F.col("n_symbols") > symbols)) & ~F.lower("path").rlike(DATA_FILES)
    return _finding(modules.where(big), "oversized", "path", 5)


def god_modules(edges: DataFrame, most: int = 15) -> DataFrame:
    return _finding(degrees(edges).where(F.col("degree") > most).withColumn("ordinal", F.col("first_seen")), "god-module", "node", 3)


def orphaned(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _finding(orphans(nodes, edges).where(~F.lower("node").rlike(STANDALONE)), "orphan", "node", 5)


def missing_types(symbols: DataFrame) -> DataFrame:
    """One row for an exported function without a usable return type, and one more, as function(parameter), for each of its parameters (name, type) of type any."""
    f = symbols.where((F.col("language") == "typescript") & F.col("exported") & (F.col("kind") == "function"))
    no_return = (F.col("returns") == "any") | ((F.coalesce("returns", F.lit("")) == "") & ~F.coalesce("signature", F.lit("")).contains(":"))
    first = f.where(no_return).select("name", "ordinal")
    params = f.select("name", "ordinal", F.explode("parameters").alias("p")).where("p.type = 'any'").select(F.concat("name", F.lit("("), "p.name", F.lit(")")).alias("name"), "ordinal")
    return _finding(first.union(params), "missing-types", "name", 10)


def inconsistent_naming(symbols: DataFrame, least: int = 5, dominant: float = 0.6) -> DataFrame:
    """Styles that are not the most frequent and have more than two names, if there are least exports and the most frequent style has over dominant and under 95 percent of the styled ones."""
    names = symbols.where("exported").select(naming_class(F.col("name")).alias("style"), "ordinal")
    n = names.groupBy("style").agg(F.count("*").alias("n"), F.min("ordinal").alias("ordinal"))
    styled = F.when(F.col("style").isNotNull(), F.col("n"))
    facts = n.agg(F.sum("n").alias("exports"), F.sum(styled).alias("all"), F.max(styled).alias("top"), F.min(F.when(F.col("style").isNotNull(), F.struct(-F.col("n"), "ordinal", "style"))).alias("lead"))
    ratio = F.col("top") / F.col("all")
    odd = n.where("style is not null").crossJoin(F.broadcast(facts)).where((F.col("exports") >= least) & (F.col("style") != F.col("lead.style")) & (F.col("n") > 2) & (ratio > dominant) & (ratio < 0.95))
    return _finding(odd, "inconsistent-naming", "style", -1)


def deep_nesting(modules: DataFrame, depth: int = 5) -> DataFrame:
    return _finding(modules.where(F.size(F.split("path", "/")) > depth), "deep-nesting", "path", 10)


def all_rules(modules: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every rule's findings, numbered in the order of the rules."""
    found = [undocumented(symbols), circular(edges), oversized(modules), god_modules(edges), orphaned(nodes, edges), missing_types(symbols), inconsistent_naming(symbols), deep_nesting(modules)]
    out = found[0].withColumn("rule_order", F.lit(0))
    for i, f in enumerate(found[1:], 1):
        out = out.unionByName(f.withColumn("rule_order", F.lit(i)))
    return out


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos"))
