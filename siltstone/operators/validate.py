"""Checks of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines with template leftovers.
ARTIFACTS = (r"YOUR_", r"TODO:", r"PLACEHOLDER", r"\[INSERT", r"\{\{.*\}\}")
#: Least characters by kind of page.
MIN_LENGTH = {"overview": 200, "architecture": 200, "module": 100, "getting-started": 200, "concept": 100}


def clean_prose(text: Column) -> Column:
    for a in ARTIFACTS:
        text = F.regexp_replace(text, rf"(?m)^.*{a}.*$", "")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def long_enough(text: Column, kind: Column) -> Column:
    least = F.lit(100)
    for k, n in MIN_LENGTH.items():
        least = F.when(kind == k, n).otherwise(least)
    return F.length(clean_prose(text)) >= least


def unfenced(text: Column) -> Column:
    """Without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*\n?", ""), r"\n?\s*```\s*$", "")


def batch_response(text: Column, names: list[str] | None = None) -> Column:
    """struct<module, symbols>: a JSON object's module and its other non-empty entries (of names), with or without a code fence; what is no JSON object is the module's, whole."""
    bare = unfenced(text)
    told = F.from_json(bare, "map<string,string>")
    wanted = lambda k, v: (v != "") & (k.isin(*names) if names is not None else k != "module")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(F.when(told.isNull(), bare).otherwise(F.coalesce(told["module"], F.lit(""))).alias("module"), F.coalesce(F.map_filter(told, wanted), none).alias("symbols"))


def files_response(text: Column, paths: Column) -> Column:
    """map of the paths (array) that a JSON object has non-empty entries for; empty if it is none."""
    told = F.coalesce(F.from_json(unfenced(text), "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.map_filter(told, lambda k, v: (v != "") & F.array_contains(paths, k))


def answer_citations(answer: Column, title: Column) -> Column:
    """Whether a word of more than three characters of the title is in the answer."""
    return F.exists(F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) > 3), lambda w: F.lower(answer).contains(w))


def with_provenance(text: Column, sources: Column, title: Column, project: str, repository: str | None = None, branch: str = "main") -> Column:
    """A block of sources (array of paths) before the text, unless it has a details block already."""
    link = lambda f: F.concat(F.lit("- [`"), f, F.lit(f"`]({(repository or '').rstrip('/')}/blob/{branch}/"), f, F.lit(")"))
    item = lambda f: link(f) if repository else F.concat(F.lit("- `"), f, F.lit("`"))
    head = F.concat(F.lit('<details>\n<summary>Sources for "'), title, F.lit(f'" in {project}</summary>\n\n'))
    return F.when(text.contains("<details>"), text).otherwise(F.concat(head, F.array_join(F.transform(sources, item), "\n"), F.lit("\n\n</details>\n"), text))


def one_page_each(rows: DataFrame, page: str) -> DataFrame:
    return rows.groupBy(page).agg(F.min("ordinal").alias("ordinal"))


#: First words of diagrams.
DIAGRAMS = ("flowchart", "graph", "sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram", "gantt", "pie", "mindmap", "timeline")
_LABEL = r"""([A-Za-z0-9_]+)\[([^\]"]*[(){}:;'<>][^\]"]*)\]"""


def diagram_blocks(text: Column) -> Column:
    """array<string>: what stands in code fences, trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"```(?:mermaid)?\n?([\s\S]*?)```"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def diagram_check(code: Column, most_nodes: int = 20) -> Column:
    """struct<kind, n_errors, fixed>: a known first word, subgraphs closed, labels with special characters quoted, top-down, not too many nodes. fixed mends all but the first and last."""
    first = F.trim(F.get(F.split(F.regexp_replace(code, r"^\s+", ""), "\n"), F.lit(0)))
    known = first.rlike("^(" + "|".join(DIAGRAMS) + ")")
    open_ = F.greatest(F.regexp_count(code, F.lit(r"\bsubgraph\b")) - F.regexp_count(code, F.lit(r"(?m)^\s*end\s*$")), F.lit(0))
    labels, sideways = F.regexp_count(code, F.lit(_LABEL)), code.rlike(r"(?i)flowchart\s+LR")
    nodes = F.size(F.array_distinct(F.regexp_extract_all(code, F.lit(r"([A-Za-z0-9_]+)[\[({]"), F.lit(1))))
    crowded = first.rlike("^(flowchart|graph)") & (nodes > most_nodes)
    closed = F.concat(code, F.repeat(F.lit("\n    end"), open_))
    fixed = F.regexp_replace(F.regexp_replace(closed, _LABEL, '$1["$2"]'), r"(?i)flowchart\s+LR", "flowchart TD")
    kind = F.when(first.startswith("sequenceDiagram"), "sequence").when(first.startswith("classDiagram"), "class").otherwise("flowchart")
    errors = F.when(known, 0).otherwise(1) + F.when(open_ > 0, 1).otherwise(0) + labels + F.when(sideways, 1).otherwise(0) + F.when(crowded, 1).otherwise(0)
    return F.struct(kind.alias("kind"), errors.cast("int").alias("n_errors"), fixed.alias("fixed"))


def structure_pages(plans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, page, title, description, importance, files, related) of each page element in a text's first wiki_structure element."""
    body = F.regexp_extract(text_col, r"<wiki_structure>([\s\S]*?)</wiki_structure>", 1)
    page = r'<page\s+id="([^"]*)">([\s\S]*?)</page>'
    both = F.arrays_zip(F.regexp_extract_all(body, F.lit(page), F.lit(1)).alias("page"), F.regexp_extract_all(body, F.lit(page), F.lit(2)).alias("body"))
    rows = plans.select(id_col, F.posexplode(both).alias("place", "p")).select(id_col, "place", "p.page", "p.body")
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    one = lambda tag: bare(F.regexp_extract("body", rf"<{tag}>([\s\S]*?)</{tag}>", 1))
    all_ = lambda tag: F.transform(F.regexp_extract_all("body", F.lit(rf"<{tag}>([\s\S]*?)</{tag}>"), F.lit(1)), bare)
    title, weight = one("title"), one("importance")
    return rows.select(
        id_col, "place", "page", F.when(title == "", F.col("page")).otherwise(title).alias("title"), one("description").alias("description"),
        F.when(weight.isin("high", "medium", "low"), weight).otherwise("medium").alias("importance"), all_("file_path").alias("files"), all_("related").alias("related"),
    )


def first_lines(text: Column, most: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, most), "\n")


def file_sections(files: DataFrame, group: str, order: str, most: int = 50) -> DataFrame:
    """(group, prompt): the first lines of each file (path, language, line_count, text) of a group under a heading, in order. A group is a request's few files."""
    one = F.concat(F.lit("## "), "path", F.lit(" ("), "language", F.lit(", "), F.col("line_count").cast("string"), F.lit(" lines)\n```\n"), first_lines(F.col("text"), most), F.lit("\n```"))
    all_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("s"))))
    return files.groupBy(group).agg(F.array_join(F.transform(all_, lambda x: x["s"]), "\n\n").alias("prompt"))
