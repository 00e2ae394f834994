"""Links from names in prose and in types to the pages that document them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.resolve import TYPE_KINDS, documented_at

#: A capitalised name in backticks, and what stands before it since the last one; at the text's end, what is left.
_NAMED = r"(?s)(.*?)(?:`([A-Z][a-zA-Z0-9_]+)`|\z)"


def relative_path(page: Column, to: Column) -> Column:
    """The way from a page's folder to another page; both are paths from one root, without dots."""
    here = F.when(page.contains("/"), F.split(F.regexp_replace(page, "/[^/]*$", ""), "/")).otherwise(F.array().cast("array<string>"))
    there = F.split(to, "/")
    common = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.size(here), F.size(there))), lambda k: F.slice(here, F.lit(1), k) == F.slice(there, F.lit(1), k)))
    return F.concat(F.repeat(F.lit("../"), F.size(here) - common), F.array_join(F.slice(there, common + 1, F.size(there)), "/"))


def name_anchor(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "")


def linkable_pages(symbols: DataFrame, kinds: tuple[str, ...] = TYPE_KINDS) -> DataFrame:
    """(name, page, place): where exported symbols of some kinds are documented: the last one of a name wins, its place is the first one's ordinal."""
    own = symbols.where(F.col("exported") & F.col("kind").isin(*kinds))
    return own.groupBy("name").agg(F.max_by(documented_at("path"), "ordinal").alias("page"), F.min("ordinal").alias("place"))


def _row_key(*columns: str) -> tuple[Column, Column]:
    told = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(1), *told).alias("__k1"), F.xxhash64(F.lit(2), *told).alias("__k2")


def linked_names(texts: DataFrame, pages: DataFrame, *, text_col: str = "text", page_col: str = "page") -> DataFrame:
    """texts with n_links, and with the first place of each known name in backticks made a link to the name's page in pages (name, page).

    A text is cut at its names once. Each name's first place meets pages by name, one row a text and name, so a name that every text
    has is a join of many rows to one; what is known goes back to its text as a sorted list of places, and the text is put together
    from the stretches between these. A name isn't linked if its first place stands right after [, if its page is the text's own, or if it
    shares a backtick with a name before. Null text stays null with no links; a null page has every other page as target, by its path from
    the root. Repeated rows are linked alike.
    """
    text, own = F.col(text_col), F.col(page_col)
    rows = texts.select(F.struct("*").alias("row"), text.alias("__t"), own.alias("__own"))
    rows = rows.select("row", "__t", "__own", *_row_key("__t", "__own"))
    cut = [F.regexp_extract_all("__t", F.lit(_NAMED), F.lit(g)) for g in (1, 2)]
    at = F.posexplode(F.arrays_zip(cut[0].alias("gap"), cut[1].alias("name")))
    told = rows.where(F.col("__t").contains("`")).select("__k1", "__k2", "__own", at.alias("j", "c")).where("c.name <> ''")
    first = told.groupBy("__k1", "__k2", "__own", F.col("c.name").alias("name")).agg(F.min(F.struct("j", F.endswith("c.gap", F.lit("[")).alias("inside"))).alias("f")).where("not f.inside")
    met = first.join(pages.select("name", F.col("page").alias("__to")), "name").where("__own is null or __to <> __own")
    link = F.concat(F.lit("[`"), "name", F.lit("`]("), F.coalesce(relative_path(F.col("__own"), F.col("__to")), "__to"), F.lit("#"), name_anchor(F.col("name")), F.lit(")"))
    links = met.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list(F.struct(F.col("f.j").alias("j"), link.alias("link")))).alias("__links"))
    parts = rows.join(links, ["__k1", "__k2"], "left").withColumns({"__gaps": cut[0], "__names": cut[1]})
    plain = F.zip_with("__gaps", "__names", lambda g, n: F.when(n == "", g).otherwise(F.concat(g, F.lit("`"), n, F.lit("`"))))
    whole = parts.withColumn("__plain", plain)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("__links", i - 1)["j"])
    stretch = lambda x, i: F.concat(F.array_join(F.slice("__plain", before(i) + 2, x["j"] - before(i) - 1), ""), F.get("__gaps", x["j"]), x["link"])
    last = F.element_at("__links", -1)["j"]
    rest = F.array_join(F.slice("__plain", last + 2, F.size("__plain")), "")
    done = F.when(F.col("__links").isNull(), F.col("__t")).otherwise(F.concat(F.array_join(F.transform("__links", stretch), ""), rest))
    out = whole.withColumn("__done", done).withColumn("n_links", F.coalesce(F.size("__links"), F.lit(0)).cast("bigint"))
    same = [F.col("__done").alias(c) if c.lower() == text_col.lower() else F.col("row")[c].alias(c) for c in texts.columns if c.lower() != "n_links"]
    return out.select(*same, "n_links")


def linked_types(types: DataFrame, pages: DataFrame, *, type_col: str = "type", page_col: str = "page") -> DataFrame:
    """types (type, page of the text) with linked: the type as code, or, if it names a known symbol, with that name's first place as a link.

    Of several known names the one that comes first in pages (name, page, place) is linked. Without a page of its own, ways lead from a folder beside the root's.
    Distinct types meet pages by the words in them. Null types stay null.
    """
    each = types.select(F.col(type_col).alias("__type"), F.col(page_col).alias("__own")).where("__type is not null").distinct()
    words = each.select("__type", "__own", F.explode(F.array_distinct(F.regexp_extract_all("__type", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    best = words.join(pages.select("name", F.col("page").alias("__to"), "place"), "name").groupBy("__type", "__own").agg(F.min_by(F.struct("name", "__to"), "place").alias("n"))
    name = F.col("n.name")
    way = F.when(F.col("__own").isNull(), F.concat(F.lit("../"), "n.__to")).otherwise(relative_path(F.col("__own"), F.col("n.__to")))
    head = F.regexp_extract_all("__type", F.concat(F.lit(r"(?s)\A(.*?)(?<![A-Za-z0-9_])"), name, F.lit("(?![A-Za-z0-9_])")), F.lit(1))[0]
    link = F.concat(head, F.lit("["), name, F.lit("]("), way, F.lit("#"), name_anchor(name), F.lit(")"), F.substr("__type", F.length(head) + F.length(name) + 1))
    known = best.select(F.col("__type").alias("__t2"), F.col("__own").alias("__o2"), link.alias("__linked"))
    same = (F.col(type_col) == F.col("__t2")) & F.col(page_col).eqNullSafe(F.col("__o2"))
    code = F.concat(F.lit("`"), F.col(type_col), F.lit("`"))
    return types.join(known, same, "left").withColumn("linked", F.coalesce("__linked", code)).drop("__t2", "__o2", "__linked")
