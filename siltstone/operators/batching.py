"""Batches, capacity waves, caps, quotas and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.shared import placed


def fixed_batches(rows: DataFrame, group: str, order: str, size: int = 4) -> DataFrame:
    """Adds batch: rows of a group by order, size at a time."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size))


def wave_plan(rows: DataFrame, group: str, order: str, capacities: list[int]) -> DataFrame:
    """Adds wave and slot: each wave of a group fills the slots in turn, each to its capacity; a slot without capacity gets none.

    capacities is a parameter, one number for each slot, not data.
    """
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    out, total = rows.withColumn("__at", at), sum(capacities)
    slot, upto = F.lit(None).cast("int"), total
    for i in reversed(range(len(capacities))):
        slot = F.when(F.col("__at") % total < upto, i).otherwise(slot) if capacities[i] else slot
        upto -= capacities[i]
    return out.withColumns({"wave": F.floor(F.col("__at") / total), "slot": slot}).drop("__at")


def last_n(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return rows.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def first_n(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", r).where(F.col("place") <= n)


def daily_quota(events: DataFrame, user: str, ts: str, most: int) -> DataFrame:
    days = events.groupBy(user, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("over", F.col("n") > most)


def trailing_counts(events: DataFrame, user: str, ts: str, seconds: int) -> DataFrame:
    """Adds n_in_window: events of the user in the last seconds, this one included, rejected or not; so an upper bound of what a limiter sees."""
    w = Window.partitionBy(user).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_in_window", F.count("*").over(w))


def debounced(events: DataFrame, user: str, ts: str, gap_seconds: float) -> DataFrame:
    """(user, start, n): events of a user less than gap_seconds apart are one run."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(user).orderBy("__t", "event_id")
    e = events.select(user, "event_id", t.alias("__t")).withColumn("__new", (F.coalesce(F.col("__t") - F.lag("__t").over(w), F.lit(1 << 62)) >= gap_seconds * 1e6).cast("int"))
    e = e.withColumn("__s", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(user, "__s").agg(F.min("__t").alias("start_us"), F.count("*").alias("n")).drop("__s")


def first_in_interval(left: DataFrame, right: DataFrame, key: str, before: int, after: int, bucket: int) -> DataFrame:
    """For each row of left (key, id, t) the first of right (key, rid, rt), by rt and rid, with t - before <= rt <= t + after.

    Times are whole seconds; both sides are dealt by key and bucket seconds, so a busy key is spread over its buckets.
    """
    span = F.sequence(F.floor((F.col("t") - before) / bucket), F.floor((F.col("t") + after) / bucket))
    a = left.withColumn("__b", F.explode(span))
    b = right.withColumn("__b", F.floor(F.col("rt") / bucket))
    near = a.join(b, [key, "__b"]).where((F.col("rt") >= F.col("t") - before) & (F.col("rt") <= F.col("t") + after))
    best = near.groupBy("id").agg(F.min(F.struct("rt", "rid")).alias("m"))
    return best.select("id", F.col("m.rid").alias("match_id"), F.col("m.rt").alias("match_t"))


#: Headings of commit types, in order.
TYPE_LABELS = {
    "feat": "Features", "fix": "Bug Fixes", "docs": "Documentation", "refactor": "Refactoring", "test": "Tests", "chore": "Chores", "perf": "Performance", "ci": "CI/CD",
    "style": "Style", "build": "Build", "other": "Other Changes",
}


def changelog(commits: DataFrame, tags: DataFrame | None = None, *, per_type: int = 20, per_tag: int = 50) -> DataFrame:
    """(repo, tag, type_order, label, place, hash, title): commits (repo, hash, message, ordinal: newest first) under tags and headings.

    tags (repo, tag, ordinal): the newest commit of each version. A commit belongs to the last tag before or at it in its repository's log,
    per_tag of a tag at most, and is unreleased (null) before the first. Without tags: per_type of each type at most.
    """
    from siltstone.functions.text import COMMIT_TYPES, commit_type

    title = F.regexp_replace("message", rf"^({'|'.join(COMMIT_TYPES)})(\([^)]*\))?:\s*", "")
    order = F.create_map(*(F.lit(x) for i, k in enumerate(TYPE_LABELS) for x in (k, i)))[F.col("type")]
    label = F.create_map(*(F.lit(x) for kv in TYPE_LABELS.items() for x in kv))[F.col("type")]
    rows = commits.select("repo", "ordinal", "hash", commit_type(F.col("message")).alias("type"), title.alias("title"))
    none = F.lit(None).cast("string")
    if tags is None:
        rows, part, most = rows.withColumn("tag", none), ["repo", "type"], per_type
    else:
        marks = tags.select("repo", "ordinal", none.alias("hash"), none.alias("type"), none.alias("title"), F.col("tag").alias("mark"))
        w = Window.partitionBy("repo").orderBy("ordinal", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        both = rows.withColumn("mark", none).unionByName(marks).withColumn("tag", F.last("mark", ignorenulls=True).over(w))
        rows, part, most = both.where("hash is not null"), ["repo", "tag"], per_tag
    place = F.row_number().over(Window.partitionBy(*part).orderBy("ordinal", "hash"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("repo", "tag", order.alias("type_order"), label.alias("label"), "place", "hash", "title")


def top_by_severity(findings: DataFrame, n: int = 20) -> DataFrame:
    """The n gravest findings (severity, ordinal): critical, warning, info; ties in order."""
    grave = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return findings.withColumn("grave", grave).orderBy("grave", "ordinal").limit(n).drop("grave")


def newest_versions(tags: DataFrame, most: int) -> DataFrame:
    """The last most version tags (tag, ordinal), newest first as place 1."""
    from siltstone.operators.modules import is_version_tag

    w = Window.orderBy(F.desc("ordinal"))
    best = tags.where(is_version_tag(F.col("tag"))).orderBy(F.desc("ordinal")).limit(most)
    return best.withColumn("place", F.row_number().over(w)).select("tag", "place")


def navigation(pages: DataFrame) -> DataFrame:
    """Adds group_order and place to pages (path, title, nav_group, nav_order): groups by their least order, pages within by order, then title whatever its case, then path."""
    groups = pages.groupBy("nav_group").agg(F.min("nav_order").alias("first_order"))
    ranked = groups.withColumn("group_order", F.row_number().over(Window.orderBy("first_order", "nav_group")))
    own = placed(pages, ["nav_group"], ["nav_order", F.lower("title"), "title", "path"], "place")
    return own.join(ranked.select("nav_group", "group_order"), "nav_group")


def path_lists(files: DataFrame, group: str) -> DataFrame:
    """(group, n, digest, listing): sorted paths of a group, one a line. For groups of folder size; the listing is one text."""
    paths = F.array_sort(F.collect_set("path"))
    return files.groupBy(group).agg(paths.alias("p")).select(group, F.size("p").cast("bigint").alias("n"), F.array_join("p", "\n").alias("listing"))
