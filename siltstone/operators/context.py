"""Context for a question about a code base: scores of modules, and texts packed into a budget of tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import logical_section
from siltstone.operators.graph import degrees, neighbour_scores

#: A part of a text is taken where more than so many tokens are left, and kept if it has more than so many.
LEAST_LEFT, LEAST_PART = 100, 20
#: The target's share of the budget.
TARGET_SHARE = 0.4


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def target_scores(modules: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """(path, score, ordinal) of other modules: 1.0 linked with the target, 0.6 two steps the same way, 0.4 in its folder, 0.3 in its section, 0.2 documentation."""
    own = modules.sparkSession.createDataFrame([(target,)], "node string")
    near = neighbour_scores(edges, own).select(F.col("node").alias("path"), F.col("score").alias("near"))
    lower, section = F.lower("path"), logical_section(F.lit(target), fallback=False)
    rest = (
        F.when(_folder(F.col("path")) == _folder(F.lit(target)), 0.4)
        .when((section != "") & (logical_section(F.col("path"), fallback=False) == section), 0.3)
        .when(lower.contains("readme") | lower.contains("doc"), 0.2)
    )
    scored = modules.where(F.col("path") != target).join(near, "path", "left").select("path", F.coalesce("near", rest).alias("score"), "ordinal")
    return scored.where("score > 0")


def topic_scores(modules: DataFrame, symbols: DataFrame, topic: str) -> DataFrame:
    """(path, score, ordinal): the most of 0.8 for a word of the topic in the path, 0.7 for one in a symbol's name, 0.5 for a readme."""
    words = topic.lower().split() or [""]
    told = lambda c: reduce(Column.__or__, [F.lower(c).contains(w) for w in words])
    named = symbols.where(told(F.col("name"))).select("path").distinct().withColumn("named", F.lit(0.7))
    path = F.greatest(F.when(told(F.col("path")), 0.8).otherwise(0.0), F.when(F.lower("path").contains("readme"), 0.5).otherwise(0.0), F.coalesce("named", F.lit(0.0)))
    return modules.join(named, "path", "left").select("path", path.alias("score"), "ordinal").where("score > 0")


def connection_scores(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, score, ordinal): a tenth for each edge, 1 at most."""
    by = degrees(edges).select(F.col("node").alias("path"), F.least(F.col("degree") / 10, F.lit(1.0)).alias("score"))
    return modules.join(by, "path").select("path", "score", "ordinal")


def tokens(text: str) -> int:
    return -(-len(text.encode("utf-16-le", "surrogatepass")) // 8)


def best_window(text: str, names: list[str], budget: int) -> str:
    """The run of lines within budget that names occur in most often; the whole text if it fits.

    As many lines as the budget holds on average; a window starts three tenths of its length, 25 lines at most, before the last one's end.
    Of equal ones the first; what is still too large loses lines at its end.
    """
    lines = text.split("\n")
    most = int(budget // max(1, tokens(text) / len(lines)))
    if most >= len(lines):
        return text
    if most <= 0:
        return ""
    step = max(1, most - min(int(most * 0.3), 25))
    starts = [0]
    while starts[-1] + most < len(lines):
        starts.append(starts[-1] + step)
    windows = ["\n".join(lines[s : s + most]) for s in starts]
    chosen = max(windows, key=lambda w: sum(w.count(n) for n in names if n)).split("\n")
    while len(chosen) > 1 and tokens("\n".join(chosen)) > budget:
        chosen.pop()
    return "\n".join(chosen)


def pack(target: tuple[str, list[str]] | None, files: Iterator[tuple[str, float, list[str]]], budget: int) -> Iterator[tuple[int, str, float]]:
    """(place, content, score) of texts in order that fit: whole, or their best window. The target, first, may take TARGET_SHARE of the budget. Place -1 is the target."""
    used = 0
    if target is not None:
        text, names = target
        content = text if tokens(text) <= budget * TARGET_SHARE else best_window(text, names, int(budget * TARGET_SHARE))
        used = tokens(content)
        yield -1, content, 1.0
    for at, (text, score, names) in enumerate(files):
        if used >= budget:
            return
        left = budget - used
        if tokens(text) <= left:
            used += tokens(text)
            yield at, text, score
        elif left > LEAST_LEFT:
            part = best_window(text, names, left)
            if tokens(part) > LEAST_PART:
                used += tokens(part)
                yield at, part, score


def build_context(scored: DataFrame, texts: DataFrame, budget: int, *, group: str, target: str | None = None) -> DataFrame:
    """(group, path, place, content, score, used) for each group of scored (group, path, score, ordinal); texts (path, text, names).

    Groups are dealt to tasks and folded as a stream in order of score, then ordinal; once a group's budget is full the rest of it is only
    passed over, so a task holds one text at a time. A target is in place 0 and in no other.
    """
    kind = dict(scored.dtypes)[group]
    rows = scored.where(F.col("path") != target) if target is not None else scored
    rows = rows.select(group, "path", "score", F.col("ordinal").cast("bigint").alias("ordinal"), F.lit(1).alias("turn"))
    if target is not None:
        rows = rows.unionByName(rows.select(group).distinct().select(group, F.lit(target).alias("path"), F.lit(1.0).alias("score"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).alias("turn")))
    rows = rows.join(texts.select("path", "text", "names"), "path").where("text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used, place = object(), 0, 0
        for b in batches:
            out = []
            for g, path, score, turn, text, names in b.itertuples(index=False):
                if g != key:
                    key, used, place = g, 0, 0
                if used >= budget:
                    continue
                one = (text, list(names) if names is not None else [])
                found = list(pack(one, iter(()), budget) if turn == 0 else pack(None, iter([(one[0], score, one[1])]), budget - used))
                for _, content, s in found:
                    used += tokens(content)
                    out.append((g, path, place, content, s, used))
                    place += 1
            yield pd.DataFrame(out, columns=[group, "path", "place", "content", "score", "used"])

    dealt = rows.repartition(group).sortWithinPartitions(group, "turn", F.desc("score"), "ordinal", "path").select(group, "path", "score", "turn", "text", "names")
    return dealt.mapInPandas(run, f"{group} {kind}, path string, place int, content string, score double, used bigint")
