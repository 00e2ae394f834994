"""Operators that fold rows in order: page chunks, budgeted packing and capped selection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, LEAST, MOST = 300, 50, 500


def tokens(text: str) -> int:
    return -(-len(text.encode("utf-16-le", "surrogatepass")) // 8)


def sections(text: str) -> Iterator[tuple[str | None, str]]:
    """(heading, body) for each heading of level 1 to 3 and for what stands before the first."""
    heading, body = None, []
    for line in text.split("\n"):
        m = re.match(r"#{1,3}\s+(.+)$", line)
        if m:
            yield heading, "\n".join(body)
            heading, body = m[1].strip(), []
        else:
            body.append(line)
    yield heading, "\n".join(body)


def chunk_page(path: str, text: str, target: int = TARGET, overlap: int = 0) -> list[tuple[str, str | None, str, int]]:
    """(id, heading, content, tokens) of a page.

    A section of at most MOST tokens is one chunk, or none under LEAST. A longer one is cut between paragraphs at target
    tokens, each chunk after the first with the last overlap words of the one before; only the last part may be
    dropped as too short. Ids count what is given out. The first pair of --- lines, wherever it stands, goes first.
    """
    out: list[tuple[str, str | None, str, int]] = []

    def put(heading: str | None, body: str) -> str:
        body = body.strip()
        out.append((f"{path}:{len(out)}", heading, body, tokens(body)))
        return " ".join(body.split()[-overlap:]) + "\n\n" if overlap else ""

    for heading, raw in sections(re.sub(r"^---[\s\S]*?---\n*", "", text, count=1, flags=re.M)):
        body = raw.strip()
        if tokens(body) <= MOST:
            if tokens(body) >= LEAST:
                put(heading, body)
            continue
        held, n = "", 0
        for part in re.split(r"\n\n+", body):
            size = tokens(part)
            if held and n + size > MOST:
                held = put(heading, held)
                n = tokens(held)
            held, n = held + part + "\n\n", n + size
            if n >= target:
                held = put(heading, held)
                n = tokens(held)
        if held.strip() and tokens(held.strip()) >= LEAST:
            put(heading, held)
    return out


#: Characters of chunks that are handed on at once.
HANDED = 1 << 20

_CHUNKS = pa.schema([("page_path", pa.string()), ("chunk_id", pa.string()), ("chunk_ordinal", pa.int64()), ("heading", pa.string()), ("content", pa.string()), ("token_count", pa.int64())])


def chunk_batches(batches: Iterator[pa.RecordBatch], target: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of batches of pages (path, text): one page at a time is text in Python, and chunks are handed on by HANDED characters."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CHUNKS)], schema=_CHUNKS)

    for batch in batches:
        rows, held = [], 0
        for path, text in zip(batch.column(0), batch.column(1), strict=True):
            p, x = path.as_py(), text.as_py()
            for n, (i, h, c, t) in enumerate(chunk_page(p, x, target, overlap) if x else ()):
                rows.append((p, i, n, h, c, t))
                held += len(c)
                if held >= HANDED:
                    yield told(rows)
                    rows, held = [], 0
        if rows:
            yield told(rows)


def chunk_pages(pages: DataFrame, path_col: str, text_col: str, target: int = TARGET, overlap: int = 50) -> DataFrame:
    """(page_path, chunk_id, chunk_ordinal, heading, content, token_count). Pages are folded each by itself, where they are."""
    own = pages.select(F.col(path_col).cast("string").alias("p"), F.col(text_col).alias("t"))
    return own.mapInArrow(lambda batches: chunk_batches(batches, target, overlap), "page_path string, chunk_id string, chunk_ordinal bigint, heading string, content string, token_count bigint")


def sorted_fold(rows: DataFrame, group: str, order: list, columns: list[str], schema: str, fold: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """Rows of each group in order, one at a time, through a fold: fold() gives (step, finish) for a new group; step(*columns) and finish() give rows of schema without the group.

    Groups are dealt to tasks and sorted there, spilling as needed; a task holds one batch and one group's state, however large the group is.
    """
    kind = dict(rows.dtypes)[group]
    names = [group, *(c.strip().split()[0] for c in schema.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step, finish = None, None, None
        for b in batches:
            out = []
            for g, *values in b.itertuples(index=False, name=None):
                if step is None or g != key:
                    out += [(key, *r) for r in finish()] if finish else []
                    key, (step, finish) = g, fold()
                out += [(g, *r) for r in step(*values)]
            yield pd.DataFrame(out, columns=names)
        if finish:
            yield pd.DataFrame([(key, *r) for r in finish()], columns=names)

    dealt = rows.where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, *order)
    return dealt.select(group, *columns).mapInPandas(run, f"{group} {kind}, {schema}")


def greedy_context(scored: DataFrame, group: str, budget: int) -> DataFrame:
    """(group, path, size, used): files by score (then ordinal) as long as they fit; a smaller one may follow one that did not."""

    def fold():
        used = 0

        def step(path, size):
            nonlocal used
            if used >= budget or size > budget - used:
                return []
            used += size
            return [(path, size, used)]

        return step, lambda: []

    own = scored.select(group, "path", "score", "ordinal", F.col("size").cast("bigint").alias("size"))
    return sorted_fold(own, group, [F.desc("score"), "ordinal", "path"], ["path", "size"], "path string, size bigint, used bigint", fold)


def diverse_select(scored: DataFrame, group: str, most: int) -> DataFrame:
    """(group, path, place): the best by score with at most a fifth from one folder and three tenths from one top folder, then filled up in order.

    State is bounded by most: counts of folders chosen from, and the first most that were passed over.
    """
    per_leaf, per_top = max(3, ceil(most * 0.2)), max(5, ceil(most * 0.3))

    def fold():
        leaf, top, chosen, passed = {}, {}, [], []

        def step(path):
            a, b = path.rpartition("/")[0], path.split("/")[0]
            if len(chosen) < most and leaf.get(a, 0) < per_leaf and top.get(b, 0) < per_top:
                leaf[a], top[b] = leaf.get(a, 0) + 1, top.get(b, 0) + 1
                chosen.append(path)
            elif len(passed) < most:
                passed.append(path)
            return []

        return step, lambda: [(p, i) for i, p in enumerate(chosen + passed[: most - len(chosen)])]

    own = scored.select(group, "path", "score", "ordinal")
    return sorted_fold(own, group, [F.desc("score"), "ordinal", "path"], ["path"], "path string, place bigint", fold)
