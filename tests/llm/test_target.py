import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import target as T


def features(text, longest):
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return words, [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, goal, longest, n_buckets, percent, least):
    of = lambda texts: Counter(zlib.crc32(f) % n_buckets for t in texts for f in features(t, longest)[1])
    s, t = of(x for _, x in docs), of(goal)
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + n_buckets) / ((s[b] + 1) * (t_all + n_buckets))))
    out = []
    for i, text in docs:
        words, f = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(x) % n_buckets) for x in f)
        out.append([i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(str, map(tuple, out)))


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_like_brute_force(spark, sf_dir, longest, percent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [(900, "Ärger ÄB x_y-z " * 9), (901, None), (902, ""), (None, "one two " * 12), (903, "  "), (904, " a b"), (904, " a b")]
    goal = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None, ""]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, rank int, score string").repartition(3)
    got = T.resample(docs, spark.createDataFrame([(t,) for t in goal], "text string"), longest=longest, n_buckets=1000, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == brute(rows, goal, longest, 1000, percent, 20)


def test_small_dictionaries_give_the_same(monkeypatch):
    texts = [f"w{i} w{i + 1} w{i % 3} v".encode() for i in range(50)]
    plain = T.Features(3, 100).of(texts)
    monkeypatch.setattr(T, "MOST_WORDS", 4)
    small = T.Features(3, 100)
    parts = [small.of(texts[i : i + 1]) for i in range(50)]
    for k in range(3):
        assert plain[1][k][0].tolist() == [b for p in parts for b in p[1][k][0].tolist()]
    assert small.words.spelled[:1] != [b"w0"]


def test_places_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = T.cut(spark.range(5000).select((F.col("id") % 900).alias("x"), "id").repartition(7))
        got = T.ranked(rows, F.desc("x")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 5001)) and [r.x for r in got] == sorted((i % 900 for i in range(5000)), reverse=True)


def test_empty_tables_and_likeness(spark):
    docs = spark.createDataFrame([(i, ("apple pear plum fig " if i % 2 else "stone iron lead tin ") * 8) for i in range(40)], "doc_id bigint, text string")
    goal = spark.createDataFrame([("apple fig plum",)] * 20, "text string")
    drawn = T.resample(docs, goal, percent=50).where("rank is not null").collect()
    assert len(drawn) == 20 and all(r.doc_id % 2 for r in drawn)
    assert T.resample(docs.limit(0), goal).count() == 0
    assert T.resample(docs, goal.limit(0)).where("rank is not null").count() == 4
