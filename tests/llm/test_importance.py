import numpy as np
import pytest

from siltstone.llm import importance as I
from siltstone.llm.symbols import trigrams


def test_weights_like_brute_force(spark):
    rows = [(i, ("good words here " if i % 3 else "b4d!! st*ff ") * (1 + i % 4), "en" if i % 2 else None) for i in range(40)] + [(99, None, "en"), (98, "", "en"), (None, "good", "en"), (1, "good", "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, key string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {(r.doc_id, r.log_weight) for r in I.resample(docs, labels, k=10).collect()}
    known = {"en": 0}
    fold = {r.t: r.f for r in I._own(docs, "doc_id", "text", "lang").select(I.F.coalesce("text", I.F.lit("")).alias("t"), I.F.col("fold").alias("f")).collect()}
    assert len(set(fold.values())) > 2
    of = lambda t: I.buckets(trigrams([t or ""])[0])
    table = lambda some: np.array([np.bincount(np.concatenate([of(t) for _, t, g in some if known.get(g, 1) == k] or [np.zeros(0, int)]), minlength=I.N_BUCKETS) for k in (0, 1)])
    p = (table(rows) + 1e-9) / (table(rows) + 1e-9).sum(1, keepdims=True)
    want = set()
    for i, t, g in rows:
        target = table([r for r in rows if r[0] is not None and r[0] < 20 and r[0] % 3 and fold[r[1] or ""] != fold[t or ""]])
        q = p * (target + 2) / (target.sum(1, keepdims=True) * p + 2)
        ratio, grams = np.log(q / q.sum(1, keepdims=True) / p)[known.get(g, 1)], of(t)
        want.add((i, ratio[grams].sum() * min(1, 100 / max(grams.size, 1))))
    key = lambda s: sorted({(str(a), round(float(b), 6) + 0.0) for a, b in s})
    assert key(got) == key(want)


def test_threshold_is_the_kth_largest(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1e4, 3000), np.full(500, 3.25), rng.normal(3, 1e-6, 500)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    for k in (1, 7, 1500, 1700, 2400, 3999):
        assert I.top_k_threshold(df, "x", k, bins=16, few=20) == np.sort(x)[::-1][k - 1]
    assert I.top_k_threshold(df, "x", 0) == float("inf") and I.top_k_threshold(df, "x", 4000) == float("-inf")


def test_gumbel_top_k_samples_by_weight(spark):
    rows = spark.range(3).select(I.F.col("id").alias("doc_id"), I.F.log(I.F.col("id") + 1.0).alias("w"))
    first = np.zeros(3)
    draws = rows.crossJoin(spark.range(4000).withColumnRenamed("id", "n"))
    u = draws.select("n", "doc_id", (I.F.col("w") + I.gumbel("u", 7)).alias("k")) if "u" in draws.columns else draws.withColumn("u", I.F.col("n") * 3 + I.F.col("doc_id")).select("n", "doc_id", (I.F.col("w") + I.gumbel("u", 7)).alias("k"))
    for r in u.groupBy("n").agg(I.F.max_by("doc_id", "k").alias("d")).groupBy("d").count().collect():
        first[r.d] = r["count"] / 4000
    assert np.allclose(first, [1 / 6, 2 / 6, 3 / 6], atol=0.03)


def test_the_sample_follows_the_weights(spark):
    """Of rows of a few weights, a small sample holds as many of each as its weight says; and two seeds draw different rows."""
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i, " ".join(rng.choice(words[: 3 + 3 * (i % 2)], 8)) + f" {i}", "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 300, 1)], "doc_id bigint, quality int, toxic int")
    drawn = I.resample(docs, labels, k=600, seed=11).collect()
    w, s = np.array([r.log_weight for r in drawn]), np.array([r.selected for r in drawn])
    assert s.sum() == 600
    edges = np.quantile(w, [0, 0.25, 0.5, 0.75, 1])
    share = lambda x, lo, hi: x[(w >= lo) & (w <= hi)].sum() / x.sum()
    # drawing without replacement by weight: a row is left out with chance exp(-c * weight), where c makes the sample's size come out
    low, high = 0.0, 1e9
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if (1 - np.exp(-c * np.exp(w))).sum() < 600 else (low, c)
    chance = 1 - np.exp(-c * np.exp(w))
    for lo, hi in zip(edges, edges[1:], strict=False):
        assert abs(share(s, lo, hi) - share(chance, lo, hi)) < 0.05
    plain = w >= np.sort(w)[::-1][599]
    assert (s != plain).sum() > 100
    other = {r.doc_id for r in I.resample(docs, labels, k=600, seed=12).where("selected").collect()}
    assert len(other & {r.doc_id for r in drawn if r.selected}) < 550


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_keeps_clean_and_rejects_junk_that_it_was_not_fitted_on(spark, sf_dir, sf):
    folder = sf_dir.replace("sf0.001", sf)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = I.resample(docs, labels).join(labels, "doc_id").groupBy("quality").agg(I.F.avg(I.F.col("selected").cast("int")).alias("s")).collect()
    share = {r.quality: r.s for r in got}
    assert share[1] > (0.95 if sf == "sf0.01" else 0.85) and share[0] < (0.1 if sf == "sf0.01" else 0.35)  # 80 labels are few
    kept = I.selected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == I.resample(docs, labels).where("selected").count()
    none = labels.limit(0)
    assert I.resample(docs, none).where("selected").count() == docs.count() and I.resample(docs.limit(0), labels).count() == 0
