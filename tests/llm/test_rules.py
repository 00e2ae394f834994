import random
import re
from collections import Counter

import numpy as np

from siltstone.llm import rules as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def test_counts_like_brute_force():
    rng = random.Random(6)
    texts = ["", " \n", "a\x1cb\x85c\xa0d", "a b c d e a b c d e", "x\nx\n\nx \n x"]
    texts += ["".join(rng.choice("ab😀é#*|") + rng.choice([" ", "\n", "", "\t", "\x0b"]) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    assert [R.counts_of(t) for t in texts] == [brute(t) for t in texts]


def pack(*chars):
    out = 0
    for c in chars:
        out = out << 21 | c
    return out


def counts_of_grams(grams):
    """Plain tables of a Counter of (a, b, c)."""
    table = lambda c: (np.array(sorted(c), np.int64), np.array([c[k] for k in sorted(c)], np.int64))
    ctx, pairs = Counter(), Counter()
    for (a, b, c), n in grams.items():
        ctx[pack(a, b)] += n
        pairs[pack(b, c)] += 1
    firsts, chars = Counter(), Counter()
    for k, n in pairs.items():
        firsts[k >> 21] += n
        chars[k & (1 << 21) - 1] += 1
    d = lambda c: R._discounts(*(sum(v == k for v in c.values()) for k in range(1, 5)))
    return R.Counts(table({pack(*g): n for g, n in grams.items()}), table(ctx), table(pairs), table(firsts), table(chars), len(pairs), (d(grams), d(pairs), d(chars)))


def test_kneser_ney_is_a_distribution_and_like_a_plain_one():
    rng = random.Random(1)
    s = [rng.choice([1, 1, 1, 2, 3, 4, 20_000]) for _ in range(3000)]
    grams = Counter(zip(s, s[1:], s[2:], strict=False))
    m = R.kneser_ney(counts_of_grams(grams))
    log = lambda *g: m.log_probability(np.array([pack(*g)]))[0]
    for ctx in [(1, 1), (2, 20_000), (7, 7), (4, 200)]:
        every = np.array([pack(*ctx, c) for c in range(R.ALPHABET)])
        assert abs(np.exp(m.log_probability(every)).sum() - 1) < 1e-4
    d = lambda c: R._discounts(*(sum(v == k for v in c.values()) for k in range(1, 5)))
    cont = Counter(g[1:] for g in grams)
    n1 = Counter(p[1] for p in cont)
    d3, d2, d1 = d(grams), d(cont), d(n1)
    p1 = lambda c: max(n1[c] - d1[min(n1[c], 3)], 0) / len(cont) + sum(d1[min(x, 3)] for x in n1.values()) / len(cont) / R.ALPHABET
    pairs = [p for p in cont if p[0] == 1]
    t2 = sum(cont[p] for p in pairs)
    p2 = lambda c: max(cont[1, c] - d2[min(cont[1, c], 3)], 0) / t2 + sum(d2[min(cont[p], 3)] for p in pairs) / t2 * p1(c)
    own = [g for g in grams if g[:2] == (1, 1)]
    total = sum(grams[g] for g in own)
    for c in (1, 2, 3, 4, 20_000, 5, 60_000):
        want = max(grams[1, 1, c] - d3[min(grams[1, 1, c], 3)], 0) / total + sum(d3[min(grams[x], 3)] for x in own) / total * p2(c)
        assert abs(np.exp(log(1, 1, c)) - want) < 1e-5


def test_counts_and_models_like_plain_ones(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde éß日") for _ in range(rng.randint(1, 80))) for _ in range(240)]
    rows = [(i, t, "xy" if i % 2 else ("zz" if i < 20 else None)) for i, t in enumerate(texts)] + [(900, "LOUD WORDS", "xy"), (901, "a #### b", "xy")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    named = R.named_languages(docs, "lang")
    assert named == ["xy"]
    fold = {r.doc_id: r.f for r in docs.select("doc_id", R.fold_of(docs.text).alias("f")).collect()}
    got = R.model_counts(R.trigram_counts(docs, named, "text", "lang"))
    for lang in ("xy", ""):
        for f in (0, 1):
            some = [t for i, t, x in rows if i < 900 and (x == "xy") == (lang == "xy") and fold[i] == f]
            padded = [[0, 0, *map(ord, t)] for t in some]
            want = counts_of_grams(Counter(g for u in padded for g in zip(u, u[1:], u[2:], strict=False)))
            for name in ("grams", "contexts", "pairs", "firsts", "chars"):
                assert all((a == b).all() for a, b in zip(getattr(got[lang, f], name), getattr(want, name), strict=True))
            assert got[lang, f].n_pairs == want.n_pairs and np.allclose(np.stack(got[lang, f].discounts), np.stack(want.discounts))
    kept = R.model_counts(R.trigram_counts(docs, named, "text", "lang"), 4000)
    assert sum(c.grams[0].size for c in kept.values()) <= 4000
    for c in kept.values():
        ctx = c.grams[0][0] >> 21
        every = np.array([(ctx << 21) | x for x in range(R.ALPHABET)])
        assert abs(np.exp(R.kneser_ney(c).log_probability(every)).sum() - 1) < 1e-3


def test_judge(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(9001, None, "en", None, 0), (9002, "", None, "s", 0), (9003, "ÿ☃ĀŁ¶§ " * 60 + " ".join(chr(300 + i) * 9 for i in range(400)), "en", "s", 1), (None, "x", "en", "s", 1), (9001, None, "en", None, 0)]
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = R.judge(both).collect()
    texts = {r.doc_id: r.text for r in both.collect()}
    assert len(rows) == both.count()
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    by_id = {r.doc_id: r for r in rows}
    assert not by_id[9003].kept
    good = [r for r in rows if not r.base_failed]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    share = lambda q: np.mean([r.kept for r in good if label.get(r.doc_id) == q])
    assert share(1) >= 0.97 and share(0) <= 0.5
    kept = R.kept(both)
    assert kept.columns == both.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert R.judge(docs.limit(0)).count() == 0


def test_a_small_cap_changes_no_measure(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(docs.limit(3)).repartition(3)
    told = lambda most: sorted((r.doc_id, r.k1, r.log_perplexity, r.kept) for r in R.judge(docs, max_grams=most).collect())
    whole, capped = told(1 << 24), told(600)
    assert [(a, b, k) for a, b, _, k in whole] == [(a, b, k) for a, b, _, k in capped]
    assert np.allclose([x[2] for x in whole], [x[2] for x in capped], rtol=0, atol=1e-9)
