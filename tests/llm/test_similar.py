import random

import numpy as np

from siltstone.llm import similar as S


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows, at_least=0.8):
    up = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if both == 0 or sets[i] and sets[j] and len(sets[i] & sets[j]) / both >= at_least:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = f"new{rng.random()}"
    return out


def test_groups_like_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    rows = [(None, None), (900, ""), (901, " \n\t"), (902, "Two words"), (903, "two  WORDS"), (904, "two"), (None, "lone row")]
    for i in range(40):
        words = rng.choices(vocab, k=rng.randint(30, 600))
        rows.append((i * 10, " ".join(words)))
        rows.append((i * 10 + 1, " ".join(edited(rng, words, 0.012))))  # about 0.89 of shingles
        rows.append((i * 10 + 2, " ".join(edited(rng, words, 0.12))))  # about a third
        rows.append((i * 10 + 3, "\n".join(words).upper() if i % 3 else " ".join(words)))
    long = " ".join(rng.choices(vocab, k=20_000))
    rows += [(990, long), (991, long + " end"), (990, long)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, k1 int, node string").repartition(3)
    root = brute_groups(rows)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    want = sorted((str(d), str(least[r])) for (d, _), r in zip(rows, root, strict=True))
    got = S.groups(docs).collect()
    assert sum(a == b for a, b in zip(want, sorted((str(r.doc_id), str(r.group_id)) for r in got), strict=True)) >= len(want) - 2
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.first for r in got) == len({(r.group_id, r.doc_id) for r in got if r.first})
    assert S.groups(docs.limit(0)).count() == 0 and S.deduplicated(docs.limit(0)).count() == 0


def test_hot_group_and_clean_texts(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    base = rng.choices(vocab, k=200)
    rows = [(i, " ".join(edited(rng, base, 0.005))) for i in range(300)] + [(1000 + i, " ".join(rng.choices(vocab, k=200))) for i in range(200)]
    got = S.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.group_id for r in got if r.doc_id < 1000} == {0}
    assert all(r.group_id == r.doc_id for r in got if r.doc_id >= 1000)


def test_recall_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute_groups(rows)
    got = {r.doc_id: r.group_id for r in S.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    pairs = [(rows[i][0], rows[r][0]) for i, r in enumerate(want) if r != i]
    assert pairs and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    # nothing else is put together
    of = {rows[i][0]: r for i, r in enumerate(want)}
    assert all(of[d] == of[g] for d, g in got.items())


def test_large_group_linked_only_through_its_original(spark):
    rng = np.random.default_rng(12)
    # copies with 17 of 1,000 words replaced, 5 or more apart: 0.84 or so to the original, less than 0.8 to each other
    base, rows = [f"w{i}" for i in range(1000)], []
    for i in range(2000):
        words = list(base)
        for at in rng.choice(1000 // 6, 17, replace=False) * 6 + 2:
            words[at] = f"new{i}-{at}"
        rows.append((i + 1, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    whole = shingles(" ".join(base))
    assert all(len(s & whole) / len(s | whole) >= 0.8 for s in sets)
    assert all(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.8 for i in range(0, 1998, 2))
    got = S.groups(spark.createDataFrame([*rows, (0, " ".join(base))], "doc_id bigint, text string").repartition(4)).collect()
    lost = [r.doc_id for r in got if r.group_id]
    assert len(got) == 2001 and len(lost) <= 20, len(lost)


def test_near_links_are_those_of_all_pairs():
    rng = np.random.default_rng(13)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 32, 60, np.uint32)
        sets += [np.unique(np.r_[rng.choice(base, rng.integers(48, 60), replace=False), rng.integers(0, 1 << 32, rng.integers(0, 6), np.uint32)]) for _ in range(15)]

    def parts(edges):
        up = list(range(len(sets)))
        for a, b in edges:
            a, b = up[a], up[b]
            up = [min(a, b) if x in (a, b) else x for x in up]
        return up

    want = [(i, j) for i in range(len(sets)) for j in range(i) if np.intersect1d(sets[i], sets[j]).size / np.union1d(sets[i], sets[j]).size >= 0.8]
    assert parts(want) == parts(zip(*S.near_links(sets, 0.8), strict=True)) and len(set(parts(want))) > 12


def test_pairs_near_the_limit_by_length(spark):
    rng = np.random.default_rng(16)
    rows, want, near = [], set(), []
    for words, pairs in ((60, 60), (400, 60), (4000, 40)):
        for _ in range(pairs):
            one = [f"w{x}" for x in rng.integers(0, 50_000, words)]
            share = rng.uniform(0.76, 0.86)
            n = max(1, round((1 - share) / (1 + share) * (words - 4) / 5))  # so many words, each in five shingles
            two = list(one)
            for at in rng.choice(words // 6, n, replace=False) * 6 + 2:
                two[at] = f"new{rng.integers(1 << 40)}"
            x, y = shingles(" ".join(one)), shingles(" ".join(two))
            near.append(len(x & y) / len(x | y))
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
            if near[-1] >= 0.8:
                want.add(len(rows) - 2)
    assert 40 < len(want) < 140
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.group_id for r in S.groups(docs).collect()}
    linked = {i for i in range(0, len(rows), 2) if got[i + 1] == i}
    assert linked <= want and len(want - linked) <= 1


def test_blocks_change_nothing(spark):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(6):
        base = rng.choices(vocab, k=80)
        texts += [" ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.08]))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    nodes = S.cut(S.profiles(docs, shingle=5, id_col="doc_id", text_col="text").selectExpr("*", "struct(k1, k2) low"))

    def parts(edges):
        up = {r.node: r.node for r in nodes.collect()}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges.collect():
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return sorted(find(x) for x in up)

    loose = S.cut(S.candidates(nodes))
    assert max(S.planned_blocks(nodes, 10, 1).values()) > 2 and not S.planned_blocks(nodes)
    assert parts(S.candidates(nodes, 10, 1)) == parts(loose)
    kind = {"shingle": 5, "similarity": 0.8, "id_col": "doc_id", "text_col": "text"}
    whole, cut = (parts(S.group_links(docs, nodes, loose, **kind, block_hashes=n)) for n in (1 << 20, 300))
    assert whole == cut and 6 < len(set(whole)) < 180


def test_deduplicated_keeps_one_of_equal_rows_and_odd_columns(spark):
    rows = [(1, "one two three four five six", "x"), (1, "one two three four five six", "x"), (None, "one TWO three four five six", "y"), (None, None, None), (None, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k1 string").selectExpr("*", "k1 first", "k1 n", "k1 node", "k1 row", "k1 root")
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert len(got) == 2 and got[0] == ("1", "one two three four five six") and got[1][1] == ""
    whole = " ".join(f"w{i}" for i in range(200_000))  # over 1 MB
    long = spark.createDataFrame([(5, whole), (6, whole + " end"), (7, whole[:600_000])], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in S.deduplicated(long).collect()) == [5, 7]


def test_pairs_at_the_limit_share_a_key():
    rng, missed, n = np.random.default_rng(15), 0, 0
    for size in (60, 100, 200, 400):
        common, marks = round(2 * size * 0.8 / 1.8) + 1, []
        for _ in range(1000):
            h = rng.integers(0, 1 << 63, 2 * size - common).astype(np.uint64)
            marks += [S.margins(h[:size]), S.margins(np.r_[h[:common], h[size:]])]
        keys = np.concatenate([S.keys_of(S.segment_codes(np.stack(marks[at : at + 500]))) for at in range(0, 2000, 500)])
        bad = sum(not np.intersect1d(a, b).size for a, b in zip(keys[::2], keys[1::2], strict=True))
        missed, n = missed + bad, n + 1000
    assert missed <= 0.002 * n, missed
