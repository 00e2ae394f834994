import random
import zlib

import numpy as np

from siltstone.llm import langid as G


def test_gradients():
    net, rng = G.Network(["a", "b", "c"]), np.random.default_rng(1)
    x, y = rng.integers(0, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -net.log_softmax(net.features(x))[np.arange(6), y].mean()
    g = net.gradients(x, y)
    for k, v in net.p.items():
        for i in rng.choice(v.size, min(v.size, 12), replace=False):
            at, eps = np.unravel_index(i, v.shape), 1e-6
            v[at] += eps
            up = loss()
            v[at] -= 2 * eps
            down = loss()
            v[at] += eps
            assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-4


def test_windows_cover_the_text():
    for n in (0, 1, 127, 128, 129, 1000):
        raw = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        w = G.windows(raw)
        assert w.shape[1] == 128 and b"".join(map(bytes, w[: n // 128])) == raw[: n // 128 * 128]
        assert bytes(w[-1]).rstrip(b"\0").endswith(raw[-50:])


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10_001, None, "en"), (10_002, "12 34 !!", "en"), (10_003, "", None), (None, "the and that", "en"), (10_004, "the and of that thing " * 9000, None)], docs.schema)
    got = {r.doc_id: r for r in G.identify(docs.union(extra)).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in want)
    assert np.mean([got[i].lang_pred == want[i] for i in held]) > 0.93
    assert [got[i].lang_pred for i in (10_001, 10_002, 10_003)] == ["und"] * 3 and got[None].held_out and got[10_004].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert G.identify(docs).collect()[0].lang_pred == "und" and G.identify(docs.limit(0)).count() == 0


def test_predict_like_a_plain_forward_pass():
    net = G.Network(["de", "en", "fr"], seed=9)
    net.p["b%d" % G.WIDTHS[0]] += 0.1
    texts = ["", "a", "wörter " * 3, "x" * G.LENGTH, "ab c" * G.LENGTH, "\0\0zz" * 90]
    langs, scores = net.predict(texts, batch=2)
    p = {k: v.astype(float) for k, v in net.p.items()}
    for text, lang, score in zip(texts, langs, scores, strict=True):
        raw = text.encode()
        starts = [0] if len(raw) <= G.LENGTH else [*range(0, len(raw) - G.LENGTH + 1, G.LENGTH), *([len(raw) - G.LENGTH] if len(raw) % G.LENGTH else [])]
        total = np.zeros(3)
        for s in starts:
            window = raw[s : s + G.LENGTH].ljust(G.LENGTH, b"\0")
            h = []
            for w in G.WIDTHS:
                for f in range(G.FILTERS):
                    at = [sum(float(p["e"][window[i + j]] @ p[f"w{w}"][j * G.EMBED : (j + 1) * G.EMBED, f]) for j in range(w)) for i in range(0, G.LENGTH - w + 1)]
                    h.append(max(max(at) + p[f"b{w}"][f], 0.0))
            z = [sum(h[i] * p["o"][i, k] for i in range(len(h))) + p["ob"][k] for k in range(3)]
            total += np.array(z) - np.log(sum(np.exp(np.array(z) - max(z)))) - max(z)
        prob = np.exp(total / len(starts))
        prob /= prob.sum()
        assert lang == net.langs[int(prob.argmax())] and abs(score - prob.max()) < 1e-4
