import re

import numpy as np

from siltstone.llm import urls as U


def brute(url):
    if not url or "://" not in url:
        return "", "", None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name


def test_host_path_rule(spark):
    urls = [None, "", "no scheme", "http://", "http://?x", "HTTP://A.Example.COM/en/7?x#y", "https://example.com/en/71", "x://com/en/", "http://xcom/en/a", "http://É.net/de/8", "http://example.net/de/8#z",
            "http://a.example.net/de/9", "http://u@h:80/p\nq?z", "a://b://c/d", "http://org/es/", "http://m.org#/es/", "http://b.org/es", *["http://m.org/es/1"] * 3]
    rows = [(i, u, "<a href='/x'>", "clash", 1.0) for i, u in enumerate(urls)] + [(None, None, None, None, None)] * 2
    got = U.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, trust double"))
    out = got.collect()
    assert len(out) == len(rows)
    verdicts = {r.name: r.verdict for r in U.RULES}
    for r in out:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == brute(urls[r.page_id])
            assert r.verdict == (verdicts[r.rule] if r.rule else r.verdict) and r.verdict in ("allow", "block")
    assert all(r.verdict == "allow" for r in out if not r.host)
    assert U.judge(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_propagation_like_matrix_power(spark):
    hosts = ["a", "b", "c", "d", "e"]
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 4), ("d", "e", 1), ("e", "d", 1), ("d", "a", 3)]
    seeds = [("a", 1.0, 0.0), ("c", 0.2, 0.7), ("e", 0.0, 1.0), ("z", 0.5, 0.5)]
    got = {r.host: (r.trust, r.distrust) for r in U.propagate(spark.createDataFrame(links, "src string, dst string, n bigint"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), least_change=1e-4).collect()}
    m = np.zeros((5, 5))
    for s, d, n in links:
        m[hosts.index(s), hosts.index(d)] += n
    for k, p in ((0, m / m.sum(1, keepdims=True)), (1, (m / m.sum(0, keepdims=True)).T)):
        s = np.array([dict((h, x) for h, *x in seeds).get(h, [0, 0])[k] for h in hosts])
        want = 0.15 * np.linalg.solve(np.eye(5) - 0.85 * p.T, s)
        assert np.allclose([got[h][k] for h in hosts], want, atol=1e-3)
    assert np.allclose(got["z"], (0.075, 0.075))


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    rows = [(i, f"http://bad.com/en/{i}", "") for i in range(4)] + [(10, "http://farm.info/x", "<a href=http://bad.com/en/1>") , (11, "http://good.info/x", '<a HREF="//fine.info/q?x">')]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[10].verdict == "block" and got[10].rule is None and got[11].verdict == "allow"


def test_judge_s_own_defaults_on_chains_and_rings_like_the_linear_system(spark):
    names = [f"h{i}.info" for i in range(12)]
    links = [(i, i + 1) for i in range(7)] + [(7, 5), (9, 10), (10, 9), (8, 0)]  # a chain into a ring, a ring by itself
    bad = {6: "bad.com/en/1", 10: "worse.com/en/1"}
    pages = [(i, f"http://{names[i]}/x", "".join(f'<a href="http://{names[b]}/y">' for a, b in links if a == i) + (f"<a href=http://{bad[i]}>" if i in bad else "")) for i in range(12)]
    pages += [(100, "http://bad.com/en/1", ""), (101, "http://worse.com/en/1", "")]
    got = {r.host: r for r in U.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    hosts = [*names, "bad.com", "worse.com"]
    m = np.zeros((14, 14))
    for a, b in [*links, (6, 12), (10, 13)]:
        m[a, b] += 1
    back = np.divide(m, m.sum(0, keepdims=True), out=np.zeros_like(m), where=m.sum(0, keepdims=True) > 0).T
    want = 0.15 * np.linalg.solve(np.eye(14) - 0.85 * back.T, np.r_[np.zeros(12), 1, 1])
    assert np.allclose([got[h].distrust for h in hosts], want, atol=1e-6) and all(r.trust == 0 for r in got.values())
    assert all(got[h].verdict == ("block" if w >= 0.075 else "allow") for h, w in zip(names, want, strict=False)) and len({got[h].verdict for h in names}) == 2


def test_verdicts_of_the_contract_s_rules(spark):
    want = {
        "http://example.com/en/1": ("com/en/", "block"), "http://a.example.com/en/71": ("example.com/en/7", "allow"), "http://x.net/de/8": ("net/de/", "allow"), "http://net/de/": ("net/de/", "allow"),
        "http://example.net/de/9": ("net/de/", "allow"), "http://example.net/de/81": ("example.net/de/8", "block"), "http://org/es/": ("org/es/", "block"), "http://net/en/": (None, "allow"),
    }
    rows = [(i, u, "") for i, u in enumerate(want)]
    got = U.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {rows[r.page_id][1]: (r.rule, r.verdict) for r in got} == want
