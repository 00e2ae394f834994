import random
import re

from siltstone.llm import licenses as L

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, k) for k, p in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(ws), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits}))


def test_base_like_brute_force(spark):
    rng = random.Random(3)
    bits = ["under the", "MIT", "License", "the", "cc", "BY", "nc", "apache license", "version", "2", "2.0", "é", "É", "x-y", "under", "漢"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "-", "\n", ", ", "\0"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " .", "cc by nc cc by nc", "cc by", "under the MIT license " * 400, "CC-BY-NC", "é", "x" * 50_000 + " cc by nc", *texts[:5]]
    rows = [(i, t, 7, "clash", 1) for i, t in enumerate(texts)] + [(None, "cc by nc", 7, "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, t int, label string, rid int")
    got = L.scan(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert L.scan(docs.limit(0)).count() == 0


def test_edited_notice_is_found_across_diagonals(spark):
    notice = L.TEMPLATES[3].text.split()
    edited = notice[:8] + ["indeed"] + notice[8:14] + ["very", "plainly"] + notice[14:]
    far = notice[:6] + ["w"] * 60 + notice[6:12]
    docs = spark.createDataFrame([(1, "a b " + " ".join(edited)), (2, " ".join(far)), (3, "nothing of the kind here")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.6 <= got[1].score < 1 and got[1].spans[0].first == 2
    assert got[2].labels == "" and got[2].score == 0 and got[3].labels == ""
