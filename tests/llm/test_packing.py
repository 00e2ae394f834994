import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siltstone.llm.packing import Encoder, OpenBins, cut_points, pack, tokenizer_path

ODD = ["", "\n", " a", "a  b \n c\t d", "it's  <|endoftext|> x", "a\x1cb c", "\xa0x 　y", "\0a b", "x\r\ny", "don't\n'll ", "x" * 30_000, " " * 20_000, "é漢😀 " * 500]


@pytest.fixture(scope="module")
def enc():
    return Encoder(tokenizer_path())


def test_ids_are_the_tokenizers(enc):
    tok, rng = Tokenizer.from_file(tokenizer_path()), random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "b", " ", "\n", "'s", "\t", ".", "1", "é", "漢", "😀"]) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    for t in texts:
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_ids_of_a_whole_table(enc, spark):
    tok = Tokenizer.from_file(tokenizer_path())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.encode(t).tolist() == e.ids


def test_equal_rows_go_to_different_tasks(spark):
    docs = spark.createDataFrame([(None, "")] * 4000 + [(7, "same text")] * 4000, "doc_id bigint, text string").repartition(4)
    out = pack(docs, pieces_per_task=2000)
    by_task = [r["count"] for r in out.groupBy(out.sequence_id.bitwiseAND(~((1 << 40) - 1)).alias("task")).count().collect()]
    assert len(by_task) == 4 and max(by_task) < 2600


def test_cut_points():
    assert cut_points(5, 4) == [(0, 1), (1, 4)]
    assert cut_points(8, 4) == [(0, 4), (4, 4)]
    assert cut_points(4, 4) == [(0, 4)]


def brute_best_fit(lengths, capacity, max_open):
    """The same policy with a plain list of open bins."""
    free, n, out = {}, 0, []
    for x in lengths:
        fit = min((f for f in free.values() if f >= x), default=None)
        if fit is None:
            if len(free) >= max_open:
                del free[next(b for b in free if free[b] == min(free.values()))]
            fit, b, n = capacity, n, n + 1
        else:
            b = next(b for b in free if free[b] == fit)
            del free[b]
        out.append(capacity - fit)
        if fit > x:
            free[b] = fit - x
    return n, out


@pytest.mark.parametrize("max_open", [1, 3, 1000])
def test_best_fit_like_brute_force(max_open):
    rng = random.Random(7)
    lengths = [rng.choice([rng.randint(1, 16), rng.randint(1, 4)]) for _ in range(800)]
    bins = OpenBins(16, max_open)
    got = [bins.place(x) for x in lengths]
    n, offsets = brute_best_fit(lengths, 16, max_open)
    assert bins.n_bins == n and [o for _, o in got] == offsets and bins.n_open <= max_open


def test_pack_whole_table(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["ab ", "c", "\n", "xyz "]) for _ in range(rng.choice([3, 200, 5000]))), "clash", 1) for i in range(60)]
    rows += [(100, None, "x", 2), (101, "", "x", 3), (5, "twice", "x", 1), (5, "twice", "x", 1), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece string, length int")
    got = pack(docs, capacity=64, pieces_per_task=50).toPandas()
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want += [(i, k, s, n, zlib.crc32(np.asarray(ids[s : s + n], "<u4"))) for k, (s, n) in enumerate(cut_points(len(ids), 64))]
    key = lambda r: tuple(-1 if x is None or x != x else x for x in r)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))) == sorted(map(key, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= got.length.sum() / 64 * 1.1 + 8


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
