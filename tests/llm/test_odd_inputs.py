"""Every operator and filtering stage: clashing names, empty tables, very long texts, nulls, repeated rows."""

import pytest

from siltstone.llm import bytepairs, importance, langid, licenses, packing, periodic, pieces, rules, secrets, similar, simhash, target, urls, weighted

NAMES = "k1 k2 row first n id label good g key log_weight fold lang_pred spans live base rid h wide node root bits codes bucket pos ghost piece sequence_id __id __lang __gumbel __o __rid __row __note fp held_out score rule host trust gram kept copied q".split()
LONG = " ".join(f"word{i} la le lu" for i in range(80_000))  # over 1 MB
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [
    (1, "some words of a clean text that goes on for a while and says a thing or two", "en", "a", 1), (1, "some words of a clean text that goes on for a while and says a thing or two", "en", "a", 1), (2, None, None, None, None),
    (None, "", "en", "b", 0), (None, "a token=abcdefghijklmnop here", "de", "b", 2), (3, LONG, "en", "c", 3), (4, " \n\t", "", "", 0), (5, "x", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    return df.selectExpr("*", *(f"cast({i} as string) `{c}`" for i, c in enumerate(NAMES))).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' id", "'y' good", "'z' label", "'w' __id")


OPERATORS = {
    "op1": lambda d, _: simhash.near_duplicates(d, shingle=4),
    "op2": lambda d, _: licenses.scan(d),
    "op3": lambda d, _: secrets.scan(d),
    "op4": lambda d, _: pieces.round_trip(d),
    "op5": lambda d, _: urls.judge(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})),
    "op6": lambda d, _: langid.identify(d, epochs=1),
    "op7": importance.resample,
    "op8": lambda d, _: weighted.fingerprints(d),
    "op9": lambda d, _: rules.judge(d),
    "op10": lambda d, _: packing.pack(d),
    "op11": lambda d, _: target.resample(d, d),
    "op12": lambda d, _: bytepairs.digest(bytepairs.decode(bytepairs.encode(d))),
    "op13": lambda d, _: periodic.digest(periodic.periodic_runs(periodic.with_repeats(d))),
    "dedup": lambda d, _: similar.groups(d),
}
STAGES = {"quality classifier": importance.selected, "quality rules": lambda d, _: rules.kept(d), "near-dedup": lambda d, _: similar.deduplicated(d), "secret scans": lambda d, _: secrets.redacted(d)}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(docs, labels, name):
    out = OPERATORS[name](docs, labels)
    n = out.count()
    assert n > len(ROWS) if name == "op10" else n == len(ROWS)
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages(docs, labels, name):
    out = STAGES[name](docs, labels)
    assert out.columns == docs.columns and out.schema.fields[1].dataType == docs.schema.fields[1].dataType
    got = out.collect()
    plain = STAGES[name](docs.select("doc_id", "text", "lang", "source", "n_chars"), labels.select("doc_id", "quality", "toxic")).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, map(tuple, plain))) and all(tuple(r)[5:] == tuple(map(str, range(len(NAMES)))) for r in got)
    upper = STAGES[name](docs.select("doc_id", "text", "lang", "source", "n_chars").toDF("DOC_ID", "TEXT", "LANG", "SOURCE", "N_CHARS"), labels)
    assert upper.columns == ["DOC_ID", "TEXT", "LANG", "SOURCE", "N_CHARS"] and sorted(map(repr, map(tuple, upper.collect()))) == sorted(map(repr, map(tuple, plain)))
    assert STAGES[name](docs.limit(0), labels.limit(0)).count() == 0
    if name == "near-dedup":
        assert len(got) == 5 and sum(r.doc_id == 1 for r in got) == 1
    if name == "secret scans":
        assert len(got) == len(ROWS) and sum("[secret]" in (r.text or "") for r in got) == 1
