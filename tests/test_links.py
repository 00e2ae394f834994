import posixpath
import random
import re

from siltstone.operators import links


def one_by_one(text, pages, own):
    """Links by hand: each known name in backticks once, where it first stands, unless that is right after [ or its page is the text's own."""
    met = []
    for m in re.finditer(r"`([A-Z][a-zA-Z0-9_]+)`", text):
        if m[1] in pages and pages[m[1]] != own and m[1] not in met:
            met.append(m[1])
    n = 0
    for name in met:
        at = text.index(f"`{name}`")
        if at and text[at - 1] == "[":
            continue
        way = posixpath.relpath("/" + pages[name], "/" + posixpath.dirname(own))
        text = f"{text[:at]}[`{name}`]({way}#{name.lower()}){text[at + len(name) + 2 :]}"
        n += 1
    return text, n


def test_names_in_prose(spark):
    rng = random.Random(4)
    names = ["User", "Abc_1", "Zed", "Ab", "Nobody", "X"]
    pages = {"User": "api/a/b/user.md", "Abc_1": "api/a/abc.md", "Zed": "api/zed.md", "Ab": "index.md"}
    bits = [*(f" `{n}` " for n in names), *(f"[`{n}`](x) " for n in names), "` `", "`user` ", "``` ", "a $1 \\ b\n", "`User Zed` ", "[", "User ", "é😀 "]
    texts = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), rng.choice(["api/a/b/c.md", "api/zed.md", "index.md", "api/a/abc.md"])) for _ in range(500)]
    texts = [t for t in texts if not re.search(r"`[A-Z]\w+`[A-Z]\w+`", t[0])]
    df = spark.createDataFrame([(i, t, p, "x", 7) for i, (t, p) in enumerate(texts)] + [(901, None, "index.md", "x", 1), (902, "`User`", None, "x", 1), (903, "`Zed` `Zed`", "index.md", "x", 1), (903, "`Zed` `Zed`", "index.md", "x", 1)], "id int, text string, page string, name string, n_links int").repartition(3)
    known = spark.createDataFrame(list(pages.items()), "name string, page string")
    out = links.linked_names(df, known)
    assert out.columns == ["id", "text", "page", "name", "n_links"]
    got = {r.id: (r.text, r.n_links) for r in out.collect()}
    for i, (t, p) in enumerate(texts):
        assert got[i] == one_by_one(t, pages, p), t
    assert got[901] == (None, 0) and got[902] == ("[`User`](api/a/b/user.md#user)", 1) and got[903] == ("[`Zed`](api/zed.md#zed) `Zed`", 1)
    assert out.count() == len(texts) + 4 and any(n > 2 for _, n in got.values())
    assert links.linked_names(df.limit(0), known).count() == 0 and links.linked_names(df, known.limit(0)).agg({"n_links": "max"}).first()[0] == 0


def test_very_long_prose(spark):
    text = "".join(f"word `Name{i}` and `Name{i // 2}` " for i in range(20_000))
    df = spark.createDataFrame([(1, text, "index.md")], "id int, text string, page string")
    known = spark.range(20_000).selectExpr("concat('Name', id) name", "'api/n.md' page")
    r = links.linked_names(df, known).first()
    assert r.n_links == 20_000 and r.text.count("](api/n.md#name") == 20_000


def test_names_in_types(spark):
    known = spark.createDataFrame([("User", "api/a/user.md", 5), ("Map", "api/map.md", 1), ("us$r", "api/d.md", 0)], "name string, page string, place int")
    rows = [("Map<User>", "api/b/x.md"), ("User[]", None), ("xUser | User$ | User", "api/a/b.md"), ("string", "api/x.md"), (None, "api/x.md"), ("User.User", "api/a/user.md"), ("User[]", None)]
    got = sorted(map(str, (tuple(r) for r in links.linked_types(spark.createDataFrame(rows, "type string, page string"), known).collect())))
    want = ["[Map](../map.md#map)<User>", "[User](../api/a/user.md#user)[]", "xUser | [User](user.md#user)$ | User", "`string`", None, "[User](user.md#user).User", "[User](../api/a/user.md#user)[]"]
    assert got == sorted(map(str, [(*r, w) for r, w in zip(rows, want, strict=True)]))


def test_pages_of_names(spark):
    rows = [("a.ts", "A", "class", True, 1), ("b.ts", "A", "type", True, 2), ("c.ts", "A", "enum", False, 3), ("d.ts", "f", "function", True, 4)]
    got = links.linkable_pages(spark.createDataFrame(rows, "path string, name string, kind string, exported boolean, ordinal int")).collect()
    assert [tuple(r) for r in got] == [("A", "api/b.md", 1)]
