"""Secret scans: pattern candidates, judged by how many repositories and owners hold the same secret."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, let, matched, row_key


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that is the secret (0: all), and the least length of that group."""

    name: str
    pattern: str
    group: int
    least: int
    #: Spans count always; else only if the corpus makes them look live.
    base: bool = True
    #: Cheap test of a whole text for any match.
    hint: str = ""


#: Copies of a hot secret are dealt to so many tasks where they meet the verdict on it.
SALT = 16
SPAN = "struct<kind:string,start:int,end:int,value:string>"

#: Patterns contain no match of zero length: positions come from the lengths of what lies between.
KINDS = (
    Kind("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
    Kind("token", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0, 14, False),
    Kind("bearer", r"(?i:\bbearer)\x20+([A-Za-z0-9._~+/-]{16,}=*)", 1, 16, False),
    Kind("login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{6,64})@", 1, 6, False),
    Kind("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24, False),
)


def _found(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, value>> of a kind's matches, leftmost and not overlapping; code points, end exclusive."""
    whole, between = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{SPAN}>").alias("all"))

    def step(state: Column, x: Column) -> Column:
        s = state["end"] + F.length(x["gap"])
        e = s + F.length(x["whole"])
        one = F.array(F.struct(F.lit(kind.name).alias("kind"), s.alias("start"), e.alias("end"), x["value"].alias("value")))
        return F.struct(e.alias("end"), F.when(F.length(x["value"]) >= kind.least, F.concat(state["all"], one)).otherwise(state["all"]).alias("all"))

    parts = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(between, 1, F.size(whole)).alias("gap"))
    return let(parts, lambda p: F.aggregate(p, start, step)["all"])


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS."""
    order = {k.name: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]].alias("k"), s["end"], s["kind"])))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _looks_random(value: Column) -> Column:
    """Digits and letters, and many different characters: not a word, a number or a ruler line."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def candidates(docs: DataFrame, *, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """(k1, k2, doc_id, owner, repository, spans) of each row of docs, with every kind's spans; k1, k2 name the text.

    An opaque string that overlaps a span of another kind is left out: it tells nothing new.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = "|".join(k.pattern for k in KINDS)
    none = F.array().cast(f"array<{SPAN}>")
    own = docs.select(*row_key(text), F.col(id_col).alias("doc_id"), owner.alias("owner"), repository.alias("repository"), text.alias("text"))
    sure = F.concat(*(_found(F.col("text"), k) for k in KINDS[:-1]))
    new = lambda o, others: F.filter(o, lambda s: ~F.exists(others, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    spans = let(sure, lambda others: F.concat(others, new(_found(F.col("text"), KINDS[-1]), others)))
    return own.select("k1", "k2", "doc_id", "owner", "repository", F.when(F.col("text").rlike(some), spans).otherwise(none).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(h, n_rows, n_repositories, n_owners) for each secret: how widely it is copied.

    Rows meet in three steps, each summed before its shuffle: by secret, owner and repository, then by secret and owner,
    then by secret. So a secret in a third of all rows is a few partial sums.
    """
    one = found.select(F.explode("spans").alias("s"), "owner", "repository").select(F.xxhash64("s.value").alias("h"), "owner", "repository")
    by_repository = one.groupBy("h", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("h").agg(F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, copied_owners: int = 3, copied_repositories: int = 6) -> DataFrame:
    """Spans of secrets in every text, and which of them look live.

    owner: whose text it is (default: column source). repository: the collection it stands in (default: source and
    lang; the table has nothing finer). A secret that copied_owners owners or copied_repositories repositories hold is a
    copied example; one of fewer, and random enough, is live. Base kinds give spans always; the other kinds only live ones.

    Returns (k1, k2, doc_id, base, spans, live, copied, n_live, n_copied), a row for each row of docs; k1 and k2 name its text, base, spans,
    live and copied are arrays of struct<kind, start, end, value>. Null text counts as empty. A null owner or repository counts as
    one of its own. Repeated rows each get their row, and count once for each owner. An empty table gives no row.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("?")), F.coalesce(F.col("lang"), F.lit("?"))) if repository is None else repository
    found = cut(candidates(docs, id_col=id_col, text_col=text_col, owner=owner.cast("string"), repository=repository.cast("string")))
    found = found.withColumn("rid", F.monotonically_increasing_id())  # of a checkpoint, so for good
    wide = cut(ownership(found).where((F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)).select("h", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.lit(True).alias("wide")))
    each = found.select("rid", F.explode("spans").alias("s")).select("rid", "s", F.xxhash64("s.value").alias("h"), F.pmod("rid", F.lit(SALT)).cast("int").alias("salt"))
    judged = matched(each, wide, ["h", "salt"], "left").select("rid", "s", F.coalesce("wide", F.lit(False)).alias("copied"))
    judged = judged.withColumn("live", ~F.col("copied") & _looks_random(F.col("s.value")))
    base = [k.name for k in KINDS if k.base]
    those = lambda which: F.collect_list(F.when(which, F.col("s")))
    by_row = judged.groupBy("rid").agg(those(F.col("s.kind").isin(base) | F.col("live")).alias("spans"), those(F.col("live")).alias("live"), those(F.col("copied")).alias("copied"))
    own = found.select("rid", "k1", "k2", "doc_id", F.filter("spans", lambda s: s["kind"].isin(base)).alias("base"))
    none = F.array().cast(f"array<{SPAN}>")
    of = lambda c: F.coalesce(c, none).alias(c)
    rows = own.join(by_row, "rid", "left").select("k1", "k2", "doc_id", "base", of("spans"), of("live"), of("copied"))
    return rows.select("*", F.size("live").cast("bigint").alias("n_live"), F.size("copied").cast("bigint").alias("n_copied"))


def digest(scanned: DataFrame) -> DataFrame:
    """One row of counts and span strings for each row of scan()."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        "doc_id",
        *(count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        *(_joined(F.col(c)).alias(c) for c in ("spans", "live", "copied")),
        "n_live",
        "n_copied",
    )


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of scan() in text_col replaced by mark; all rows and columns stay.

    Overlapping spans are replaced together. Null texts stay null. Texts are known by their hashes: equal texts have equal spans.
    text_col is looked up as Spark does, whatever its case.
    """
    same = [c for c in docs.columns if c == text_col] or [c for c in docs.columns if c.lower() == text_col.lower()]
    if len(same) != 1:
        raise ValueError(f"{text_col} names {len(same)} columns")
    told = scan(docs, id_col=id_col, text_col=text_col).where(F.size("spans") > 0)
    told = cut(told.groupBy("k1", "k2").agg(F.first("spans").alias("spans")).select("k1", "k2", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"]))).alias("spans")))
    rows = docs.select(F.struct("*").alias("row"), *row_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    text = F.col(f"row.`{same[0]}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        clear = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        new = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(new, F.concat(state["out"], clear, F.lit(mark))).otherwise(state["out"]).alias("out"))

    clean = let(F.aggregate("spans", start, step), lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
    out = F.when(F.col("spans").isNull(), text).otherwise(clean)
    return matched(rows, told, ["k1", "k2"], "left").select(*(out.alias(c) if c == same[0] else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
