"""Secret scans, with corpus-wide ownership of what they find. DataFrame functions only.

Base kinds: `assign` (a keyword, a sign and a value of 8 or more characters), `access` (AKIA keys of 16 or
more) and `hex` (32 or more hexadecimal digits). The method adds `bare`: strings of 24 or more characters
that mix digits with letters of both cases. The values of all candidates are hashed and counted over the
whole corpus by distinct repositories and owners: one that many owners or many repositories have is an
example, any other that a single owner has looks live. Bare strings that are examples make no span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Patterns, the group that holds the value, and least characters of that group.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
BARE = ("bare", r"[A-Za-z0-9+/_-]{24,}", 0, 24)
#: What a text must contain to be searched for a kind at all: the same matches, found sooner.
_NEEDS = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}", "bare": r"[A-Za-z0-9+/_-]{24}"}
#: Owners from which on a value counts as a widely copied example.
MANY_OWNERS = 3
#: Repositories, of all owners together, from which on it does.
MANY_REPOS = 10

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of a pattern as structs (start, kind, end, value), in code points.

    The pieces between matches and the matches take turns in the text, so their lengths give the places.
    """
    between, found, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(between.alias("b"), found.alias("f"), value.alias("v"))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

    def step(acc, p):
        start = acc["at"] + F.length(p["b"])
        end = start + F.coalesce(F.length(p["f"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["v"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(p["v"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, step)["out"]


def candidates(text: Column) -> tuple[Column, Column]:
    """The base spans of a text, and its bare ones; a bare span may lie within a base one."""
    none = F.expr(f"cast(array() as {_SPANS})")
    found = [F.when(text.rlike(_NEEDS[k]), spans(text, i, p, g, n)).otherwise(none) for i, (k, p, g, n) in enumerate((*KINDS, BARE))]
    base = F.concat(*found[:3])
    mixed = F.filter(found[3], lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & ~s["value"].rlike("^[0-9a-f]+$"))
    return base, mixed


def _listed(items: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in (*KINDS, BARE)))
    return F.concat_ws(",", F.transform(F.array_sort(items), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Null texts have no spans; null owners are one owner, null repositories one repository of their owner.
    Repeated rows give repeated rows. n_example counts spans whose value MANY_OWNERS owners or MANY_REPOS
    repositories have, n_live the others whose value one owner has alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.coalesce(F.col(owner_col), F.lit("\x00")).alias("owner"), text.alias("text"))
    base, bare = candidates(F.col("text"))
    found = materialize(rows.select("doc_id", "repo", "owner", base.alias("base"), bare.alias("bare")))  # spans, no texts
    # the few rows with candidates take part in the corpus-wide count; a row number would differ between runs
    key = F.xxhash64("doc_id", "repo", "owner", F.to_json("base"), F.to_json("bare"))
    some = found.filter(F.size("base") + F.size("bare") > 0).withColumn("row", key)
    values = F.array_distinct(F.transform(F.concat("base", "bare"), lambda s: F.sha2(s["value"], 256)))
    each = some.select("row", "repo", "owner", F.explode(values).alias("value")).distinct()
    # one row for each value and owner first, so a value that a third of all rows copy is summed in its map tasks
    owned = each.select("value", "owner", "repo").distinct().groupBy("value", "owner").agg(F.count("*").alias("repos"))
    stats = owned.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    example = (F.col("owners") >= MANY_OWNERS) | (F.col("repos") >= MANY_REPOS)
    judged = each.select("row", "value").join(stats, "value").groupBy("row").agg(
        F.collect_set(F.when((F.col("owners") == 1) & ~example, F.col("value"))).alias("single"),
        F.collect_set(F.when(example, F.col("value"))).alias("example"),
    )
    has = lambda name: lambda s: F.array_contains(name, F.sha2(s["value"], 256))
    hidden = lambda s: ~has("example")(s)
    with_spans = some.join(judged, "row").select(
        "doc_id", "base", F.concat("base", F.filter("bare", hidden)).alias("all"),
        F.size(F.filter(F.concat("base", "bare"), has("single"))).cast("long").alias("n_live"),
        F.size(F.filter(F.concat("base", "bare"), has("example"))).cast("long").alias("n_example"),
    )
    without = found.filter(F.size("base") + F.size("bare") == 0).select("doc_id", "base", F.col("base").alias("all"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return with_spans.unionByName(without).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"), "n_live", "n_example",
    )
