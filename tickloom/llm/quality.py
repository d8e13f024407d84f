"""Quality rules learned as a decision list. DataFrame functions only.

Sequential covering over labelled statistics: a rule grows threshold by threshold while that makes it purer
on two thirds of the labelled rows, is pruned on the last third, and joins the list if it is precise enough
there; the rows it covers leave, and the next rule grows on the rest. The list becomes one Spark conditional
expression, so a verdict is computed where the statistics are.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Statistics that rules may test, as expressions over the base columns.
STATS = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "kinds": "n_kinds / greatest(n_words, 1)",
}
#: How many labelled rows the rules are learned from at most, and what a rule must reach on the last third.
FIT_ROWS, PRECISION, COVERED, MOST_RULES, MOST_TESTS, CUTS = 20_000, 0.9, 3, 8, 3, 24


def sorted_windows(w: Column) -> Column:
    """Windows of three words with their place behind, sorted: copies are neighbours, in n log n for any text."""
    n = F.size(w)
    keyed = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1), F.lit(" "), F.element_at(w, i + 2), F.lpad(i.cast("string"), 11, " ")),
    )
    return F.sort_array(keyed)


def statistics(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id and the counts that rules test; null texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    rows = docs.select("doc_id", *extra, text.alias("t")).withColumn("w", F.filter(F.split("t", SPACE), lambda x: x != ""))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("sorted", F.when(F.size("w") >= 4, sorted_windows(F.col("w"))).otherwise(F.expr("cast(array() as array<string>)")))
    # a window repeats if a neighbour in sorted order has the same words; its place is the last 11 characters
    same = F.expr("""transform(sequence(1, greatest(size(sorted) - 1, 1)), i -> if(i < size(sorted)
        and length(sorted[i - 1]) = length(sorted[i]) and left(sorted[i - 1], length(sorted[i - 1]) - 11) = left(sorted[i], length(sorted[i]) - 11), i, -1))""")
    rows = rows.withColumn("same", F.filter(same, lambda i: i > 0))
    places = F.expr("array_sort(transform(array_union(same, transform(same, i -> i - 1)), i -> cast(ltrim(right(sorted[i], 11)) as int)))")
    rows = rows.withColumn("places", F.when(F.size("same") > 0, places).otherwise(F.expr("cast(array() as array<int>)")))
    # each repeated window adds its three words, less those that the window before it has added
    covered = F.expr("aggregate(sequence(1, greatest(size(places) - 1, 1)), 0, (a, i) -> a + if(i < size(places), least(3, places[i] - places[i - 1]), 0)) + if(size(places) > 0, 3, 0)")
    return rows.select(
        "doc_id", *extra,
        F.size("w").cast("long").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        count("!").alias("n_bangs"),
        count(r"\p{Lu}").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_kinds"),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> list[tuple[list[float], int]]:
    """(statistics, 1 for poor quality) of about `most` labelled documents at most, chosen and ordered by hashed id."""
    named = labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality")
    n = named.count()
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = named.filter(draw < min(1.0, most / max(n, 1))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # ids alone are sampled on the other side too, so that only chosen texts are read into statistics
    texts = docs.filter(draw < min(1.0, most / max(n, 1))).select("doc_id", "text").join(chosen, "doc_id")
    rows = statistics(texts, ("quality",)).select("doc_id", *(F.expr(e).alias(k) for k, e in STATS.items()), (F.col("quality") == 0).cast("int").alias("poor"))
    return [([r[k] for k in STATS], r["poor"]) for r in sorted(rows.distinct().collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r))]


Test = tuple[int, str, float]


def learn(rows: list[tuple[list[float], int]]) -> list[list[Test]]:
    """Ordered rules, each a conjunction of thresholds that finds poor documents. Works on the bounded sample."""
    if not rows:
        return []
    x, y = np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows], dtype=bool)
    third = np.arange(len(rows)) % 3 == 0
    grow, prune = (x[~third], y[~third]), (x[third], y[third])
    cuts: list[Test] = []
    for k in range(len(STATS)):
        picked = {float(np.sort(v)[len(v) * q // CUTS]) for v in (grow[0][:, k], grow[0][grow[1], k]) if len(v) for q in range(1, CUTS)}
        cuts += [(k, op, v) for v in sorted(picked) for op in (">=", "<")]

    def passes(part, rule):
        out = np.ones(len(part[1]), dtype=bool)
        for k, op, v in rule:
            out &= part[0][:, k] >= v if op == ">=" else part[0][:, k] < v
        return out

    def gain(part, test):  # FOIL gain
        hit = passes(part, [test])
        p, n, p0 = int(part[1][hit].sum()), int(hit.sum()), int(part[1].sum())
        return p * (math.log2(p / n) - math.log2(p0 / len(part[1]))) if p else 0.0

    def hits(rule):
        return prune[1][passes(prune, rule)]

    def worth(rule):
        hit = hits(rule)
        return 2 * hit.mean() - 1 if len(hit) else -1.0

    rules: list[list[Test]] = []
    while len(rules) < MOST_RULES and grow[1].any():
        rule, left = [], grow
        while len(rule) < MOST_TESTS and not left[1].all():
            best = max((gain(left, t), t) for t in cuts)
            if best[0] <= 1e-9:
                break
            rule.append(best[1])
            on = passes(left, rule)
            left = (left[0][on], left[1][on])
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = hits(rule) if rule else np.zeros(0)
        if len(hit) < COVERED or hit.mean() < PRECISION:
            break
        rules.append(rule)
        grow, prune = ((part[0][off], part[1][off]) for part in (grow, prune) for off in (~passes(part, rule),))
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The decision list as a conditional expression: the first rule that holds rejects; what none finds is kept."""
    exprs = list(STATS.values())
    out = F.lit(True)
    for rule in reversed(rules):
        test = F.lit(True)
        for k, op, v in rule:
            test = test & (F.expr(exprs[k]) >= v if op == ">=" else F.expr(exprs[k]) < v)
        out = F.when(test, False).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words, fail the base rule and are not kept. Repeated rows give repeated rows.
    """
    s = statistics(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept")
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, the four statistics, base_failed, kept.

    A null or empty text has no words and fails the base rules. Repeated rows are judged each for itself. Labels of no
    document, and null labels, teach nothing; without labelled rows no rule is learned, and the base rules decide. A
    document that no rule covers is kept, if the base rules do not fail it.
    """
    return judge(docs, learn(labelled_sample(docs, labels)))
