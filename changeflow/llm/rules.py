"""Learned decision lists over text statistics: sequential covering, written out as ordered conditions.

Rules that reject are found one after the other on labelled documents. A rule grows by the threshold on one statistic
that gains most over the rows it still covers, then loses the conditions that do not help on rows it has not seen, and the
rows it covers are set aside for the next rule. Thresholds are quantiles of the rows still covered and of the bad ones among them.
Each step is an aggregate over a written table of statistics; only counts by statistic and threshold reach the driver. The finished list is one `when ... when ... otherwise` expression, so documents
are judged in the scan that reads them, without a shuffle.

Only DataFrame functions run here. Learning reads at most about `SAMPLE` labelled documents, chosen by a hash of their id.

Results in odd cases: NULL and blank texts have all counts 0 and fail the base rule. Rows without a label, and labels without
a document, teach nothing; of several labels for one id the lowest counts. With no labels, or labels of one kind, the list is
empty and all that pass the base rule are kept. Repeated documents each get their row; further input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm import stats
from changeflow.llm.shared import few, stored

SAMPLE = 20_000
CUTS = 24
CONDITIONS, RULES = 4, 12
#: Of the rows a rule covers that it has not seen, this share must be rightly rejected.
PRECISION = 0.9
MIN_WORDS, REPEAT_PERCENT = 50, 50

Condition = tuple[str, str, float]


def _shares() -> dict[str, Column]:
    """The statistics that rules may test, independent of a text's length but for the last."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return {
        "symbols": share("n_symbols", "word_chars"), "repeats": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_words"), "word_length": share("word_chars", "n_words"),
        "ends": share("n_ends", "n_words"), "shouts": share("n_shouts", "n_words"), "digits": share("n_digits", "word_chars"),
        "capitals": share("n_capitals", "n_words"), "distinct": share("n_distinct", "n_words"), "words": F.col("n_words").cast("double"),
    }


def _holds(condition: Condition, columns: dict[str, Column]) -> Column:
    name, side, cut = condition
    return columns[name] <= F.lit(cut) if side == "<=" else columns[name] > F.lit(cut)


def _all(rule: list[Condition], columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & _holds(condition, columns)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def labelled_statistics(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics of about `sample` labelled documents that pass the base rule, with `bad` and `grow` (else: prune)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stored(known, "labels")
    share = min(1.0, sample / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    chosen = stored(known.where(place < int(share * 1_000_000)).select(F.col("doc_id").alias("_id"), "quality"), "sample")
    rows = documents.select("doc_id", "text").join(few(chosen), F.col("doc_id") == F.col("_id"))
    # Written before they are filtered: a filter on a statistic would otherwise work it out a second time.
    counted = stored(stats.counted(rows.select("doc_id", "text")), "counted").where(~base_failed())
    shares = counted.select("doc_id", *(c.alias(name) for name, c in _shares().items()))
    marked = shares.join(few(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
    return stored(marked.select(
        *_shares(), (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2).alias("grow")), "statistics")


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained on the rejected rows by going from p0 of p0 + n0 to p of p + n."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _cuts(covered: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Cut points of each statistic: quantiles of the rows covered, and those of the bad ones among them, from just below each."""
    places = [i / (CUTS + 1) for i in range(CUTS + 2)]
    quantiles = covered.agg(*(F.percentile_approx(F.when(which, F.col(name)), places, 10_000).alias(f"{kind}_{name}")
                              for name in names for kind, which in (("all", F.lit(True)), ("bad", F.col("bad"))))).first()
    cuts = {}
    for name in names:
        bad = quantiles[f"bad_{name}"] or []
        cuts[name] = sorted({*(quantiles[f"all_{name}"] or []), *bad, *(math.nextafter(x, -math.inf) for x in bad)})
    return cuts


def _candidates(covered: DataFrame, names: list[str]) -> list[Condition]:
    """The best cut of each statistic and side that gains over the rows covered, best first."""
    cuts = _cuts(covered, names)
    if not cuts[names[0]]:
        return []
    # How many cut points of a statistic a row exceeds is its bin there.
    below = lambda name: lambda cut: F.col(name) > cut
    bins = [F.struct(F.lit(i).alias("which"), F.size(F.filter(F.array(*map(F.lit, cuts[name])), below(name))).alias("bin")) for i, name in enumerate(names)]
    counts = covered.select("bad", F.explode(F.array(*bins)).alias("at")).groupBy("at.which", "at.bin").agg(
        F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    p0, n0 = (sum(row[x] for row in counts if row["which"] == 0) for x in "pn")
    if not p0 or not n0:
        return []
    best: dict[tuple[str, str], tuple[float, Condition]] = {}
    for i, name in enumerate(names):
        by_bin = {row["bin"]: (row["p"], row["n"]) for row in counts if row["which"] == i}
        p = n = 0
        for at, cut in enumerate(cuts[name]):
            p, n = p + by_bin.get(at, (0, 0))[0], n + by_bin.get(at, (0, 0))[1]
            for value, condition in ((_gain(p, n, p0, n0), (name, "<=", cut)), (_gain(p0 - p, n0 - n, p0, n0), (name, ">", cut))):
                if value > best.get(condition[:2], (1.0,))[0]:
                    best[condition[:2]] = value, condition
    return [condition for _, condition in sorted(best.values(), key=lambda x: -x[0])]


def _pruned(rule: list[Condition], left: DataFrame, columns: dict[str, Column]) -> list[Condition]:
    """The rule's first conditions that serve rows it has not seen best; none where they are not precise enough there."""
    held = left.where("not grow").agg(*(
        F.count_if(_all(rule[: i + 1], columns) & (F.col("bad") if kind == "p" else ~F.col("bad"))).alias(f"{kind}{i}") for i in range(len(rule)) for kind in "pn")).first()
    worth = [((held[f"p{i}"] - held[f"n{i}"]) / max(1, held[f"p{i}"] + held[f"n{i}"]), -i) for i in range(len(rule))]
    keep = -max(worth)[1]
    if held[f"p{keep}"] < PRECISION * (held[f"p{keep}"] + held[f"n{keep}"]) or not held[f"p{keep}"]:
        return []
    return rule[: keep + 1]


def learned(rows: DataFrame) -> list[list[Condition]]:
    """Rules in order; a row that meets all conditions of one is rejected.

    Where a rule fails, the next best statistic and side begins another one. Cut points are taken anew from the rows a rule
    covers, so a tighter cut on the same statistic comes as a further condition.
    """
    names = list(_shares())
    columns = {name: F.col(name) for name in names}
    left, rules = rows, []
    while len(rules) < RULES:
        grow = left.where("grow")
        for first in _candidates(grow, names):
            rule = [first]
            while len(rule) < CONDITIONS and (more := _candidates(grow.where(_all(rule, columns)), names)):
                rule.append(more[0])
            if rule := _pruned(rule, left, columns):
                break
        else:
            break
        rules.append(rule)
        left = left.where(~_all(rule, columns))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one expression: false by the first rule that holds, else true."""
    columns, out = _shares(), None
    for rule in rules:
        out = F.when(_all(rule, columns), False) if out is None else out.when(_all(rule, columns), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(documents: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept."""
    counted = stats.counted(documents)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
