"""Document quality from weak labels: heuristics that overlap, their accuracies by expectation-maximisation, a linear scorer.

Each heuristic votes keep, reject or nothing on a document; given labels are one more voter that speaks on few. How often
each pattern of votes occurs is counted over all documents. Expectation-maximisation over these counts finds how often good
documents are common, and each voter's votes for good and for bad documents, without knowing which are which. The resulting
probabilities label a bounded sample, on which a linear scorer over hashed words and word shapes is fitted. The scorer alone
judges, from the text alone, so a document that no heuristic speaks on is judged as well.

Results in odd cases: NULL and blank texts score 0 and are rejected. Labels without a document or value say nothing, and of several
for one id the lowest counts. Where the sample has documents of one kind only, the voters' probability is the score. An empty
table gives an empty result; repeated rows each get their row; further input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm import stats
from changeflow.llm.shared import few, stored

SAMPLE = 10_000
FEATURES = 1 << 14
ITERATIONS = 200
THRESHOLD = 0.5
GIVEN = "v_given"

Model = dict[str, tuple[float, float, float]]


def _votes() -> dict[str, Column]:
    """1: keep, 0: reject, -1: says nothing. Most look for one fault each, and say nothing where they do not find it."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    symbols, capitals, ends = share("n_symbols", "word_chars"), share("n_capitals", "n_words"), share("n_ends", "n_words")
    length, distinct, lines = share("word_chars", "n_words"), share("n_distinct", "n_words"), share("n_dup_lines", "n_lines")

    def fault(reject: Column) -> Column:
        return F.when(reject, 0).otherwise(-1).cast("tinyint")

    prose = (symbols < 0.02) & (capitals < 0.1) & (distinct > 0.3) & ends.between(0.02, 0.3) & (lines < 0.1) & (F.col("n_words") > 20)
    return {
        "v_symbols": fault(symbols > 0.08), "v_capitals": fault(capitals > 0.4), "v_shouts": fault(share("n_shouts", "n_words") > 0.3),
        "v_distinct": fault((distinct < 0.15) & (F.col("n_words") > 40)), "v_length": fault((length < 2) | (length > 14)),
        "v_ends": fault((ends < 0.004) & (F.col("n_words") > 60)), "v_lines": fault(lines > 0.5),
        "v_words": F.when(F.col("n_words") < 5, 0).when(F.col("n_words") >= 30, 1).otherwise(-1).cast("tinyint"),
        "v_prose": F.when(prose, 1).otherwise(-1).cast("tinyint"),
    }


def votes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and every voter's vote, for each document once."""
    text, found = F.col("text"), F.col("words")
    counted = stats.with_words(documents).select(
        "doc_id", F.size(found).alias("n_words"), (F.char_length(text) - stats.occurrences(text, stats.WHITE)).alias("word_chars"),
        stats.occurrences(text, stats.SYMBOLS).alias("n_symbols"), stats.occurrences(text, "!").alias("n_shouts"),
        stats.occurrences(text, ".!?").alias("n_ends"), F.size(F.regexp_extract_all(text, F.lit(r"[A-Z]{2,}"), F.lit(0))).alias("n_capitals"),
        F.size(F.split(text, "\n")).alias("n_lines"), stats._duplicate_lines(text).alias("n_dup_lines"), F.size(F.array_distinct(found)).alias("n_distinct"))
    voted = stored(counted.select("doc_id", *(c.alias(name) for name, c in _votes().items())), "votes")
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("tinyint")).alias(GIVEN))
    given = stored(given.withColumnRenamed("doc_id", "_id"), "given")
    return voted.join(few(given), voted["doc_id"] == given["_id"], "left").drop("_id").withColumn(GIVEN, F.coalesce(GIVEN, F.lit(-1).cast("tinyint")))


def accuracies(patterns: list[tuple[dict[str, int], int]], voters: list[str]) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """Share of good documents, and per voter and vote the chance of it for bad and for good documents.

    patterns: votes with their number of documents; at most 3 to the number of voters.
    """
    # Begin with the given labels where there are any, else with the heuristics, of which one objection weighs more than
    # the consent of others: each looks for another fault. This also says which of the two classes is the good one.
    good = [(0.95 if pattern[GIVEN] else 0.05) if pattern[GIVEN] >= 0 else 0.1 if 0 in pattern.values() else 0.9 for pattern, _ in patterns]
    total = sum(n for _, n in patterns)
    for _ in range(ITERATIONS):
        prior = sum(g * n for g, (_, n) in zip(good, patterns, strict=True)) / total
        table: dict[str, dict[int, tuple[float, float]]] = {}
        for voter in voters:
            sums = {vote: [1.0, 1.0] for vote in (-1, 0, 1)}
            for g, (pattern, n) in zip(good, patterns, strict=True):
                sums[pattern[voter]][0] += (1 - g) * n
                sums[pattern[voter]][1] += g * n
            whole = [sum(x[k] for x in sums.values()) for k in (0, 1)]
            chances = {vote: (x[0] / whole[0], x[1] / whole[1]) for vote, x in sums.items()}
            # No voter is taken to be worse than chance: an objection is never a point in a document's favour.
            chances[0] = (max(chances[0]), min(chances[0])) if chances[0][0] < chances[0][1] else chances[0]
            table[voter] = chances
        # Given labels stand; the other documents get the class that the voters make likely.
        new = [g if pattern[GIVEN] >= 0 else _posterior(pattern, prior, table) for g, (pattern, _) in zip(good, patterns, strict=True)]
        moved = max(abs(a - b) for a, b in zip(new, good, strict=True))
        good = new
        if moved < 1e-6:
            break
    return prior, table


def _posterior(pattern: dict[str, int], prior: float, table: dict[str, dict[int, tuple[float, float]]]) -> float:
    odds = math.log(max(prior, 1e-9) / max(1 - prior, 1e-9)) + sum(math.log(table[v][x][1] / table[v][x][0]) for v, x in pattern.items() if x >= 0)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _probability(prior: float, table: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """The same as an expression over the votes."""
    odds = F.lit(math.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    for voter, chances in table.items():
        rejects, keeps = (math.log(chances[x][1] / chances[x][0]) for x in (0, 1))
        odds = odds + F.when(F.col(voter) == 0, rejects).when(F.col(voter) == 1, keeps).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _terms(documents: DataFrame) -> DataFrame:
    """The row as it is, doc_id and terms: words in lower case, and shapes of words with letters of a kind folded into one."""
    shape = F.col("text")
    for run, mark in ((r"[0-9]+", "0"), (r"\p{Lu}+", "A"), (r"[a-z\p{Ll}]+", "a")):
        shape = F.regexp_replace(shape, run, mark)
    rows = documents.select(F.struct("*").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Shapes are few and common, words many and rare; a mark keeps them apart. Another stands for a word said twice in a row.
    plain = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    shapes = F.split(F.concat(F.lit("\x01"), F.regexp_replace(shape, r"[\x20\x09-\x0D]+", " \x01")), " ")
    rows = rows.select("row", "doc_id", F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("filled"), plain.alias("plain"), shapes.alias("shapes"))
    size = F.greatest(F.size("plain") - 1, F.lit(0))
    twice = F.filter(F.arrays_zip(F.slice("plain", 1, size).alias("a"), F.slice("plain", 2, size).alias("b")), lambda x: x["a"] == x["b"])
    return rows.select("row", "doc_id", "filled", F.concat("plain", "shapes", F.transform(twice, lambda x: F.lit("\x02"))).alias("terms"))


def _judged(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """row (the document as it is), doc_id, score and kept."""
    voted = stored(votes(documents, labels), "voted")
    voters = [c for c in voted.columns if c != "doc_id"]
    patterns = [(row.asDict(), row["_n"]) for row in voted.groupBy(*voters).agg(F.count("*").alias("_n")).collect()]
    patterns = [({v: pattern[v] for v in voters}, n) for pattern, n in patterns]
    if not patterns:
        return documents.select(F.struct("*").alias("row"), "doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    prior, table = accuracies(patterns, voters)
    share = min(1.0, sample / sum(n for _, n in patterns))
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000))
    chosen = voted.where("doc_id is not null").where(place < int(share * 1_000_000)).groupBy("doc_id").agg(F.min(_probability(prior, table)).alias("p"))
    chosen = stored(chosen.withColumnRenamed("doc_id", "_id"), "chosen")
    weak = documents.select("doc_id", "text").join(few(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "p")
    # A probability is two weighted examples, one of each kind.
    examples = _terms(weak).join(few(chosen), F.col("doc_id") == F.col("_id")).select("terms", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("x"))
    examples = stored(examples.select("terms", "x.label", "x.weight").where("weight > 0.01"), "examples")
    terms = _terms(documents)
    if examples.select("label").distinct().count() < 2:
        known = voted.select(F.col("doc_id").alias("_id"), _probability(prior, table).alias("p")).groupBy("_id").agg(F.min("p").alias("p"))
        judged = terms.join(known, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("score", F.col("p"))
    else:
        model = Pipeline(stages=[
            HashingTF(numFeatures=FEATURES, inputCol="terms", outputCol="counts"), Normalizer(inputCol="counts", outputCol="features", p=2.0),
            LogisticRegression(weightCol="weight", regParam=1e-6, maxIter=60, standardization=False)]).fit(examples)
        judged = model.transform(terms).withColumn("score", vector_to_array("probability")[1])
    judged = judged.withColumn("score", F.when(F.col("filled"), F.col("score")).otherwise(0.0))
    return judged.select("row", "doc_id", "score", (F.col("score") >= THRESHOLD).alias("kept"))


def scored(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, score (0 to 1) and kept."""
    return _judged(documents.select("doc_id", "text"), labels, sample).select("doc_id", "score", "kept")


def good(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, unchanged, that are kept."""
    return _judged(documents, labels, sample).where("kept").select("row.*")
