"""Language of each document as a mixture: proportions by expectation-maximisation, the set of languages by penalty.

Letters of a text are cut into overlapping runs of four bytes. From labelled documents each language learns how often it
uses each run, in a table of fixed size; a single letter between spaces is a run too. A text's runs are then explained as drawn from a mixture of languages;
expectation-maximisation finds the proportions, and of the sets of the best one, two, three and more languages that one is
chosen whose likelihood, less a penalty for each further language, is largest. The language with the largest part is the prediction.
As a filter, the mixture has one part more, a background that uses all runs alike: it takes what no learned language explains.

Results in odd cases: NULL and texts without a letter are `und` with score 0, as is every text where nothing was learned.
Rows without an id or a label teach nothing; rows without an id are not held out. Very long texts are read in
pieces of bounded size. Repeated rows each get their row; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.shared import pieces

BUCKET_BITS = 16
RUN = 4
UNKNOWN = "und"
#: What each run that a language was never seen to use counts as.
SMOOTHING = 0.5
STEPS = 25
#: The background is told from a language learned from little text only in more steps.
BACKGROUND_STEPS = 400
#: Sets of languages are enlarged until so many enlargements in a row have not paid.
PATIENCE = 2
_LETTER = regex.compile(r"\p{L}").search
#: A-Z are lower-cased before; what is no letter among the first 128 characters separates words.
_LETTERS = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))


def runs(text: str) -> np.ndarray:
    """How often the text has each run of bytes, by bucket."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for piece in pieces(text.lower().encode().translate(_LETTERS)):
        found = piece.split()
        # A single letter has a run too.
        data = np.frombuffer((b" " + b" ".join(found) + b" ").ljust(RUN), np.uint8).astype(np.uint32)
        if found:
            joined = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
            bucket = (joined * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
            counts += np.bincount(bucket, minlength=1 << BUCKET_BITS)
    return counts


def _fitted(likelihood: np.ndarray, counts: np.ndarray, steps: int = STEPS, near: float = 1e-3) -> tuple[np.ndarray, float]:
    """Proportions of the mixture, and the log-likelihood under them."""
    share, total = np.full(likelihood.shape[1], 1 / likelihood.shape[1]), counts.sum()
    for _ in range(steps if likelihood.shape[1] > 1 else 0):
        new = share * ((counts / (likelihood @ share)) @ likelihood) / total
        done = np.abs(new - share).max() < near
        share = new
        if done:
            break
    return share, float(counts @ np.log(likelihood @ share))


def proportions(counts: np.ndarray, model: np.ndarray) -> list[tuple[int, float]]:
    """The chosen languages with their proportions, largest first: as many as pay for the penalty. model: buckets by languages."""
    used = np.flatnonzero(counts)
    likelihood, weight = model[used].astype(np.float64), counts[used].astype(np.float64)
    share, _ = _fitted(likelihood, weight)
    order, best, idle = np.argsort(-share, kind="stable"), None, 0
    single = weight @ np.log(likelihood)
    for k in range(1, model.shape[1] + 1):
        chosen = order[:k] if k > 1 else np.array([int(np.argmax(single))])
        part, fit = _fitted(likelihood[:, chosen], weight)
        # Each letter is in RUN runs, so the likelihood counts everything that often.
        value = fit / RUN - k * np.log(weight.sum() + 1)
        if best is None or value > best[0]:
            best, idle = (value, sorted(zip(chosen.tolist(), part.tolist(), strict=True), key=lambda x: -x[1])), 0
        else:
            idle += 1
            if idle == PATIENCE:
                break
    return best[1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language and bucket, once for every part of the labelled rows."""
    total: dict[str, np.ndarray] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for language, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(used)), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        for text, language in zip(batch.column("text"), batch.column("lang"), strict=True):
            if len(total) >= 64 and language.as_py() not in total:
                yield from given()
            counts = runs(text.as_py())
            name = language.as_py()
            total[name] = total[name] + counts if name in total else counts
    yield from given()


class Model:
    """Languages and, for every bucket, how likely each language is to use it.

    `novel` is the part of a language's own runs that its labelled text has not shown yet (Good-Turing: runs seen once over all runs).
    A language takes a quarter of a megabyte, and all of them are learned.
    """

    def __init__(self, languages: list[str]):
        self.languages, self.total, self.novel = languages, np.zeros(len(languages)), np.ones(len(languages))
        self.likelihood = np.zeros((1 << BUCKET_BITS, len(languages)), np.float32)

    def learn(self, place: int, buckets: np.ndarray, counts: np.ndarray) -> None:
        """The counts of one language, each bucket once."""
        self.total[place] = counts.sum()
        self.novel[place] = min(1.0, ((counts == 1).sum() + 1) / (self.total[place] + 1))
        column = np.full(1 << BUCKET_BITS, SMOOTHING)
        column[buckets] += counts
        self.likelihood[:, place] = column / column.sum()

    def seen(self, buckets: np.ndarray) -> np.ndarray:
        """Relative counts without smoothing, as which the filter takes what is not novel."""
        smoothed = self.total + SMOOTHING * (1 << BUCKET_BITS)
        return np.maximum(0, self.likelihood[buckets] * smoothed - SMOOTHING) / np.maximum(self.total, 1)


def learned(documents: DataFrame) -> Model:
    """Learns from all documents that are not held out and have a label, and so from no prediction's own label."""
    rows = documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most 65 536 counts a language come to the driver, as columns.
    tables = dict(list(counts.toPandas().groupby("lang")))
    model = Model(sorted(tables))
    for place, language in enumerate(model.languages):
        model.learn(place, tables[language]["bucket"].to_numpy(), tables[language]["n"].to_numpy())
    return model


def _predicted(texts: pa.Array, model: Model) -> tuple[list[str], list[float], list[str]]:
    first, score, chosen = [], [], []
    for text in texts:
        text = text.as_py()
        counts = runs(text) if text and model.languages and _LETTER(text) else None
        if counts is None or not counts.any():
            first.append(UNKNOWN), score.append(0.0), chosen.append("")
            continue
        parts = proportions(counts, model.likelihood)
        first.append(model.languages[parts[0][0]])
        score.append(min(1.0, max(0.0, parts[0][1])))
        chosen.append(" ".join(f"{model.languages[x]}={part:.3f}" for x, part in parts))
    return first, score, chosen


def languages(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (part of the predicted language), and all chosen languages."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, score, chosen = _predicted(batch.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(first, pa.string()), pa.array(score, pa.float64()), pa.array(chosen, pa.string())],
                ["doc_id", "held_out", "lang_pred", "score", "lang_mix"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, lang_mix string")


def learned_share(counts: np.ndarray, model: Model) -> float:
    """Part of the text that learned languages, all together, explain better than a background that uses all buckets alike.

    A language's smoothed table is partly background itself, so here it is what was seen, and as much background as is still new in it.
    """
    used, even = np.flatnonzero(counts), 1 / (1 << BUCKET_BITS)
    parts = model.seen(used) * (1 - model.novel) + model.novel * even
    share, _ = _fitted(np.hstack([parts, np.full((len(used), 1), even)]), counts[used].astype(np.float64), BACKGROUND_STEPS, 1e-4)
    return 1.0 - float(share[-1])


def in_some_language(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, unchanged, of which learned languages together make up at least the share `least`."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def known(text: str | None) -> bool:
        counts = runs(text) if text and sent.value.languages and _LETTER(text) else None
        return counts is not None and bool(counts.any()) and learned_share(counts, sent.value) >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([known(text.as_py()) for text in batch.column("text")], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
