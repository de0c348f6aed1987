"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into pieces, and every piece is compressed with the dictionary of each class. The difference of the two
sums, over the text's length, is the score's only input. An isotonic curve, fitted on labelled texts that trained neither
dictionary, maps it to a probability that the label is 1: it rises with the difference and assumes no other form, as bad
text lies on both sides of a text that neither dictionary helps. Pieces keep the dictionaries' share in long texts as
large as in short ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.llm._common import bounded_batches, removed, shipped, written

shipped(__name__)

#: Bytes of a piece; bytes of a dictionary at most, and what it is of the pieces that it is trained on; zstandard's level.
PIECE, DICTIONARY, PART, LEVEL = 2048, 400 << 10, 0.25, 3
#: Of each class, at most so many labelled documents are used for the fit, and so many pieces of them for its dictionary.
FIT_DOCS, FIT_PIECES = 3000, 6000


@dataclass(frozen=True)
class CompressionModel:
    """The dictionaries of good and bad text, and the curve's points (difference, probability), straight between them."""

    good: bytes
    bad: bytes
    curve: tuple[tuple[float, float], ...]

    def scores(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of label 1 for each text, and the normalised size difference."""
        x = differences(texts, self.good, self.bad)
        return np.interp(x, *zip(*self.curve, strict=True)), x


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def _compressor(content: bytes):
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def differences(texts: Iterable[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """For each text, how many bytes a byte it is smaller with the good dictionary than with the bad one; 0 if empty."""
    by_good, by_bad = _compressor(good), _compressor(bad)
    out = []
    for text in texts:
        g, b = (sum(len(c.compress(x)) for x in _pieces(text)) for c in (by_good, by_bad))
        out.append((b - g) / max(len(text), 1))
    return np.array(out, np.float64)


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; the pieces themselves where the library finds them too few to train on."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, int(PART * sum(map(len, pieces)))), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY] or b" " * 8


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], ...]:
    """Points of the rising curve nearest to labels y (0 or 1) over x: neighbours out of order are pooled, each pool counts half of either label more."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []  # sum, number, least and greatest x
    for v, label in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([label, 1.0, v, v])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            total, n, _, most = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, pools[-1][2], most]
    points = [((least + most) / 2, (total + 0.5) / (n + 1)) for total, n, least, most in pools]
    return tuple((v, max(p for _, p in points[: k + 1])) for k, (v, _) in enumerate(points))


def _labelled(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int) -> DataFrame:
    """quality, part and text of at most per_class labelled documents of each class, chosen by a hash of doc_id.

    part is 0 for those that train the dictionaries, 1 for those that fit the curve. Only ids go to the driver. Labels
    other than 0 and 1, ids with both labels, null ids and empty texts are not used; of several texts of an id the least counts.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = [(r.doc_id, r.quality, i % 2) for c in (0, 1) for i, r in enumerate(marks.where(F.col("quality") == c).orderBy(order, "doc_id").limit(per_class).collect())]
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int, part int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "quality", "part").agg(F.min("text").alias("text")).select("quality", "part", F.col("text").cast("binary").alias("text"))


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for quality, text in zip(batch.column(0), batch.column(1), strict=True):
            pieces = _pieces(text.as_py())
            order = [xxhash.xxh3_64_intdigest(x) >> 1 for x in pieces]
            yield pa.record_batch({"quality": pa.array([quality.as_py()] * len(pieces), pa.int32()), "place": pa.array(order, pa.int64()), "piece": pa.array(pieces, pa.binary())})


def _measured(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"quality": batch.column(0), "x": pa.array(differences((t.as_py() for t in batch.column(1)), good, bad))})

    return run


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = FIT_DOCS, pieces: int = FIT_PIECES) -> CompressionModel:
    """A model from labels (doc_id, quality) where `usable` holds, and from the whole texts of docs (doc_id, text).

    per_class bounds the documents of each class. Half of them train its dictionary, by `pieces` pieces drawn by hash from
    anywhere in their texts; the others fit the curve. So the driver gets pieces and differences, never whole texts. If
    a class lacks documents for either, the curve is flat at the share of label 1 (one half without any labels).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts, path = written(_labelled(docs, labels, usable, per_class), "labelled")
    drawn = texts.where("part = 0").select("quality", "text").mapInArrow(_cut_up, "quality int, place long, piece binary")
    parts = [_dictionary([bytes(r.piece) for r in drawn.where(F.col("quality") == c).orderBy("place", "piece").limit(pieces).collect()]) for c in (0, 1)]
    rows = texts.where("part = 1").select("quality", "text").mapInArrow(_measured(parts[1], parts[0]), "quality int, x double").collect()
    n = {r["quality"]: r["count"] for r in texts.groupBy("quality").count().collect()}
    removed(spark, path)
    rows.sort()
    y = np.array([r.quality for r in rows], np.float64)
    if len(set(y)) < 2:
        share = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
        return CompressionModel(parts[1], parts[0], ((0.0, share),))
    return CompressionModel(parts[1], parts[0], isotonic(np.array([r.x for r in rows]), y))


def _score(model: CompressionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, x = model.scores(t.as_py() or b"" for t in batch.column(1).cast(pa.binary()))
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32)), "difference": pa.array(x)})

    return run


def quality_scores(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id, score, predicted and difference for every row of docs (doc_id long, text), from its whole text.

    score is the probability of label 1; predicted is 1 from one half up. A null or empty text has difference 0. Long texts
    are measured piece by piece, whole. Rows that repeat are scored one by one; an empty table gives an empty result;
    other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(_score(model), "doc_id long, score double, predicted int, difference double")


def kept_by_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """The rows of docs that the model predicts as 1, with all their columns; each row is judged by its own text."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    inner = {f"c{i}": c for i, c in enumerate(names)}
    text = f"c{names.index('text')}"
    plain = docs.toDF(*inner)
    schema = plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, _ = model.scores(t.as_py() or b"" for t in batch.column(text).cast(pa.binary()))
            yield batch.filter(pa.array(p >= 0.5))

    return plain.mapInArrow(run, schema).toDF(*names)
