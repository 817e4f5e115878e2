"""A quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics are computed where the texts are. The normal equations of a partition's rows are one small matrix;
only these are summed up. Neither labels nor language, source or id enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import small, written

U64 = np.uint64
#: Classes of bytes: 0 lower-case letter, 1 upper-case letter, 2 digit, 3 space, 4 line break, 5 full stop or comma,
#: 6 other ASCII punctuation, 7 part of a non-ASCII character, 8 control character.
CLASSES = np.array([4 if b in (10, 13) else 3 if b in (9, 11, 12, 32) else 8 if b < 32 or b == 127 else 7 if b > 127 else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 5 if chr(b) in ".," else 6 for b in range(256)], np.int64)
FEATURES = ["size", "words", "word_length", "upper", "digits", "breaks", "stops", "marks", "foreign", "control", "doubled_marks", "markless", "different_words", "same_as_last", "different_pairs", "commonest", "long_words"]


def _different(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many different hashes it has, and how often the commonest one occurs."""
    key = np.sort((row.astype(U64) << U64(44)) | (hashes >> U64(20)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    of = (key[first] >> U64(44)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, np.diff(np.append(first, len(key))))
    return np.bincount(of, minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty or null text gets zeros."""
    n = len(column)
    text = T.column_bytes(column)
    size = np.diff(text.offsets)
    row = np.repeat(np.arange(n), size)
    kind = CLASSES[text.used]
    of = np.bincount(row * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
    mark = kind == 6
    doubled = np.zeros(len(kind), bool)
    doubled[1:] = mark[1:] & (text.used[1:] == text.used[:-1]) & (row[1:] == row[:-1])
    found = T.words(text)
    hashes = T.word_hashes(text, found)
    in_row = found.row_of()
    words = found.counts.astype(float)
    marks = np.concatenate([[0], np.cumsum(kind < 2)])
    bare = marks[found.ends] == marks[found.starts]
    length = found.ends - found.starts
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (in_row[1:] == in_row[:-1])
    pairs = T.run_hashes(hashes, 2)
    inside = T.whole_runs(found.rows, 2)
    kinds, most = _different(in_row, hashes, n)
    pair_kinds, _ = _different(in_row[: len(pairs)][inside], pairs[inside], n)

    def share(x: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.divide(x, total, out=np.zeros(n), where=total > 0)

    def sums(flags: np.ndarray) -> np.ndarray:
        return np.bincount(in_row[flags], minlength=n).astype(float)

    letters = of[:, 0] + of[:, 1]
    return np.stack([
        np.log1p(size), np.log1p(words), share(size - of[:, 3] - of[:, 4], words), share(of[:, 1], letters), share(of[:, 2], size), share(of[:, 4], words),
        share(of[:, 5], words), share(of[:, 6], size), share(of[:, 7], size), share(of[:, 8], size), share(np.bincount(row[doubled], minlength=n).astype(float), size),
        share(sums(bare), words), share(kinds.astype(float), words), share(sums(same), words), share(pair_kinds.astype(float), words), share(most.astype(float), words), share(sums(length > 24), words),
    ], 1)


def features(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, x: array of FEATURES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", 1 << 20):
            x = statistics(part["text"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


@dataclass
class Model:
    """Scaling, random directions, ridge weights, and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([np.ones((len(x), 1)), waves], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _row_numbers(rows: DataFrame, schema: str, each) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return rows.mapInArrow(run, schema)


def _normal_equations(rows: DataFrame, model: Model, parts: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows (x, y): within partitions, then in ``parts`` groups of them, then here."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                own = batch.slice(at, 8192)
                z = model.lift(_matrix(own["x"]))
                z = np.concatenate([z, own["y"].to_numpy()[:, None]], 1)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["m"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch["m"]).sum(0)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["m"])

    sums = rows.mapInArrow(add, "m array<double>").repartition(parts).mapInArrow(fold, "m array<double>").collect()
    n = len(model.phases) + 2
    total = np.sum([np.array(r.m) for r in sums], 0).reshape(n, n) if sums else np.zeros((n, n))
    return total[:-1, :-1], total[:-1, -1]


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(rows: DataFrame, waves: int = 256, ridge: float = 1e-3, seed: int = 7) -> Model:
    """``rows``: (doc_id, x, y in 0 and 1). Three quarters of them fit the ridge weights, the others calibrate.

    Without rows the model scores 0.5.
    """
    k = len(FEATURES)
    stats = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)], F.count("*").alias("n")).first()
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(k, waves)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, waves)
    if not stats["n"]:
        return Model(np.zeros(k), np.ones(k), directions, phases, np.zeros(waves + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([stats[f"m{i}"] for i in range(k)])
    scale = np.array([max(stats[f"s{i}"], 1e-9) for i in range(k)])
    model = Model(mean, scale, directions, phases, np.zeros(waves + 1), np.array([0.0]), np.array([0.5]))
    fourth = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    a, b = _normal_equations(rows.where(~fourth), model)
    model.weights = np.linalg.solve(a + ridge * max(a[0, 0], 1) * np.diag([1e-9, *np.ones(waves)]), b)
    # Scores of the other rows in narrow bins: that is all the calibration needs.
    scored = _row_numbers(rows.where(fourth).select("x", "y"), "bin long, y double", lambda b: pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(model.raw(_matrix(b["x"])), -1, 2) * 1000).astype(np.int64)), b["y"]], ["bin", "y"]))
    bins = sorted(scored.groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    if bins:
        model.levels = pool_adjacent(np.array([r.y for r in bins]), np.array([r.n for r in bins], float))
        model.knots = np.array([r.bin for r in bins]) / 1000
    return model


def labelled(labels: DataFrame, most_rows: int) -> DataFrame:
    """(doc_id, y) of the labels to learn from, written; see ``classify``."""
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(~held_out(F.col("doc_id")))
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most_rows)
    return written(known)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 200_000) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...) that a classifier trained on them and ``labels`` scores at ``threshold`` or more."""
    known = labelled(labels, most_rows)
    # Only labelled texts are measured to learn from.
    own = docs.select("doc_id", "text").join(small(known.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit(written(features(own).join(small(known), "doc_id")))
    source = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", 1 << 20):
            good = model.score(statistics(part["text"])) >= threshold
            yield pa.RecordBatch.from_arrays([part["row"].filter(pa.array(good))], ["row"])

    return source.mapInArrow(run, source.select("row").schema).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 200_000) -> DataFrame:
    """documents (doc_id, text), labels (doc_id, quality) -> (doc_id, held_out, score, predicted).

    Learns from the labelled rows that aren't held out (crc32 of doc_id as text, modulo 5, is 0); of over ``most_rows`` of
    them, from a sample of about that many by a hash of the doc_id. Every text is scored whole; null texts are empty.
    A null doc_id isn't held out. Null labels and labels of other documents are ignored; repeated rows count repeatedly.
    """
    every = written(features(docs))
    model = fit(written(every.join(small(labelled(labels, most_rows)), "doc_id")))
    scored = _row_numbers(every, "doc_id long, score double", lambda b: pa.RecordBatch.from_arrays([b["doc_id"], pa.array(model.score(_matrix(b["x"])))], ["doc_id", "score"]))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
