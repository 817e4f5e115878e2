"""Document fingerprints: one-permutation MinHash with optimal densification, kept as low-order bits.

Every shingle is hashed once; the high bits name a bin and each bin keeps its least value. An empty bin takes the
value of the bin that a fixed random sequence for it meets first among those that aren't empty. Of each value
only the low bits are stored; the share of equal bins is corrected for those that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import written

U64 = np.uint64
NONE = U64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Scheme:
    """``bins`` is a power of two; ``bits`` divides 8."""

    bins: int = 512
    bits: int = 4
    words: int = 5

    @property
    def bytes(self) -> int:
        return self.bins * self.bits // 8


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words (fewer words: all of them) and the first one of each row."""
    text = T.column_bytes(column).lower()
    found = T.words(text)
    hashes = T.word_hashes(text, found)
    n = len(found.rows) - 1
    out = T.run_hashes(hashes, width)
    inside = T.whole_runs(found.rows, width)
    row = found.row_of()
    whole, of = out[inside], row[: len(out)][inside]
    short = np.flatnonzero((found.counts > 0) & (found.counts < width))
    if len(short):
        few = np.zeros(len(short), U64)
        with np.errstate(over="ignore"):
            for k in range(width - 1):
                more = np.flatnonzero(found.counts[short] > k)
                few[more] = T.mix(few[more] * T.BASE + hashes[found.rows[short[more]] + k])
        whole, of = np.concatenate([whole, few]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        whole, of = whole[order], of[order]
    return whole, np.searchsorted(of, np.arange(n + 1))


def densify(values: np.ndarray, empty: np.ndarray, tries: int = 4096) -> np.ndarray:
    """Fills empty bins in place; rows that are all empty stay as they are."""
    n, bins = values.shape
    row, slot = np.nonzero(empty & ~empty.all(1)[:, None])
    attempt = 0
    with np.errstate(over="ignore"):
        while len(row) and attempt < tries:
            attempt += 1
            other = (T.mix((np.arange(bins, dtype=U64) + U64(1)) * T.BASE + U64(attempt)) & U64(bins - 1)).astype(np.int64)[slot]
            full = ~empty[row, other]
            values[row[full], slot[full]] = values[row[full], other[full]]
            row, slot = row[~full], slot[~full]
    for r, s in zip(row.tolist(), slot.tolist(), strict=True):
        # Nothing met in all tries: the next bin that isn't empty, round the end.
        at = np.flatnonzero(~empty[r])
        values[r, s] = values[r, at[np.searchsorted(at, s) % len(at)]]
    return values


def fingerprints(column: pa.Array, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(rows of packed bytes, which texts have words). Texts without words have zero bytes."""
    hashes, first = shingle_hashes(column, scheme.words)
    n, shift = len(column), U64(64 - (scheme.bins - 1).bit_length())
    values = np.full(n * scheme.bins, NONE, U64)
    row = np.repeat(np.arange(n), np.diff(first))
    np.minimum.at(values, row * scheme.bins + (hashes >> shift).astype(np.int64), hashes & ((U64(1) << shift) - U64(1)))
    values = values.reshape(n, scheme.bins)
    known = np.diff(first) > 0
    values = densify(values, values == NONE)
    # The bin's number goes in, so that bins which borrowed one value don't agree by chance all at once.
    low = (T.mix(values ^ T.mix(np.arange(scheme.bins, dtype=U64) * T.BASE)) & U64((1 << scheme.bits) - 1)).astype(np.uint8)
    low[~known] = 0
    per = 8 // scheme.bits
    shifts = (np.arange(per) * scheme.bits).astype(np.uint8)
    return (low.reshape(n, -1, per) << shifts).sum(2, dtype=np.uint8), known


def likeness(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Estimated resemblance of the shingle sets behind two rows of packed bytes; two empty sets are alike, an empty and another are not."""
    equal = np.zeros(len(a), np.int64)
    mask = np.uint8((1 << scheme.bits) - 1)
    for k in range(8 // scheme.bits):
        shift = np.uint8(k * scheme.bits)
        equal += (((a ^ b) >> shift) & mask == 0).sum(1)
    chance = 1 / (1 << scheme.bits)
    out = np.clip((equal / scheme.bins - chance) / (1 - chance), 0, 1)
    return np.where(known_a & known_b, out, (known_a == known_b).astype(float))


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, gives way to as many (or all) from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"


def _answers(ids: pa.Array, texts: list[str], following: list[str], scheme: Scheme) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own, known = fingerprints(pa.array(texts, pa.string()), scheme)
    other, known_other = fingerprints(pa.array(changed, pa.string()), scheme)
    if texts[1:] == following[:-1] and texts:
        last, known_last = fingerprints(pa.array(following[-1:], pa.string()), scheme)
        nexts, known_next = np.concatenate([own[1:], last]), np.concatenate([known[1:], known_last])
    else:
        nexts, known_next = fingerprints(pa.array(following, pa.string()), scheme)
    return pa.RecordBatch.from_pydict({
        "doc_id": ids,
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "print": pa.array([p.tobytes() if k else b"" for p, k in zip(own, known, strict=True)], pa.binary()),
        "edited_print": pa.array([p.tobytes() if k else b"" for p, k in zip(other, known_other, strict=True)], pa.binary()),
        "near_edited": likeness(own, other, known, known_other, scheme),
        "near_next": likeness(own, nexts, known, known_next, scheme),
    })


def compare_with_next(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n_chars, edited_sha256, print, edited_print, near_edited, near_next).

    Prints are packed bytes, none for a text without words. Null texts are empty. The next document is the next in
    ascending order of doc_id (nulls first; rows with one doc_id in the order of their texts), after the last the first.
    Texts are dealt out by ranges of doc_id and read in order; only the first and the last text of each range are
    kept aside, to meet the neighbouring ranges' afterwards.
    """
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranged = ranged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        part = None

        def edge(kind: int, doc_id, text: str) -> pa.RecordBatch:
            return pad(pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "kind": pa.array([kind], pa.int32()), "text": pa.array([text], pa.string()), "doc_id": pa.array([doc_id], pa.int64())}))

        def pad(own: pa.RecordBatch) -> pa.RecordBatch:
            n = own.num_rows
            return pa.RecordBatch.from_arrays([own[f.name] if f.name in own.schema.names else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        for batch in T.slices(batches, "text"):
            texts, ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            if held is None:
                part = batch["part"][0].as_py()
                yield edge(0, ids[0], texts[0])
            else:
                texts, ids = [held[1], *texts], [held[0], *ids]
            if len(ids) > 1:
                yield pad(_answers(pa.array(ids[:-1], pa.int64()), texts[:-1], texts[1:], scheme))
            held = ids[-1], texts[-1]
        if held is not None:
            yield edge(1, *held)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
    columns = f"part int, kind int, text string, {COLUMNS}"
    arrow = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in columns.split(", "))])
    found = written(ranged.mapInArrow(run, columns))
    # The ranges that have rows, in order; each one's last text meets the first text of the next one.
    parts = sorted(r.part for r in found.where("kind = 0").select("part").collect())
    spark = docs.sparkSession
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next_part int")
    first = found.where("kind = 0").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    last = found.where("kind = 1").select("part", "doc_id", "text").join(following, "part").join(first, "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            yield _answers(batch["doc_id"], batch["text"].to_pylist(), batch["following"].to_pylist(), scheme)

    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    return found.where("kind is null").select(*names).unionByName(last.select("doc_id", "text", "following").mapInArrow(finish, COLUMNS))
