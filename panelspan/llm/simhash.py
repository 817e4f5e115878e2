"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

Fingerprints are computed where the texts are; all later steps see eight bytes a document.
Distinct fingerprints meet under pigeonhole keys. In each group that shares a key, a table of
Hamming distances to reference fingerprints (pivots) discards the pairs whose distances to some
pivot differ by more than the limit - by the triangle inequality these can't be near - and only
the survivors' fingerprints are compared. A group returns links that connect what it connects
(a spanning forest), never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import connected_components
from .pigeonhole import block_keys
from .scratch import written

SEED = 42
U64 = np.uint64


def majority_bits(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row of hashes, the 64-bit number whose bits are set in over half of them (none: zero)."""
    out = np.zeros(len(rows) - 1, U64)
    weights = U64(1) << np.arange(64, dtype=U64)
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        if a == b:
            continue
        if b - a == 1:
            out[i] = hashes[a]
            continue
        total = np.zeros(64, np.int64)
        for c in range(a, b, 1 << 16):
            part = np.ascontiguousarray(hashes[c : min(b, c + (1 << 16))]).view(np.uint8)
            total += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
        out[i] = weights[2 * total > b - a].sum(dtype=U64)
    return out


def text_fingerprints(column: pa.Array, width: int = 3) -> np.ndarray:
    """SimHash of each text: lower-cased A-Z, words between ASCII white space, shingles of ``width`` words."""
    text = T.column_bytes(column).lower()
    found = T.words(text)
    line, starts, ends = T.joined(text, found)
    counts = found.counts
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    rows = np.concatenate([[0], np.cumsum(shingles)])
    first = np.repeat(found.rows[:-1] - rows[:-1], shingles) + np.arange(rows[-1])
    last = first + np.repeat(np.minimum(counts, width) - 1, shingles)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), U64, int(rows[-1]))
    return majority_bits(hashes, rows)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """documents -> (doc_id, fp long). A null or empty text has fingerprint zero; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(text_fingerprints(part["text"], width).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints: zero (whose distances are bit counts), then fixed well-spread numbers."""
    return np.concatenate([np.zeros(1, U64), T.mix(np.arange(1, count, dtype=U64) * T.BASE)])


def pivot_table(values: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[:, None] ^ references[None, :]).astype(np.int8)


def _near(table: np.ndarray, values: np.ndarray, i: np.ndarray | int, j: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs (i, j) are near: the pivot table discards, the fingerprints decide."""
    kept = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=-1) <= distance)
    a = values[i] if np.ndim(i) == 0 else values[i[kept]]
    return kept[np.bitwise_count(a ^ values[j[kept]]) <= distance]


def _spanning(values: np.ndarray, table: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that connect the members of one group as all its near pairs would, found breadth first:
    a member is only compared with those not reached yet, whose distance to the first pivot is in range."""
    order = np.argsort(table[:, 0], kind="stable")
    values, table = values[order], table[order]
    waiting = np.arange(len(values))
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            own = table[waiting, 0]
            a, b = np.searchsorted(own, table[at, 0] - distance), np.searchsorted(own, table[at, 0] + distance, "right")
            hit = _near(table, values, at, waiting[a:b], distance) + a
            for k in waiting[hit].tolist():
                yield int(order[at]), int(order[k])
                queue.append(k)
            waiting = np.delete(waiting, hit)


def group_links(keys: np.ndarray, values: np.ndarray, distance: int, references: np.ndarray, small: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal ``keys``: small groups all at once, by shifts; larger ones one by one."""
    table = pivot_table(values, references)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edges)
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for shift in range(1, min(small, len(keys))):
        i = np.flatnonzero((keys[shift:] == keys[:-shift]) & (size_of[shift:] <= small))
        hit = i[_near(table, values, i, i + shift, distance)]
        left.append(values[hit])
        right.append(values[hit + shift])
    for k in np.flatnonzero(sizes > small):
        a, b = edges[k], edges[k + 1]
        if pairs := list(_spanning(values[a:b], table[a:b], distance)):
            i, j = np.array(pairs).T
            left.append(values[a:b][i])
            right.append(values[a:b][j])
    none = [np.zeros(0, U64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def links(distinct: DataFrame, distance: int = 3, references: int = 16, largest: int = 20_000) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect all that pairs within ``distance`` connect.

    Groups of over ``largest`` members are dealt out again under longer keys: those of a finer cut of the bits, then those with the bands of
    their distances to one pivot after the other.
    """
    table = pivots(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(keys) > 1:
                u, v = group_links(keys, values.view(U64), distance, table)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            keys, values = (np.concatenate([old, batch[c].to_numpy()]) for old, c in ((held_keys, "key"), (held, "fp")))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from out(keys[:whole], values[:whole])
            held_keys, held = keys[whole:], values[whole:]
        yield from out(held_keys, held)

    def within(keyed: DataFrame) -> DataFrame:
        return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")

    def keyed(values: DataFrame, blocks: int) -> DataFrame:
        return values.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key"))

    def banded(rows: DataFrame, pivot: int) -> DataFrame:
        """Longer keys: with the band of the distance to a pivot. Distances of two linked fingerprints differ by ``distance`` at most, so one near
        a band's lower edge is in the band below, too."""
        width = 2 * distance + 2
        far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(table.view(np.int64)[pivot]))))
        band = F.floor(far / width)
        both = F.when(F.pmod(far, F.lit(width)) < distance, F.array(band, band - 1)).otherwise(F.array(band))
        return rows.select("fp", "key", F.explode(both).alias("b")).select("fp", F.xxhash64("key", F.lit(pivot), "b").alias("key"))

    out, rows = None, keyed(distinct, distance + 2)
    for level in range(references + 2):
        crowded = written(rows.groupBy("key").count().where(F.col("count") > largest).select("key"))
        fine = crowded.isEmpty() or level == references + 1
        found = within(rows if fine else rows.join(crowded, "key", "left_anti"))
        out = found if out is None else out.unionByName(found)
        if fine:
            return out
        again = rows.join(crowded, "key", "left_semi")
        # First a finer cut of the bits, then the pivots' bands, one after the other.
        rows = written(keyed(again.select("fp").distinct(), 2 * distance + 2) if level == 0 else banded(again, level - 1))
    return out


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, fp long, component_id): fingerprints that differ in at most
    ``distance`` bits are linked; a component is named by its smallest doc_id.

    Null and empty texts share fingerprint zero and so are linked. Rows without a doc_id are returned with
    the component of their fingerprint (null where no row of it has a doc_id). Repeated rows are returned as often as given.
    """
    prints = written(fingerprints(docs, width))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(links(least.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = least.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "component").join(names, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
