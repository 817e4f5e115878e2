"""Benchmark decontamination: each shard of the corpus gets an FM-index, in which benchmark phrases are searched.

A shard holds the words of many documents as symbols of the benchmark's vocabulary. Runs of such words
that are shorter than the shortest phrase can't hold one and aren't indexed; the others are indexed whole.
Backward search finds every phrase, sampled suffix positions say where, and overlapping spans merge.
Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import text as T
from .fm_index import FMIndex

U64 = np.uint64


@dataclass
class Phrases:
    """Distinct windows of the items: rows of symbols by length, and the items that hold each."""

    vocabulary: np.ndarray
    windows: dict[int, np.ndarray]
    holders: dict[int, list[list[int]]]
    items: list[str | None]

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)

    def names(self, window: int) -> list[str]:
        """The item_ids that hold a window, by its number."""
        for own in self.holders.values():
            if window < len(own):
                return [x for x in (self.items[k] for k in own[window]) if x is not None]
            window -= len(own)
        raise IndexError(window)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """2 and above for words of the vocabulary, 1 for others."""
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)


def phrases(item_ids: list, texts: list[str | None], width: int) -> Phrases:
    """All windows of ``width`` consecutive words; an item of fewer words is one window, one without words none."""
    text = T.column_bytes(pa.array(texts, pa.string())).lower()
    found = T.words(text, T.ALNUM)
    hashes = T.word_hashes(text, found)
    vocabulary = np.unique(hashes)
    symbols = np.searchsorted(vocabulary, hashes) + 2
    at: dict[int, dict[tuple, set[int]]] = {}
    for item, (a, b) in enumerate(zip(found.rows[:-1].tolist(), found.rows[1:].tolist(), strict=True)):
        size = min(width, b - a)
        for k in range(a, b - size + 1) if size else ():
            at.setdefault(size, {}).setdefault(tuple(symbols[k : k + size].tolist()), set()).add(item)
    return Phrases(
        vocabulary,
        {size: np.array(list(own), np.int64) for size, own in at.items()},
        {size: [sorted(x) for x in own.values()] for size, own in at.items()},
        [None if x is None else str(x) for x in item_ids],
    )


def hits(symbols: np.ndarray, rows: np.ndarray, wanted: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard: word positions at which windows begin, their lengths, and the numbers of the windows (those of one
    length follow those of the lengths before). ``rows`` has the first word of each document."""
    if not wanted.windows or not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    # Runs of vocabulary words inside one document that can hold the shortest window.
    known = symbols > 1
    wall = np.zeros(len(symbols) + 1, bool)
    wall[rows[:-1]] = True
    begin = known & (np.concatenate([[True], ~known[:-1]]) | wall[:-1])
    starts = np.flatnonzero(begin)
    run = np.cumsum(begin) - 1
    sizes = np.bincount(run[known], minlength=len(starts))
    long = sizes >= wanted.shortest
    if not long.any():
        return (np.zeros(0, np.int64),) * 3
    starts, sizes = starts[long], sizes[long]
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    packed = np.ones(int(offsets[-1] + sizes[-1] + 1), np.int64)
    source = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    packed[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = symbols[source]
    index = FMIndex(packed)
    where, length, window = [], [], []
    base = 0
    for size, windows in wanted.windows.items():
        low, high = index.search(windows)
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        which = np.repeat(found, count)
        at = index.locate(np.repeat(low[found] - (np.cumsum(count) - count), count) + np.arange(count.sum()))
        begin_of = np.searchsorted(offsets, at, "right") - 1
        at = starts[begin_of] + at - offsets[begin_of]
        where.append(at)
        length.append(np.full(len(at), size))
        window.append(which + base)
        base += len(windows)
    return np.concatenate(where), np.concatenate(length), np.concatenate(window)


def covered(where: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in some span."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, where, 1)
    np.add.at(edges, where + length, -1)
    return np.cumsum(edges[:-1]) > 0


def _shards(batches: Iterator[pa.RecordBatch], wanted: Phrases, size: int) -> Iterator[tuple[list[pa.RecordBatch], list]]:
    """Slices of the input with their words and these words' symbols, until they hold ``size`` words. Small slices: what tokenising needs is many times its text."""
    held, parts, n = [], [], 0
    for part in T.slices(batches, "text", 1 << 20):
        text = T.column_bytes(part["text"]).lower()
        found = T.words(text, T.ALNUM)
        held.append(part)
        parts.append((found, wanted.symbols(T.word_hashes(text, found))))
        n += len(found.starts)
        if n >= size:
            yield held, parts
            held, parts, n = [], [], 0
    if held:
        yield held, parts


def _answers(part: pa.RecordBatch, found: T.Words, where: np.ndarray, length: np.ndarray, window: np.ndarray, wanted: Phrases, cut: bool) -> pa.RecordBatch:
    """What ``scan`` says of one slice; ``where`` counts words of the slice. Adds what earlier blocks found."""
    n = part.num_rows
    hit = covered(where, length, len(found.starts))
    row = np.searchsorted(found.rows, where, "right") - 1
    items: list[set[str]] = [set() for _ in range(n)]
    # Items are added once for each window that a text holds, however often it holds it.
    if len(row):
        for r, k in zip(*np.unique(np.stack([row, window]), axis=1).tolist(), strict=True):
            items[r].update(wanted.names(k))
    if "spans" in part.schema.names:
        for r, (old, names) in enumerate(zip(part["spans"].to_pylist(), part["items"].to_pylist(), strict=True)):
            items[r].update(names)
            for a, b in zip(old[::2], old[1::2], strict=True):
                hit[found.rows[r] + a : found.rows[r] + b] = True
    total = np.concatenate([[0], np.cumsum(hit)])
    wall = np.zeros(len(hit) + 1, bool)
    wall[found.rows] = True
    begins = np.flatnonzero(hit & (np.concatenate([[True], ~hit[:-1]]) | wall[:-1]))
    ends = np.flatnonzero(hit & (np.concatenate([~hit[1:], [True]]) | wall[1:])) + 1
    of = np.searchsorted(begins, found.rows)
    spans = [np.stack([begins[a:b] - r, ends[a:b] - r], 1).ravel() for a, b, r in zip(of[:-1], of[1:], found.rows[:-1], strict=True)]
    out = {name: part[name] for name in part.schema.names if name not in ("spans", "items", "n_words", "n_hit")}
    out |= {
        "n_words": pa.array(found.counts, pa.int64()),
        "n_hit": pa.array(total[found.rows[1:]] - total[found.rows[:-1]], pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.int64())),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
    }
    if cut:
        texts = part["text"].to_pylist()
        base = T.column_bytes(part["text"]).offsets
        for r in np.flatnonzero(of[1:] > of[:-1]).tolist():
            raw, kept, last = texts[r].encode(), [], 0
            for a, b in zip(found.starts[begins[of[r] : of[r + 1]]] - base[r], found.ends[ends[of[r] : of[r + 1]] - 1] - base[r], strict=True):
                kept.append(raw[last:a])
                last = b
            texts[r] = b"".join([*kept, raw[last:]]).decode()
        out["text"] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_pydict(out)


def scan(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, cut: bool = False, width: int = 10, shard_words: int = 250_000, block_bytes: int = 8 << 20) -> DataFrame:
    """``columns`` of ``docs`` (all of them) and: n_words; n_hit, the words inside any occurrence of a window; spans,
    an array of word positions [begin, end, begin, end, ...], merged; items, the item_ids of the windows, sorted as strings.
    With ``cut``, text is returned without the spans (from the first byte of their first word to the last of their last).

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. Null texts have no words
    and stay null unless ``cut``. Items without words match nothing; those without an item_id count in n_hit and spans, not in items; rows that repeat an item_id count as one item.
    The benchmark is sent to the executors in blocks of about ``block_bytes`` of text, one pass over the documents each.
    A shard's index holds ``shard_words`` words and what the last slice of 1 MB adds, which bounds a task's memory.
    Columns of ``docs`` whose names clash with those added are replaced.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    own = [c for c in (columns or docs.columns) if not (cut and c == "text") and c not in ("n_words", "n_hit", "spans", "items")]
    found = docs.select(F.struct(*own).alias("row"), F.col("text").cast("string").alias("text"))
    for block in range(blocks):
        rows = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(blocks)) == block)).collect()
        found = _scan_block(found, phrases([r.item_id for r in rows], [r.text for r in rows], width), shard_words, block < blocks - 1, cut)
    kept = [F.col("text") if cut and c == "text" else F.col(f"row.`{c}`") for c in (columns or docs.columns) if c in own or cut and c == "text"]
    return found.select(*kept, "n_words", "n_hit", "spans", "items")


def _scan_block(docs: DataFrame, wanted: Phrases, shard_words: int, more: bool, cut: bool) -> DataFrame:
    """One pass. ``more``: other blocks follow, which need the text as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, parts in _shards(batches, wanted, shard_words):
            base = np.cumsum([0, *(len(s) for _, s in parts)])
            symbols = np.concatenate([s for _, s in parts])
            rows = np.concatenate([[0], *(f.rows[1:] + b for (f, _), b in zip(parts, base, strict=False))]).astype(np.int64)
            where, length, window = hits(symbols, rows, wanted)
            for k, (part, (found, _)) in enumerate(zip(held, parts, strict=True)):
                inside = (where >= base[k]) & (where < base[k + 1])
                out = _answers(part, found, where[inside] - base[k], length[inside], window[inside], wanted, cut and not more)
                yield out.select(names)

    added = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("spans", ArrayType(LongType())), StructField("items", ArrayType(StringType()))]
    schema = StructType([*docs.select("row", *["text"] * (more or cut)).schema.fields, *added])
    names = schema.names
    return docs.mapInArrow(run, schema)

