"""SentencePiece encoding and decoding; giant documents are encoded in chunks by a max-plus scan.

The models here are byte-pair encodings. Their encoding of a text is the only sequence of pieces in which every two
neighbours are compatible: encoding the two together gives back the two. That makes it the best path of a max-plus
problem whose steps weigh 0 (compatible) or minus infinity, and paths can be cut anywhere:

1. A giant text is cut every so many characters. The states of a cut are the pieces that may cover the last character before it (one
   state where no piece holds the characters on both sides, a space after a letter, say).
2. Each chunk gives a matrix from the states at its start to those at its end, alone: paths from its first states to its first place that no piece
   spans, and from its last such place to its last states; or all the way if it has none.
3. The matrices of a document are combined in a tree of max-plus products, and on the way back each cut's state is read off.
4. Each chunk traces its path back between its two states, on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import modest_batches, written

MINUS = -np.inf


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model, and the parts of it that chunks need. ``model``: the bytes of a SentencePiece file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.prefix = " " if spec.normalizer_spec.add_dummy_prefix else ""
        #: Chunks are for byte-pair models that take texts as they are; others encode every text whole.
        self.chunks = spec.trainer_spec.model_type == proto.TrainerSpec.BPE and spec.normalizer_spec.name == "identity" and not spec.normalizer_spec.remove_extra_whitespaces and spec.trainer_spec.byte_fallback
        spec.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        words = [p.piece.replace("▁", " ") for p in spec.pieces if p.type in (1, 4)]
        self.vocabulary = set(words)
        self.pairs = {w[k : k + 2] for w in words for k in range(len(w) - 1)}
        self.longest = max(map(len, words), default=1)
        self.ids = lru_cache(1 << 14)(lambda text: tuple(self.bare.encode(text)))
        #: Whether a run of characters is a piece that its own encoding gives.
        self.proper = lru_cache(1 << 14)(lambda own: own in self.vocabulary and len(self.ids(own)) == 1)
        self.single = lru_cache(1 << 14)(self._one)
        self.compatible = lru_cache(1 << 14)(lambda a, b: a[-1] + b[0] not in self.pairs or self.ids(a + b) == self.ids(a) + self.ids(b))

    def _one(self, piece: str) -> tuple[int, ...]:
        """The piece's own number, or, for a character that is none, its bytes'."""
        found = self.bare.piece_to_id(piece.replace(" ", "▁"))
        return (found,) if found != self.bare.unk_id() else self.ids(piece)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)

    def cuts(self, text: str, size: int) -> list[int]:
        """Every ``size`` characters, wherever that is."""
        return [*range(0, max(len(text), 1), size), len(text)]

    def firm(self, text: str, at: int) -> bool:
        """Whether no piece holds the characters on both sides."""
        return at <= 0 or at >= len(text) or text[at - 1 : at + 1] not in self.pairs

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces (start, end) that may cover the character before ``cut``; (cut, cut) alone where none spans it."""
        if self.firm(text, cut):
            return [(cut, cut)]
        low = next((k for k in range(cut - 1, cut - self.longest, -1) if self.firm(text, k)), max(0, cut - self.longest))
        high = next((k for k in range(cut + 1, cut + self.longest) if self.firm(text, k)), min(len(text), cut + self.longest))
        return [(a, b) for a in range(low, cut) for b in range(cut, min(high, a + self.longest) + 1) if b == a + 1 or self.proper(text[a:b])]

    def _reach(self, text: str, enter: list[tuple[int, int]], leave: list[tuple[int, int]]) -> dict[tuple[int, int], dict]:
        """All pieces on compatible paths that go on from a state of ``enter``, up to the ends of ``leave``: by piece, the states (bits) that it is
        reached from, and the piece before for each of them."""
        reach: dict[tuple[int, int], tuple[int, list]] = {}
        by_end: dict[int, set] = {}
        for k, state in enumerate(enter):
            reach[state] = (1 << k, [])
            by_end.setdefault(state[1], set()).add(state)
        stop = max(b for _, b in leave)
        for at in range(min(by_end), stop + 1):
            before = by_end.get(at)
            if not before:
                continue
            for end in range(at + 1, min(len(text), at + self.longest, stop) + 1):
                own = text[at:end]
                if end > at + 1 and not self.proper(own):
                    if self.firm(text, end):
                        break
                    continue
                bits, froms = 0, []
                for piece in before:
                    a, b = piece
                    if a == b or self.compatible(text[a:b], own):
                        bits |= reach[piece][0]
                        froms.append(piece)
                if bits:
                    reach[at, end] = (bits, froms)
                    by_end.setdefault(end, set()).add((at, end))
                if self.firm(text, end):
                    break
        return reach

    def _ends(self, reach: dict, leave: tuple[int, int]) -> list[tuple[int, int]]:
        """Pieces of ``reach`` with which a path is at a state: the state itself, or, at a place that no piece spans, all that end there."""
        return [p for p in reach if p[1] == leave[1]] if leave[0] == leave[1] else [leave] if leave in reach else []

    def fringes(self, text: str, enter: list[tuple[int, int]], leave: list[tuple[int, int]], low: int, high: int) -> tuple[int, int] | None:
        """The first and the last place between two cuts that no piece spans; paths only depend on the states up to and from there. None without one."""
        first = next((k for k in range(low, high + 1) if self.firm(text, k)), None)
        return None if first is None else (first, next(k for k in range(high, first - 1, -1) if self.firm(text, k)))

    def matrix(self, text: str, enter: list[tuple[int, int]], leave: list[tuple[int, int]], low: int, high: int) -> np.ndarray:
        """0 where a path of compatible pieces leads from a state at the cut ``low`` to one at ``high``, else minus infinity."""

        def paths(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> np.ndarray:
            if a == b:
                return np.where(np.eye(len(a), dtype=bool), 0.0, MINUS)
            reach = self._reach(text, a, b)
            out = np.full((len(a), len(b)), MINUS)
            for k, state in enumerate(b):
                bits = 0
                for piece in self._ends(reach, state):
                    bits |= reach[piece][0]
                out[[s for s in range(len(a)) if bits >> s & 1], k] = 0
            return out

        span = self.fringes(text, enter, leave, low, high)
        if span is None:
            return paths(enter, leave)
        return product(paths(enter, [(span[0], span[0])]), paths([(span[1], span[1])], leave))

    def backtrace(self, text: str, enter: tuple[int, int], leave: tuple[int, int], low: int, high: int) -> list[int]:
        """The pieces after the state ``enter`` up to and with ``leave``, from the path found between them. Between the first and the last place
        that no piece spans there is one state at each such place, and the library encodes what lies there."""

        def pieces(a: tuple[int, int], b: tuple[int, int]) -> list[int]:
            if a == b or a[1] == b[0] == b[1]:
                return []
            reach = self._reach(text, [a], [b])
            at, out = self._ends(reach, b)[0], []
            while at != a:
                out.append(at)
                at = reach[at][1][0]
            return [x for i, j in reversed(out) for x in self.single(text[i:j])]

        span = self.fringes(text, [enter], [leave], low, high)
        if span is None:
            return pieces(enter, leave)
        first, last = span
        return [*pieces(enter, (first, first)), *self.bare.encode(text[first:last]), *pieces((last, last), leave)]


@lru_cache(maxsize=1)
def shared(model: bytes) -> Pieces:
    """One for all tasks of a worker: each holds tens of MB, in a cycle that is only freed when Python happens to collect it."""
    return Pieces(model)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary of the best path, by a scan: products of neighbours go up a tree; on the way down each product
    that covers two chunks says which state between them the best path takes."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([product(own[k], own[k + 1]) if k + 1 < len(own) else own[k] for k in range(0, len(own), 2)])
    ends = [0, int(np.argmax(levels[-1][0][0]))]
    for own in reversed(levels[:-1]):
        below = []
        for k in range(0, len(own), 2):
            below.append(ends[k // 2])
            if k + 1 < len(own):
                below.append(int(np.argmax(own[k][ends[k // 2]] + own[k + 1][:, ends[k // 2 + 1]])))
        ends = [*below, ends[-1]]
    return ends


def encode_in_chunks(pieces: Pieces, text: str, size: int) -> list[int]:
    """One text by the same steps that ``encode`` spreads over tasks."""
    text = pieces.prefix + text
    cuts = pieces.cuts(text, size)
    states = [pieces.states(text, c) for c in cuts]
    path = best_states([pieces.matrix(text, a, b, i, j) for a, b, i, j in zip(states, states[1:], cuts, cuts[1:], strict=False)])
    taken = [s[k] for s, k in zip(states, path, strict=True)]
    return [x for a, b, i, j in zip(taken, taken[1:], cuts, cuts[1:], strict=False) for x in pieces.backtrace(text, a, b, i, j)]


def encode(docs: DataFrame, columns: list[str] | None = None, path: str | None = None, chunk: int = 16_384) -> DataFrame:
    """``columns`` of ``docs`` (all of them) and ids, the pieces of text, and round_trip: whether decoding them gives the text back.

    Null and empty texts have no pieces. Texts of over ``chunk`` characters are encoded in chunks, with the same result; a chunk's
    decoding is compared with its own part. Texts that hold the model's space mark (U+2581) decode to spaces.
    Columns of ``docs`` named ids or round_trip are replaced.
    """
    with open(path or default_model(), "rb") as f:
        model = f.read()
    modest_batches(docs.sparkSession)
    own = [c for c in (columns or docs.columns) if c not in ("ids", "round_trip")]
    source = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not Pieces(model).chunks:
        chunk = 1 << 62

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(model)
        for part in T.slices(batches, "text", 1 << 18):
            texts = part["text"].to_pylist()
            ids = pieces.encode(texts)
            same = [a == b for a, b in zip(pieces.decode(ids), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part["row"], pa.array(ids, pa.list_(pa.int32())), pa.array(same)], ["row", "ids", "round_trip"])

    kind = source.schema["row"].dataType.simpleString()
    short = source.where(F.length("text") <= chunk).mapInArrow(whole, f"row {kind}, ids array<int>, round_trip boolean")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(model)
        for part in T.slices(batches, "text", 1 << 20):
            for uid, text in zip(part["uid"].to_pylist(), part["text"].to_pylist(), strict=True):
                text = pieces.prefix + text
                cuts, far = pieces.cuts(text, chunk), 2 * pieces.longest
                rows = []
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    low, high = max(0, a - far), min(len(text), b + far)
                    rows.append({"uid": uid, "k": k, "part": text[low:high], "a": a - low, "b": b - low, "first": a == 0, "last": b == len(text)})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("part", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())]))

    def ends(pieces: Pieces, r: dict) -> tuple[list, list]:
        text = r["part"]
        return ([(r["a"], r["a"])] if r["first"] else pieces.states(text, r["a"])), ([(r["b"], r["b"])] if r["last"] else pieces.states(text, r["b"]))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(model)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                enter, leave = ends(pieces, r)
                m = pieces.matrix(r["part"], enter, leave, r["a"], r["b"])
                rows.append({"uid": r["uid"], "k": r["k"], "n": m.shape[0], "m": np.isfinite(m).tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("m", pa.binary())]))

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        own = [np.where(np.frombuffer(m, bool).reshape(n, -1), 0.0, MINUS) for n, m in zip(group["n"].to_pylist(), group["m"].to_pylist(), strict=True)]
        found = best_states(own)
        return pa.table({"uid": group["uid"], "k": group["k"], "enter": pa.array(found[:-1], pa.int32()), "leave": pa.array(found[1:], pa.int32())})

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(model)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                enter, leave = ends(pieces, r)
                came, went = enter[r["enter"]], leave[r["leave"]]
                ids = pieces.backtrace(r["part"], came, went, r["a"], r["b"])
                text = r["part"][came[1] : went[1]]
                rows.append({"uid": r["uid"], "k": r["k"], "ids": ids, "same": pieces.bare.decode(ids) == text})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("ids", pa.list_(pa.int32())), ("same", pa.bool_())]))

    giant = written(source.where(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id()))
    parts = written(giant.select("uid", "text").mapInArrow(cut, "uid long, k int, part string, a int, b int, first boolean, last boolean"))
    # Chunks are read where they were written; only their matrices move, to a number of tasks that doesn't shrink with their bytes.
    each = parts.mapInArrow(matrices, "uid long, k int, n int, m binary").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid")
    chosen = each.groupBy("uid").applyInArrow(choose, "uid long, k int, enter int, leave int")
    done = parts.join(chosen, ["uid", "k"]).mapInArrow(between, "uid long, k int, ids array<int>, same boolean")
    joined = done.groupBy("uid").agg(F.flatten(F.sort_array(F.collect_list(F.struct("k", "ids")))["ids"]).alias("ids"), F.min("same").alias("round_trip"))
    long = giant.select("uid", "row").join(joined, "uid").select("row", "ids", "round_trip")
    return short.unionByName(long).select(*[F.col(f"row.`{c}`") for c in own], "ids", "round_trip")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``tokens`` (ids, ...) and text, the text that the pieces stand for; null ids are none."""
    with open(path or default_model(), "rb") as f:
        model = f.read()
    source = tokens.select(F.struct(*[c for c in tokens.columns if c != "text"]).alias("row"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(pieces.decode(part["ids"].to_pylist()), pa.string())], ["row", "text"])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, text string").select("row.*", "text")
