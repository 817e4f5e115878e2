"""Exact token counts of every prefix of a text, for tokenizers whose words are encoded one by one.

The table of a text is a dynamic programme in two layers. At the end of a word, the count is the count at the end of the word
before plus the tokens of the word. Inside a word, it is the count at the end of the word before plus the word's own table, which
has the tokens of each of its prefixes. Each different word, and each prefix of one that is asked for, is encoded once
and kept. So the tokens of any prefix, what fits a budget and where to cut are looked up, and no text is encoded again.

Words of texts of ASCII and Latin letters are found on the bytes of a whole column and told apart by 64-bit hashes; a running sum
of their tokens is the table. The library cuts all other texts into words.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Word pattern of the tokenizer file, a fixed value, and the same for the characters below (lower case).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
#: Texts of ASCII and of Latin letters are their own composed form and have lower case letters one by one.
OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")

SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Kinds of bytes in plain texts: white space 0, letters 1 (all bytes of a Latin letter), digits 2, all else 3.
KIND = np.full(256, 3, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KIND[0x30:0x3A] = 2
APOSTROPHE = 0x27


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _trimmed(text: str, end: int) -> int:
    while end and text[end - 1] in SPACE:
        end -= 1
    return end


def plain_words(text: T.Bytes) -> T.Words:
    """Words of plain texts in lower case, by PATTERN."""
    data = text.used
    n = len(data)
    kind = KIND[data]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    fresh[text.offsets] = True
    starts = fresh[:n] & (kind != 0)
    # An apostrophe that begins a word takes in s, t, m, d, re, ve or ll behind it.
    mark = np.flatnonzero(starts & (data == APOSTROPHE))
    if len(mark):
        room = text.offsets[np.searchsorted(text.offsets, mark, "right")] - mark
        one, two = text.data[mark + 1], text.data[mark + 2]
        short = (room >= 2) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (room >= 3) & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        for taken, size in ((short, 2), (long, 3)):
            at = mark[taken]
            fresh[at + 1] = starts[at + 1] = False
            after = at + size
            fresh[after] = True
            after = after[after < n]
            starts[after] = kind[after] != 0
    begin = np.flatnonzero(starts)
    end = np.flatnonzero((kind != 0) & fresh[1:]) + 1
    return T.Words(begin, end, np.searchsorted(begin, text.offsets))


class PrefixTokenCounter:
    """``model``: the text of a ``tokenizers`` file. Special strings inside a text count as the library does by default."""

    def __init__(self, model: str, largest_cache: int = 1_000_000):
        from tokenizers import Tokenizer

        # A task has one core; threads of the library would take those of others.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_str(model)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        spec = json.loads(model)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        #: Whether words of plain texts are those of PLAIN_WORD; else the library cuts every text.
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": PATTERN} and first.get("invert") is True and first.get("behavior") == "Removed"
        suffix = spec.get("model", {}).get("end_of_word_suffix")
        vocabulary = self.library.get_vocab() if self.plain and suffix else {}
        #: Whether a token ends a word, by its number.
        self.final = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.final[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, int] = {}
        self.hashed: dict[int, int] = {}
        self.inside: dict[str, np.ndarray] = {}
        self.largest_cache = largest_cache

    def _encode(self, text: str):
        return self.library.encode(text, add_special_tokens=False)

    def _sizes(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_sizes(self, words: list[str], together: int = 500) -> list[int]:
        """Tokens of plain words, many encoded at a time: a space keeps them apart, and their last tokens tell where each ends."""
        if not len(self.final):
            return self._sizes(words)
        lines = [" ".join(words[k : k + together]) for k in range(0, len(words), together)]
        ends = [np.flatnonzero(self.final[x.ids]) for x in self.library.encode_batch_fast(lines, add_special_tokens=False)]
        return np.concatenate([np.diff(at, prepend=-1) for at in ends]).tolist()

    def _is_plain(self, text: str) -> bool:
        return self.plain and not OTHER.search(text) and not any(s in text for s in self.special)

    def _tokens(self, words: list[str]) -> list[int]:
        found = list(map(self.known.get, words))
        if None in found:
            missing = list({w for w, n in zip(words, found, strict=True) if n is None})
            if len(self.known) + len(missing) > self.largest_cache:
                self.known.clear()
            own = dict(zip(missing, self._sizes(missing), strict=True))
            self.known.update(own)
            found = [own[w] if n is None else n for w, n in zip(words, found, strict=True)]
        return found

    def word_table(self, word: str) -> np.ndarray:
        """Tokens of each prefix of a word, the empty one first."""
        if word not in self.inside:
            if len(self.inside) >= self.largest_cache:
                self.inside.clear()
            self.inside[word] = np.array([0, *self._sizes([word[:k] for k in range(1, len(word) + 1)])], np.int64)
        return self.inside[word]

    def table(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(ends, counts): the code points before the end of each word, and the tokens of that prefix."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self._is_plain(text):
            found = [(m.end(), m.group()) for m in PLAIN_WORD.finditer(text.lower())]
            return np.array([e for e, _ in found], np.int64), np.cumsum(self._tokens([w for _, w in found])).astype(np.int64)
        encoded = self._encode(text)
        if not encoded.ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Words: tokens with one word number; a special string is one of its own and has none.
        words, n = encoded.word_ids, len(encoded.ids)
        last = [i for i in range(n) if i + 1 == n or words[i] is None or words[i] != words[i + 1]]
        # A word reaches to the white space before the next one: offsets may leave out characters that were composed.
        stops = [encoded.offsets[i + 1][0] if i + 1 < n else len(text) for i in last]
        ends = np.array([max(encoded.offsets[i][1], _trimmed(text, e)) for i, e in zip(last, stops, strict=True)], np.int64)
        # Words made of one character end together; the last of them has the count.
        final = np.append(ends[1:] != ends[:-1], True)
        return ends[final], np.array(last, np.int64)[final] + 1

    def _part(self, text: str, table: tuple[np.ndarray, np.ndarray], k: int) -> tuple[int, int, np.ndarray]:
        """Word ``k`` of a table: tokens and code points before it, and the word's own table (white space before it included)."""
        ends, counts = table
        before, start = (int(counts[k - 1]), int(ends[k - 1])) if k else (0, 0)
        return before, start, self.word_table(text[start : int(ends[k]) if k < len(ends) else len(text)])

    def count_at(self, text: str, table: tuple[np.ndarray, np.ndarray], end: int) -> int:
        """Tokens of ``text[:end]``."""
        k = int(np.searchsorted(table[0], end, "right"))
        before, start, inside = self._part(text, table, k)
        return before + int(inside[end - start])

    def longest_prefix(self, text: str, table: tuple[np.ndarray, np.ndarray], budget: int) -> int:
        """Code points of the longest prefix that has at most ``budget`` tokens."""
        k = int(np.searchsorted(table[1], budget, "right"))
        if k == len(table[1]):
            return len(text)
        before, start, inside = self._part(text, table, k)
        return start + int(np.flatnonzero(before + inside <= budget)[-1])

    def _column_tokens(self, text: T.Bytes, found: T.Words) -> np.ndarray:
        """Tokens of each word of a column of plain texts."""
        codes, different = pd.factorize(T.word_hashes(text, found))
        keys = different.tolist()
        sizes = list(map(self.hashed.get, keys))
        missing = [k for k, n in enumerate(sizes) if n is None]
        if missing:
            if len(self.hashed) + len(missing) > self.largest_cache:
                self.hashed.clear()
            where = np.empty(len(keys), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            data = text.data.tobytes()
            words = [data[a:b].decode() for a, b in zip(found.starts[where[missing]].tolist(), found.ends[where[missing]].tolist(), strict=True)]
            for k, n in zip(missing, self._word_sizes(words), strict=True):
                sizes[k] = self.hashed[keys[k]] = n
        return np.array(sizes, np.int64)[codes] if keys else np.zeros(0, np.int64)

    def column(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its tokens and the code points of its longest prefix of at most ``budget`` tokens."""
        raw = T.column_bytes(texts)
        plain = T.plain_rows(raw) if self.plain else np.zeros(len(texts), bool)
        filled = pc.fill_null(texts, "")
        for s in self.special:
            plain &= ~pc.match_substring(filled, s).to_numpy(zero_copy_only=False).astype(bool)
        text = T.lowered(raw)
        if not plain.all():
            # The other texts are taken out, as none of their bytes are words here.
            keep = np.repeat(plain, np.diff(raw.offsets))
            text = T.Bytes(np.append(np.where(keep, text.used, 0x20), np.zeros(8, np.uint8)).astype(np.uint8), text.offsets)
        found = plain_words(text)
        counts = np.concatenate([[0], np.cumsum(self._column_tokens(text, found))])
        total = counts[found.rows[1:]] - counts[found.rows[:-1]]
        points = np.concatenate([[0], np.cumsum((raw.used & 0xC0) != 0x80)])
        cut = points[raw.offsets[1:]] - points[raw.offsets[:-1]]
        for row in np.flatnonzero(plain & (total > budget)).tolist():
            first = counts[found.rows[row]]
            k = int(np.searchsorted(counts, first + budget, "right")) - 1
            inside = self.word_table(text.data[found.starts[k] : found.ends[k]].tobytes().decode())
            cut[row] = points[found.starts[k]] - points[raw.offsets[row]] + np.flatnonzero(counts[k] - first + inside <= budget)[-1]
        for row in np.flatnonzero(~plain).tolist():
            own = texts[row].as_py() or ""
            table = self.table(own)
            total[row] = table[1][-1] if len(table[1]) else 0
            cut[row] = self.longest_prefix(own, table, budget)
        return total, cut


def _model(path: str | None) -> str:
    with open(path or default_model(), encoding="utf-8") as f:
        return f.read()


def token_counts(docs: DataFrame, path: str | None = None, budget: int = 2048) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n_bytes, n_tokens, n_chars_within): the last entry of each text's table, and the
    code points of the longest prefix that has at most ``budget`` tokens.

    Null texts are empty: no bytes, no tokens. Every row is counted on its own, whatever its doc_id: null and repeated ones come
    back as they are. Texts of any length are counted whole; a task holds one text, or about 4 MB of them, and its words' positions.
    """
    model = _model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixTokenCounter(model)
        for part in T.slices(batches, "text"):
            total, cut = counter.column(part["text"], budget)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], pa.array(total), pa.array(cut.astype(np.int64))], ["doc_id", "n_bytes", "n_tokens", "n_chars_within"])

    text = F.col("text").cast("string")
    sized = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return sized.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, n_chars_within long")


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, ends, counts): each text's whole table."""
    return _tables(docs, _model(path), lambda counter, text: counter.table(text))


def _tables(docs: DataFrame, model: str, answer: Callable[[PrefixTokenCounter, str | None], tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixTokenCounter(model)
        for part in T.slices(batches, "text"):
            own = [answer(counter, x.as_py()) for x in part["text"]]
            lists = [pa.array([x[k] for x in own], pa.list_(pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *lists], ["doc_id", "ends", "counts"])

    shown = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return shown.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ends array<long>, counts array<long>")
