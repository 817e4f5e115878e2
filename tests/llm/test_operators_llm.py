"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspan.llm import decontaminate, licenses, line_dedup, minhash, quality, sentencepieces, simhash, substrings, token_counts, warc
from panelspan.llm import text as T
from panelspan.llm.components import connected_components
from panelspan.llm.fm_index import FMIndex

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def corpus(n=60, seed=1):
    """Documents with copies, near copies, shared passages, empty, null and long texts, a missing and a repeated doc_id."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 11))) for _ in range(300)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage = say(70)
    texts = [say(rng.randint(1, 200)) for _ in range(n)]
    for k in range(0, n, 6):
        texts[k] = say(20) + "\n" + passage + "\n" + say(rng.randint(0, 9))
    texts[7] = texts[5]
    texts[11] = texts[5].replace(" ", " changed ", 1)
    texts += ["", None, "  \n\t ", "word", "x " * 500, say(3000), texts[3]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, passage), (3, texts[3])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Names that operators add or use inside, beside the columns they read.
    return spark.createDataFrame([(i, t, "en", "s", 1, "h", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h string, n_words int").repartition(5)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_hashes_and_runs():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 6, 9)
    starts = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(9), counts)
    for length in (1, 2, 3, 5, 10):
        want = [bool(row[k] == row[k + length - 1]) for k in range(len(row) - length + 1)]
        assert T.whole_runs(starts, length).tolist() == want
    h = rng.integers(0, 2**63, 40).astype(np.uint64)
    for length in (2, 9, 16):
        assert T.run_hashes(np.concatenate([h, h[:20]]), length)[40] == T.run_hashes(h, length)[0]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = ["a" * 1500, "b" * 1500, "a" * 1500, None, "short", "short", "", "\x1f\u008b é" * 400, "c" * 1000, "c" * 1000, "d" * 999, "d" * 999]
    rng = random.Random(2)
    html.append("".join(rng.choices("abcdefgh", k=17 << 20)))
    pages = spark.createDataFrame([(k, f"http://x/{k} \r\ny", t, "extra") for k, t in enumerate(html)] + [(None, None, "a" * 1500, "e")], "page_id long, url string, html string, digest string")
    path = "file://" + str(tmp_path / "w")
    warc.write(warc.with_revisits(pages), path)
    for split in (1 << 17, 16 << 20):
        rows = warc.read(spark, path, split=split).withColumn("page_id", warc.page_id_of(F.col("record_id"))).collect()
        got = {r.page_id: r for r in rows}
        assert len(rows) == len(html) + 1 and set(got) == {None, *range(len(html))}
        for k, t in enumerate(html):
            data = (t or "").encode()
            twins = [j for j, u in enumerate(html) if len(data) >= 1000 and (u or "") == (t or "")]
            r = got[k]
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            if twins and max(twins) != k:
                assert (r.record_type, r.refers_to_id, r.payload) == ("revisit", f"urn:page:{max(twins)}", None)
            else:
                assert (r.record_type, r.refers_to_id, bytes(r.payload)) == ("response", None, data)


def test_warc_candidates_that_are_no_records():
    import gzip
    import io

    record = warc._member(warc.record("response", "urn:page:1", None, "d", b"x", b"0" * 20), 1)
    data = b"noise" + warc.MAGIC + b"more" + gzip.compress(b"not a record") + record + warc.MAGIC + record
    for size in (1, 7, 64, 1000):
        found = [m for a in range(0, len(data), size) for m in warc.members(io.BytesIO(data), a, a + size)]
        assert len(found) == 2 and all(warc.parse(m)["record_id"] == "urn:page:1" for m in found)


def brute_repeats(rows, window):
    first, out = {}, []
    words = [(i, SPACE.findall((t or "").encode())) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("largest", [1, 2000])
def test_substring_dedup(docs, rows, largest):
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substrings.deduplicate(docs, largest=largest).collect()]
    assert sorted(got, key=repr) == brute_repeats(rows, 50) and any(g[2] for g in got)


def test_substring_dedup_of_nothing(nothing):
    assert substrings.deduplicate(nothing).count() == 0


def test_license_scan(docs, nothing, spark):
    texts = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "x\nlicensed UNDER cc by-nc 4.0"), (2, ""), (3, None), (4, "some other words here"), (5, "Released, under: the MIT License - today")]
    got = sorted(((r.doc_id, r.license, r.line) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, "MIT", 1), (1, "MIT", 1), (None, "CC-BY-NC-4.0", 2), (2, None, None), (3, None, None), (4, None, None), (5, "MIT", 1)], key=repr)
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0

    def dice(a, b):
        grams = [set(zip(w, w[1:])) for w in (re.findall(r"[^\W_]+", x.lower()) for x in (a, b))]
        return 2 * len(grams[0] & grams[1]) / max(1, len(grams[0]) + len(grams[1]))

    row = licenses.scan(spark.createDataFrame(texts[-1:], "doc_id long, text string")).first()
    assert abs(row.dice - max(dice(texts[-1][1], t) for _, t in licenses.TEMPLATES)) < 1e-9


def test_quality_classifier(spark, nothing):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(80)) + "."
    bad = lambda: "BUY!!! " * 60
    texts = [(k, good() if k % 3 else bad()) for k in range(600)] + [(900, ""), (901, None), (None, good()), (5, good())]
    labels = [(k, int(k % 3 > 0), 0) for k in range(600)] + [(None, 0, 0), (7, None, 0), (5000, 1, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert len(got) == len(texts) and got.score.between(0, 1).all() and got.predicted.equals((got.score >= 0.3).astype("int32"))
    held = got[got.held_out & (got.doc_id < 600)]
    assert len(held) > 60 and (held.predicted == (held.doc_id % 3 > 0)).mean() > 0.97
    none = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).toPandas()
    assert (none.score == 0.5).all() and quality.classify(nothing, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_pool_adjacent():
    assert quality.pool_adjacent(np.array([0.0, 1, 0, 1]), np.array([1.0, 1, 1, 2])).tolist() == [0, 0.5, 0.5, 1]


def test_token_counts(docs, rows, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_model())
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), count(t)) for i, t in rows), key=repr)
    assert token_counts.token_counts(nothing).count() == 0 and token_counts.prefix_tables(docs).count() == len(rows)
    with open(token_counts.default_model(), encoding="utf-8") as f:
        counter = token_counts.PrefixTokenCounter(f.read(), largest_cache=3)
    for text in ["it's 12 o'clock, WE'LL see!!", "İstanbul ΣΑΣ é ½ x", "a<|endoftext|>b", " \n", "ｆｕｌｌ ｗｉｄｔｈ 漢字"]:
        table = counter.table(text)
        assert (int(table[1][-1]) if len(table[1]) else 0) == count(text)
        for end in range(len(text) + 1) if "<|" not in text else ():
            assert counter.count_at(text, table, end) == count(text[:end]), (text, end)
        for budget in range(count(text) + 1):
            assert counter.longest_prefix(text, table, budget) == max(k for k in range(len(text) + 1) if count(text[:k]) <= budget) or "<|" in text
        if "<|" not in text:
            # Every prefix is answered from what is stored by now.
            encode, batch, counter.largest_cache = counter._encode, counter._sizes, 1000
            [counter.count_at(text, table, end) for end in range(len(text) + 1)]
            counter._encode = counter._sizes = None
            assert [counter.count_at(text, table, end) for end in range(len(text) + 1)] == [count(text[:end]) for end in range(len(text) + 1)]
            counter._encode, counter._sizes, counter.largest_cache = encode, batch, 3


def test_token_budgets_of_columns():
    """Random texts of the characters that words are cut at, by the library and every prefix."""
    import pyarrow as pa

    rng = random.Random(1)
    signs = ["'", "s", "t", "re", "ll", "ve", "m", "d", " ", "a", "é", "É", "ß", "×", "0", "9", ",", "\n", "\x85", "…", "中", "<|startoftext|>", "\x00", "\x1c", "À", "㎏", "e\u0301"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(600)] + ["", None, "word " * 40_000]
    with open(token_counts.default_model(), encoding="utf-8") as f:
        counter = token_counts.PrefixTokenCounter(f.read(), largest_cache=50)
    count = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    for budget in (0, 3, 2048):
        total, cut = counter.column(pa.array(texts), budget)
        for text, n, k in zip(texts, total.tolist(), cut.tolist()):
            text = text or ""
            assert n == count(text)
            assert k == (max(j for j in range(len(text) + 1) if count(text[:j]) <= budget) if len(text) < 1000 else 5 * budget)


def fingerprint(text):
    w = SPACE.findall(lower(text))
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, nothing):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, fingerprint(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.fp % 2**64) for r in got), key=repr) == sorted(prints, key=repr)
    parent = {p: p for _, p in prints}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    assert {(r.doc_id, r.component_id) for r in got} == {(i, least.get(find(p))) for i, p in prints}
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("largest", [20_000, 3])
def test_simhash_links_connect_what_all_pairs_connect(spark, largest):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    values = {int(b) for b in base}
    for b in base[:2]:
        for _ in range(80):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            values.add(int(b) ^ sum(1 << int(f) for f in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), largest=largest).collect()
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 3 for r in links)

    def groups(pairs):
        parent = {v: v for v in signed}
        find = lambda x: x if parent[x] == x else find(parent[x])
        for a, b in pairs:
            parent[find(a)] = find(b)
        return {frozenset(v for v in signed if find(v) == r) for r in {find(v) for v in signed}}

    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3]
    assert groups([(r.u, r.v) for r in links]) == groups(every)


def test_fm_index():
    rng = np.random.default_rng(8)
    for _ in range(20):
        text = rng.integers(1, 5, rng.integers(1, 120))
        index = FMIndex(text, sample=4)
        for length in (1, 2, 5):
            patterns = rng.integers(2, 6, (30, length))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [k for k in range(len(text) - length + 1) if (text[k : k + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark, docs, rows, nothing):
    words = rows[0][1].split()
    items = [(1, " ".join(words[22:40])), (10, " ".join(words[30:45]).upper()), (2, rows[2][1].split()[0]), (3, None), (4, ""), (None, "x"), (1, "x x x"), (5, "never seen before at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - 9)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in rows:
        w, found = ALNUM.findall(lower(t)), set()
        hit = [False] * len(w)
        for window, holders in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    found |= holders
                    hit[k : k + len(window)] = [True] * len(window)
        want.append((i, len(w), sum(hit), sorted(found), [x for x, g in zip(w, hit) if not g]))
    for how in ({}, {"block_bytes": 40}, {"shard_words": 100}):
        got = decontaminate.scan(docs, bench, cut=True, **how)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "n_words", "n_hit", "spans", "items"]
        found = [(r.doc_id, r.n_words, r.n_hit, r["items"], ALNUM.findall(lower(r.text))) for r in got.collect()]
        assert sorted(found, key=repr) == sorted(want, key=repr)
    assert decontaminate.scan(nothing, bench).count() == 0
    assert decontaminate.scan(docs, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0


def test_sentencepiece(spark, docs, rows, nothing):
    with open(sentencepieces.default_model(), "rb") as f:
        pieces = sentencepieces.Pieces(f.read())
    rng = random.Random(9)
    for letters in ("ab", "aeinst", "theran o", "aä漢😀x", "A="):
        text = "".join(rng.choices(letters, k=rng.randint(1, 400)))
        for size in (5, 20, 64):
            assert sentencepieces.encode_in_chunks(pieces, text, size) == pieces.library.encode(text)
    for chunk in (100, 1 << 20):
        got = sentencepieces.encode(docs, chunk=chunk)
        assert all(r.round_trip and r.ids == pieces.library.encode(r.text or "") for r in got.collect()) and got.count() == len(rows)
        assert sorted((t or "") for _, t in rows) == sorted(r.text for r in sentencepieces.decode(got.drop("text")).collect())
    solid = spark.createDataFrame([(1, "".join(rng.choices("aeinst", k=3000)))], "doc_id long, text string")
    row = sentencepieces.encode(solid, chunk=200).first()
    assert row.ids == pieces.library.encode(row.text)
    assert sentencepieces.encode(nothing).count() == 0


def test_fingerprints(docs, rows, nothing, spark):
    got = minhash.compare_with_next(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in order]
    following = texts[1:] + texts[:1]
    changed = [minhash.edited(a, b) for a, b in zip(texts, following)]
    want = [(i, len(t), hashlib.sha256(c.encode()).hexdigest()) for (i, _), t, c in zip(order, texts, changed)]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)

    def shingles(t):
        w = SPACE.findall(lower(t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def alike(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    likely = {(r.doc_id, r.edited_sha256): (r.near_edited, r.near_next) for r in got}
    for (i, _, sha), t, c, n in zip(want, texts, changed, following):
        assert np.allclose(likely[i, sha], (alike(t, c), alike(t, n)), atol=0.13)
    by_text = {}
    sha = {(i, s): t for (i, _, s), t in zip(want, texts)}
    for r in got:
        by_text.setdefault(sha[r.doc_id, r.edited_sha256], set()).add(bytes(r.print))
    assert all(len(p) == 1 for p in by_text.values())
    assert minhash.compare_with_next(nothing).count() == 0
    one = minhash.compare_with_next(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


def plain_line_dedup(rows):
    """Groups of places of lines, by edit similarity over all pairs: by words, or by characters if both have fewer than eight words."""
    norm = lambda line: re.sub(r"[\W_]+", " ", line.lower()).strip()
    seen = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if norm(line):
                seen.setdefault(norm(line), []).append((i if i is not None else 1 << 62, t, k))
    parent = {line: line for line in seen}
    find = lambda x: x if parent[x] == x else find(parent[x])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def alike(a, b):
        most = int(0.2 * max(len(a), len(b)) + 1e-9)
        return abs(len(a) - len(b)) <= most and distance(a, b) <= most

    lines = sorted(seen)
    for a in lines:
        for b in lines:
            if a < b and find(a) != find(b):
                x, y = a.split(), b.split()
                if alike(x, y) or (max(len(x), len(y)) < 8 and alike(a, b)):
                    parent[find(a)] = find(b)
    groups = {}
    for line, places in seen.items():
        groups.setdefault(find(line), []).extend(places)
    return groups


def test_line_dedup(spark, nothing):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    say = lambda k: rng.choices(words, k=k)
    base = [say(30) for _ in range(4)]
    rows = []
    for k in range(40):
        own = [" ".join(say(rng.randint(3, 25))) for _ in range(3)]
        for b in base:
            changed = list(b)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(30)] = rng.choice(words)
            own.append(" ".join(changed).upper() + "!")
        rows.append((k, "\n".join([*own, "too short", "", "---"])))
    rows += [(50, ""), (51, None), (52, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(i, t, 7, "x", 3) for i, t in rows], "doc_id long, text string, h int, pos string, n_lines int")
    groups = plain_line_dedup(rows)
    gone = {}
    for places in groups.values():
        # Of one document's rows with one text, all lines share a place; ties between texts go by a hash, which these rows don't need.
        first = min(places, key=lambda p: (p[0], p[2]))
        for p in places:
            if p != first:
                gone.setdefault(p[0], set()).add(p[2])
    got = {(r.doc_id if r.doc_id is not None else 1 << 62): r for r in line_dedup.deduplicate(docs).collect()}
    assert len(got) == len(rows) and list(next(iter(got.values())).asDict()) == ["doc_id", "text", "h", "pos", "n_lines", "n_removed"]
    for i, t in rows:
        r = got[i if i is not None else 1 << 62]
        if t is None:
            assert r.text is None and r.n_lines == 0
            continue
        out = [x for k, x in enumerate(t.split("\n")) if k not in gone.get(i if i is not None else 1 << 62, ())]
        assert (r.text, r.n_lines, r.n_removed) == ("\n".join(out), len(t.split("\n")), len(t.split("\n")) - len(out))
    assert line_dedup.deduplicate(nothing).count() == 0


def test_sentencepiece_cuts_have_states():
    """On giant texts of the tables most cuts fall inside a piece, and paths through their states give the library's pieces."""
    import pyarrow.parquet as pq

    with open(sentencepieces.default_model(), "rb") as f:
        pieces = sentencepieces.Pieces(f.read())
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t and len(t) > 16_384]
    states = [len(pieces.states(" " + t, k)) for t in texts for k in pieces.cuts(" " + t, 16_384)[1:-1]]
    assert len(states) >= 5 and sum(n > 1 for n in states) * 2 > len(states)
    for t in texts:
        assert sentencepieces.encode_in_chunks(pieces, t, 16_384) == pieces.library.encode(t)


def test_sentencepiece_edges(spark):
    rows = [(1, "a▁b", None), (2, "", [5]), (None, None, None), (2, "", [5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = sentencepieces.encode(docs)
    assert got.columns == ["doc_id", "text", "ids", "round_trip"]
    assert sorted((str(r.doc_id), len(r.ids) > 0, r.round_trip) for r in got.collect()) == [("1", True, False), ("2", False, True), ("2", False, True), ("None", False, True)]
    back = sentencepieces.decode(docs.select("doc_id", "ids"))
    assert sorted(len(r.text) > 0 for r in back.collect()) == [False, False, True, True] and sentencepieces.decode(docs.where("false")).count() == 0
    marked = {r.doc_id: r.text for r in sentencepieces.decode(got.drop("text")).collect()}
    assert marked[1] == "a b"


def test_best_states_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = [1, *rng.integers(1, 4, rng.integers(0, 6)), 1]
        matrices = [np.where(rng.random((a, b)) < 0.8, 0.0, -np.inf) for a, b in zip(sizes, sizes[1:])]
        total = matrices[0]
        for m in matrices[1:]:
            total = sentencepieces.product(total, m)
        path = sentencepieces.best_states(matrices)
        assert len(path) == len(sizes)
        if np.isfinite(total[0, 0]):
            assert all(m[a, b] == 0 for m, a, b in zip(matrices, path, path[1:]))


def test_suffix_tree_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(6, 30, 4)
        words = rng.integers(0, 3, sizes.sum()).astype(np.uint64)
        stops = np.cumsum(sizes)
        begins = np.concatenate([np.arange(b - n, b - 4) for n, b in zip(sizes, stops)])
        ends = np.concatenate([np.full(n - 4, b) for n, b in zip(sizes, stops)])
        order, shared = substrings.suffix_tree(words, begins, ends)
        assert sorted(order.tolist()) == list(range(len(begins)))
        text = lambda k: words[begins[k] : ends[k]].tolist()
        common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert [common(text(a), text(b)) for a, b in zip(order, order[1:])] == shared[1:].tolist()
        starts, depths = substrings.deep_nodes(shared, 5)
        groups = {tuple(sorted(order[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(order)])}
        want = {}
        for k in range(len(begins)):
            want.setdefault(tuple(text(k)[:5]), []).append(k)
        assert groups == {tuple(sorted(v)) for v in want.values()} and all(d == 0 or d >= 5 for d in depths)


def test_warc_damage_is_an_error(spark, tmp_path):
    import glob

    pages = spark.createDataFrame([(k, "u", ("page %d " % k) * 400) for k in range(3)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write(warc.with_revisits(pages).coalesce(1), "file://" + path)
    name = max(glob.glob(path + "/part*"), key=lambda p: len(open(p, "rb").read()))
    data = open(name, "rb").read()
    begins = [k for k in range(len(data)) if data[k : k + 3] == warc.MAGIC]
    assert len(begins) >= 3
    damaged = [data[:-9], data[: begins[2] + 5], data[: begins[1]] + b"junk" + data[begins[1] :]]
    for at in (begins[0] + 1, begins[1] + 12, begins[1] + 60, len(data) - 6):
        damaged.append(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
    for n, bad in enumerate(damaged):
        other = tmp_path / f"bad{n}"
        other.mkdir()
        (other / "x.warc.gz").write_bytes(bad)
        for split in (64, 1 << 20):
            with pytest.raises(Exception, match="bad"):
                warc.read(spark, f"file://{other}", split=split).collect()
    none = "file://" + str(tmp_path / "none")
    warc.write(warc.with_revisits(pages.where("false")), none)
    assert warc.read(spark, none).count() == 0


def test_common_windows_of_many_items(spark):
    items = spark.createDataFrame([(k, "yes") for k in range(300)] + [(300, "yes we can " * 6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Yes " * 5000), (2, "no"), (3, "YES no yes")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(docs, items).collect()}
    assert (got[1].n_hit, len(got[1].items), got[2].n_hit, got[3].n_hit, len(got[3].items)) == (5000, 300, 0, 2, 300)


def test_quality_against_plain_ridge_and_isotonic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    every = quality.features(docs).toPandas()
    known = quality.labelled(labels, 200_000).toPandas().merge(every, on="doc_id")
    got = quality.classify(docs, labels).toPandas().set_index("doc_id").score
    x, y = np.stack(known.x), known.y.to_numpy()
    import zlib

    assert not any(zlib.crc32(str(d).encode()) % 5 == 0 for d in known.doc_id)
    fourth = np.array([r.c for r in spark.createDataFrame([(int(d),) for d in known.doc_id], "doc_id long").select((F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0).alias("c")).collect()])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    rng = np.random.default_rng(7)
    directions, phases = rng.normal(size=(x.shape[1], 256)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, 256)

    model = quality.Model(mean, scale, directions, phases, np.zeros(257), np.array([0.0]), np.array([0.5]))
    z = model.lift(x[~fourth])
    # The plain form of the same ridge: one least squares problem with the penalty as rows of its own.
    penalty = np.sqrt(1e-3 * max((z[:, 0] ** 2).sum(), 1) * np.array([1e-9, *np.ones(256)]))
    model.weights = np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.concatenate([y[~fourth], np.zeros(257)]), rcond=None)[0]
    raw = np.round(np.clip(model.raw(x[fourth]), -1, 2) * 1000)
    bins = np.unique(raw)
    means, n = np.array([y[fourth][raw == b].mean() for b in bins]), np.array([(raw == b).sum() for b in bins])
    level = [max(min(np.average(means[a:b], weights=n[a:b]) for b in range(i + 1, len(bins) + 1)) for a in range(i + 1)) for i in range(len(bins))]
    model.knots, model.levels = bins / 1000, np.array(level)
    plain = model.score(np.stack(every.x))
    assert np.quantile(np.abs(plain - got.loc[every.doc_id].to_numpy()), 0.99) < 0.02
    held = labels.toPandas().dropna(subset=["quality", "doc_id"])
    held = held[[zlib.crc32(str(d).encode()) % 5 == 0 for d in held.doc_id]]
    assert ((got.loc[held.doc_id].to_numpy() >= 0.3) == (held.quality == 1)).mean() > 0.97


def test_licenses_in_paragraphs_and_sentences(spark):
    import textwrap

    body = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 600)
    start = body.index("Permission")
    wrapped = "MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + "\n".join(textwrap.wrap(body[start : body.index("The above")], 70)) + "\n\n" + "\n".join(textwrap.wrap(body[body.index("The above") :], 70))
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and len(t) > 100)
    header = "#!/bin/sh\n# A tool of ours\n#\n" + "\n".join("#  " + x for x in textwrap.wrap(gpl, 60)) + "\n#\nset -e\n" + "run --this and --that with other words\n" * 30
    inside = "We wrote this tool in 2021. Released under the MIT License. Please send patches by mail."
    bsd3 = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and len(t) > 600)
    long = "some words of a very long text go on and on\n" * 20_000 + "\nLicensed under CC BY 4.0.\n"
    rows = [(1, wrapped), (2, header), (3, inside), (4, "\n".join(textwrap.wrap(bsd3, 80))), (5, long), (6, "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0."), (7, "...\n\n"), (8, "a " * 100_000)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, place int, unit string")).collect()}
    assert [got[k].license for k in range(1, 9)] == ["MIT", "GPL-3.0", "MIT", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-4.0", None, None]
    assert [got[k].unit for k in range(1, 7)] == ["paragraph", "paragraph", "sentence", "text", "line", "line"] and got[6].line == 1 and got[3].line is None and got[3].place == 2
