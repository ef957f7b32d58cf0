"""The training-data operators against brute force on small rows: nulls, empty texts, ties, repeated rows, odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetroll.llm import chat, common, components, html_text, languages, mixing, near_dup, packing, quality, range_coder, repeats, token_files
from fleetroll.llm import tokens, topk
from fleetroll.llm.queries import CONFLICT, QUERIES, SQL
from fleetroll.llm.tokens import Encoder
from pyspark.sql import functions as F
from tests.oracle import connect, difference

SMALL = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, size int, uid string, label string, hash int, key string"


def documents(spark, tmp_path, rows):
    """A table with the given (doc_id, text, source) and columns whose names the operators use inside."""
    full = [(d, t, "en", s, 1, "u", "l", 2, "k") for d, t, s in rows]
    path = str(tmp_path / "documents")
    spark.createDataFrame(full, DOCS).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(5)]
    rows = []
    for k in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        text = rng.choice([" ".join(own), " ".join(own), None, "", " ", "A b", "a B", "é" * 300, "ab" * 250])
        rows.append((k, text, rng.choice(["a", "b", None])))
    return [*rows, rows[0], (None, "x y z w v", None), (None, None, "a")]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 2047, 2048, 2049, 9000])
@pytest.mark.parametrize("kinds", [1, 3, 60_000, 2**32 - 1])
def test_range_coder_round_trip(n, kinds):
    ids = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint32)
    assert np.array_equal(range_coder.decode(range_coder.encode(ids)), ids)


def test_range_coder_predicts_beyond_frequencies():
    """Ids that follow from the ids before them take well under the bytes that their frequencies alone would need."""
    rng = np.random.default_rng(3)
    after = rng.permutation(300)  # fewer than slots
    ids = [0]
    for stray, other in zip(rng.random(60_000) < 0.3, rng.integers(0, 300, 60_000)):
        ids.append(int(other) if stray else int(after[ids[-1]]))
    ids = np.array(ids, np.uint32)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    alone = -(share * np.log2(share)).sum() / 8 * len(ids)
    data = range_coder.encode(ids)
    assert np.array_equal(range_coder.decode(data), ids)
    assert len(data) < 0.8 * alone


def test_range_coder_repeats_and_damage():
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(5000) < 0.02, rng.integers(0, 50_000, 5000), np.arange(5000) % 7).astype(np.uint32)
    data = range_coder.encode(ids)
    assert np.array_equal(range_coder.decode(data), ids)
    damaged = bytearray(data)
    _, blocks, _, many = struct.unpack_from("<IIBI", data, 4)
    damaged[4 + 13 + 8 * many + 8 * blocks] ^= 255  # the first block's first byte
    with pytest.raises(ValueError):
        range_coder.decode(bytes(damaged))


def test_cached_words_give_the_tokenizer_s_ids():
    enc = Encoder(WORD_BPE)
    for text in ("", "a", "Hello, world x\x1cy don't 12345 ẛ̣ İ ΑΣ <|endoftext|>x É", "ok.. ŒUVRE, <|x", "日本語。 ½ ²", "a b"):
        assert enc.encode([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_character_gives_the_tokenizer_s_ids():
    texts = [f"a{chr(c)}b {chr(c)}." for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    enc = Encoder(WORD_BPE)
    want = [e.ids for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    ids, sizes = enc.encode(texts)
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [k for x in want for k in x]


def test_words_are_encoded_once_for_many_texts(monkeypatch):
    """No Python call looks up a word, and one that comes again in the same texts does not go to the tokenizer again."""
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmno" for c in "pqrstuvw"]
    texts = [" ".join(random.Random(k).choices([*words, *(w + "," for w in words)], k=300)) for k in range(1200)]
    enc = Encoder(WORD_BPE)
    want = [k for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for k in e.ids]
    given = []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, some, **options):
            given.extend(w for text in some for w in text.split())
            return self.tokenizer.encode_batch_fast(some, **options)

    for name in ("tokenizer", "words", "letters"):
        monkeypatch.setattr(enc, name, Counting(getattr(enc, name)))
    for most in (len(words) + 6, 20):  # then the words are kept
        given.clear()
        assert enc.encode(texts)[0].tolist() == want
        assert len(given) <= most


def test_few_kept_words_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 5)
    enc = Encoder(WORD_BPE)
    for k in range(6):
        texts = [f"a{k} b{k % 2}, c c c, über. über. über. {k}", "", None, " c\x1cc ", "c. c. c. b0, b0, b0, b1,"]
        want = [enc.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
        ids, sizes = enc.encode(texts)
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert len(enc.kept) <= 5


def test_letters_are_encoded_once_whatever_signs_follow(monkeypatch):
    """Letters go to the tokenizer without the signs after them, and those that came twice are kept; ids are the tokenizer's."""
    letters = [f"{a}{b}ö" if b in "ij" else f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    signs = ["", ",", "***", "!?", "'", "')", "...", "]", "#" * 8, '".']
    texts = [" ".join(w + x for w in letters) for x in signs]
    long = "z" * 40
    odd = ["#" * 40 + " ab" + "#" * 40, "ab's ab'. 's 'so ''so ab1*** 12*** é*** ***", f"{long} {long}*** {long}", None, ""]
    enc = Encoder(WORD_BPE)
    want = [enc.tokenizer.encode(x or "", add_special_tokens=False).ids for x in [*texts, *odd]]
    given = []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, some, **options):
            given.extend(w for text in some for w in text.split())
            return self.tokenizer.encode_batch_fast(some, **options)

    for name in [name for name, x in vars(enc).items() if isinstance(x, Tokenizer)]:
        monkeypatch.setattr(enc, name, Counting(getattr(enc, name)))
    for most in (len(letters) + len(signs), len(signs)):  # the second time all letters are kept
        given.clear()
        ids, _ = enc.encode(texts)
        assert ids.tolist() == [k for x in want[: len(texts)] for k in x] and len(given) <= most
    ids, sizes = enc.encode(odd)
    assert ids.tolist() == [k for x in want[len(texts) :] for k in x] and sizes.tolist() == [len(x) for x in want[len(texts) :]]
    assert long not in enc.kept.to_pylist()


def test_texts_go_together_by_size():
    size = tokens.TEXTS // 3 - 1
    batch = pa.record_batch([pa.array(["a" * size, None, "b" * size, "", "c" * size, "d" * size, "e" * 4 * size, "f"])], ["text"])
    assert [b.num_rows for b in tokens.some_texts(batch)] == [6, 1, 1]
    assert not list(tokens.some_texts(batch.slice(0, 0)))


def test_range_coder_weights_fit_the_levels():
    """Guesses that nearly always hold cost little from a block's first ids on, and strays in between still come back."""
    rng = np.random.default_rng(5)
    ids = np.where(rng.random(100_000) < 0.01, rng.integers(0, 30_000, 100_000), np.arange(100_000) % 200).astype(np.uint32)
    data = range_coder.encode(ids)
    assert np.array_equal(range_coder.decode(data), ids)
    assert len(data) < 0.22 * len(ids)
    few = range_coder.encode(ids[:10])
    assert len(few) < 2 * 4 * range_coder.SLOTS + 400  # weights in the header grow with the ids


def ids_of(text, end):
    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_token_files(spark, tmp_path):
    rows = rows_of(1, 40)
    docs = documents(spark, tmp_path, rows)
    found = token_files.read_token_files(spark, token_files.write_token_files(docs, WORD_BPE, 2)).collect()
    start = 0
    for got, (doc_id, text, _) in zip(found, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        want = ids_of(text, 2)
        assert (got.doc_id, got.start, got.n_tokens) == (doc_id, start, len(want))
        assert np.frombuffer(got.ids, "<u4").tolist() == want
        start += len(want)
    assert len(found) == len(rows)


def test_packing(spark, tmp_path):
    rows = rows_of(2, 60)
    pieces = packing.pack(documents(spark, tmp_path, rows), WORD_BPE, 1, 256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.uid].append(p)
        by_sequence[p.sequence_id].append(p)
    texts = []
    for own in by_doc.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        texts.append((own[0].doc_id, tuple(np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist())))
    assert Counter(texts) == Counter((d, tuple(ids_of(t, 1))) for d, t, _ in rows)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(p.length for p in own) <= 256


def brute_repeats(rows, length):
    coded = [(t or "").encode() for _, t, _ in rows]
    counts = Counter(b[p : p + length] for b in coded for p in range(len(b) - length + 1))
    out = []
    for (doc_id, _, _), b in zip(rows, coded):
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                covered[p : p + length] = b"\x01" * length
        runs = sum(1 for k in range(len(b)) if covered[k] and (not k or not covered[k - 1]))
        out.append((doc_id, len(b), sum(covered), runs, bytes(x for x, c in zip(b, covered) if not c)))
    return Counter(out)


@pytest.mark.parametrize("most", [100_000, 2])
def test_repeats(spark, tmp_path, most):
    rows = rows_of(3)
    got = repeats.remove_repeats(documents(spark, tmp_path, rows), 200, most_contexts=most).collect()
    assert Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(rows, 200)


def brute_groups(rows, length):
    """The strings of all maximal repeats of at least ``length`` bytes, with all their (document, place)."""
    places = defaultdict(list)
    for d, (_, text, _) in enumerate(rows):
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            places[data[p : p + length]].append((d, p))
    data = [(t or "").encode() for _, t, _ in rows]
    found = {}
    for own in places.values():
        for k, (d, p) in enumerate(own):
            for e, q in own[:k]:
                if p and q and data[d][p - 1] == data[e][q - 1]:
                    continue  # a pair that goes on to the left
                n = length
                while p + n < len(data[d]) and q + n < len(data[e]) and data[d][p + n] == data[e][q + n]:
                    n += 1
                found.setdefault(data[d][p : p + n], set()).update({(d, p), (e, q)})
    for text, own in found.items():  # pairs that are longer hold it as well
        for d, p in places[text[:length]]:
            if data[d][p : p + len(text)] == text:
                own.add((d, p))
    return found


def test_repeat_groups_are_all_maximal_repeats(spark, tmp_path):
    """Groups that do not reach the limits of their contexts are those of brute force, with all occurrences."""
    rng = random.Random(11)

    def letters(n):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    length, rows = 80, []
    shared = [letters(rng.randint(85, 110)) for _ in range(12)]
    shared += [x[:k] + letters(9) for x in shared[:6] for k in (81, 88)] + [letters(7) + x[5:] for x in shared[3:9]]
    shared += [shared[0] + "\0\0", shared[0] + "\0", shared[1]]
    for k in range(90):
        rows.append((k, letters(rng.randint(0, 40)) + rng.choice(shared) + letters(rng.randint(0, 40)), "a"))
    rows += [(200, shared[0], "a"), (201, shared[0], "b"), (202, None, "a"), (None, "", None), rows[5]]
    want = brute_groups(rows, length)
    found = repeats.search(documents(spark, tmp_path, rows), length)
    number = {}  # uids in the order of the rows of one text
    texts = [(r.uid, r.text) for r in found.rows.select("uid", "text").collect()]
    left = defaultdict(list)
    for d, (_, text, _) in enumerate(rows):
        left[text].append(d)
    for uid, text in sorted(texts, key=lambda x: x[0]):
        number[uid] = left[text].pop(0)
    got, whole = defaultdict(set), set()
    named = repeats.occurrences(found, repeats.repeat_groups(found)).collect()
    groups = defaultdict(set)
    for r in named:
        groups[r.key, r["from"], r.to, r.first, r.last, r.left_first, r.left_last].add((number[r.uid], r.start, r.end))
    back = length - repeats.GRAM
    for (_, start, end, *_), own in groups.items():
        d, x, y = next(iter(own))
        data = rows[d][1].encode()
        assert {rows[e][1].encode()[u:v] for e, u, v in own} == {data[x:y]}  # one string
        if -start < back and end < length:
            got[data[x:y]] |= {(e, u) for e, u, _ in own}
            whole.add(data[x:y])
        else:
            assert {(e, u) for e, u, _ in own} <= {(e, p) for t, w in want.items() for e, q in w for p in range(q, q + len(t))}
    texts = {k: v for k, v in got.items() if k in want}
    assert len(texts) > 15 and all(v == want[k] for k, v in texts.items())
    assert {k for k in got if k not in want} == set()
    # Every maximal repeat whose anchors allow it is there; the others appear as parts, which removal is tested on.
    anchored = 0
    for text, own in want.items():
        d, p = next(iter(own))
        data = np.frombuffer(rows[d][1].encode(), np.uint8)
        _, place, _ = repeats.anchors(data, np.array([len(data)]), length)
        if any(a - p < back and p + len(text) - a < length and a >= p and a + repeats.GRAM <= p + len(text) for a in place.tolist()):
            anchored += 1
            assert text in got
    assert anchored > 15


@pytest.mark.parametrize("period", [1, 10, 32, 33, 150])
def test_periodic_texts_by_brute_force(spark, tmp_path, period):
    rng = random.Random(period)
    unit = "".join(rng.choice("abcdefgh") for _ in range(period))
    long = unit * (1500 // period)
    other = "".join(rng.choice("xyz") for _ in range(300))
    rows = [
        (1, other[:150] + long + other[150:], "a"), (2, long[3 % period :][:200], "a"), (3, unit * 2, "a"), (4, long[: 200 + period], "a"),
        (5, long[: 199 + period], "b"), (6, other + long[5:1200] + "q" + long[:900], "b"), (7, None, None), (8, long[:650] + "r" + long, None),
    ]
    for some in (rows, rows[:1], rows[3:4], rows[4:5], rows[7:]):
        got = repeats.remove_repeats(documents(spark, tmp_path / str(rng.random()), some), 200).collect()
        assert Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(some, 200)


@pytest.mark.parametrize("period", [1, 10, 100])
def test_long_periodic_texts_have_few_contexts(spark, tmp_path, period):
    """Two megabytes of a run lose all bytes, by a bounded number of contexts where the period is at most a gram."""
    unit = "".join(random.Random(period).sample("abcdefghijklmnopqrstuvwxyz" * 4, period))
    text = unit * (2_000_000 // period)
    found = repeats.search(documents(spark, tmp_path, [(1, text, "a"), (2, "other", "a")]), 200)
    assert found.places.count() <= (60_000 if period > repeats.GRAM else 1_000)
    got = repeats.remove_repeats(documents(spark, tmp_path / "again", [(1, text, "a")]), 200).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in got] == [(len(text), len(text), 1)]


def shingles(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = quality.WORDS.findall(lowered)
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


@pytest.mark.parametrize("cell", [4, 512])
def test_near_duplicates(spark, tmp_path, monkeypatch, cell):
    monkeypatch.setattr(near_dup, "CELL", cell)
    rows = rows_of(4)
    sets = [shingles(t, 4) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    want = []
    for k, (doc_id, _, _) in enumerate(rows):
        own = [rows[x][0] for x in range(len(rows)) if find(x) == find(k) and rows[x][0] is not None]
        least = min(own, default=None) if sets[k] else doc_id
        want.append((doc_id, len(sets[k]), least, doc_id == least))
    got = near_dup.link(documents(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(want)


def test_odd_sketches_follow_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    near = np.concatenate([base[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])  # 0.82
    far = np.concatenate([base[:400], rng.integers(0, 2**63, 600).astype(np.uint64)])  # 0.25
    bits = near_dup.odd_sketches(np.stack([near_dup.samples(x) for x in (base, near, far)]))
    differ = [int(np.bitwise_count((bits[0] ^ bits[k]).view(np.uint64)).sum()) for k in (1, 2)]
    assert differ[0] <= near_dup.most_differing(0.8) < differ[1]


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(0, 1 + k % 3, 8).astype("float32")]) for k in range(400)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, [1.0, None]), (504, [float("nan")] * 8), (505, [0.0] * 8), rows[7]]
    got = topk.top_k(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0, bucket_rows=60
    ).collect()
    whole = {i: np.floor(256 * np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_mixing(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)) or None, rng.choice(["a", "b", "b", "c", None])) for k in range(600)]
    docs = documents(spark, tmp_path, rows)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    weights = dict(zip(["a", "b", "c", None], [1, 2, 3, 1]))
    share = sum(size.values()) / sum(weights.values())
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and r.taken <= 3 * r.size
    for source, weight in weights.items():
        target = next(r.target for r in got if r.source == source)
        assert abs(taken[source] - target) <= 40
        if 3 * size[source] > 2 * share * weight:
            assert target >= share * weight


def test_quality_measures():
    text = "a b c d e f\na b c d e f\n\n  \nx # $%"
    assert quality.measures(text)[:5] == (15, 16, 3, 3, 1)
    assert quality.repeated_words("a b c d e f a b c d e f".split()) == 12
    words = [random.Random(8).choice("abc") for _ in range(300)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(296))
    inside = {k + x for k in range(296) if windows[tuple(words[k : k + 5])] > 1 for x in range(5)}
    assert quality.repeated_words(words) == len(inside)
    assert quality.measures(None) == quality.measures("") == (0, 0, 0, 0, 0, 0)


def test_quality_judges(spark, tmp_path):
    rng = random.Random(9)
    clean = [(k, " ".join("w%d" % rng.randrange(9000) for _ in range(60)), "a") for k in range(300)]
    junk = [(1000, " ".join("w%d$$$" % k for k in range(60)), "a"), (1001, None, None), (1002, "same words here now yes " * 9, "a")]
    got = {r.doc_id: r for r in quality.judge(documents(spark, tmp_path, clean + junk)).collect()}
    assert all(got[k].kept for k in range(300))
    assert not got[1000].kept and not got[1000].base_failed
    assert got[1001].base_failed and got[1002].base_failed


def test_languages(spark):
    got = QUERIES["op5_language"](spark, SMALL).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_languages_odd_rows(spark):
    model = languages.train(spark.createDataFrame([(1, "aaa bbb", "x"), (2, "ccc ddd", "y")], "doc_id bigint, text string, lang string"))
    docs = spark.createDataFrame([(1, None, "s"), (2, "12 %", "s"), (3, "ccc", "s"), (3, "ccc", "s")], "doc_id bigint, text string, score string")
    got = [(r.row.doc_id, r.lang_pred, r.row.score) for r in languages.predict(docs, *model).collect()]
    assert got == [(1, "und", "s"), (2, "und", "s"), (3, "y", "s"), (3, "y", "s")]
    assert {r.lang_pred for r in languages.predict(docs, [], np.empty((0, languages.BUCKETS))).collect()} == {"und"}


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header><p>Site name of the day</p></header>
<nav><a href=a>Home</a></nav><div class="sidebar"><p>%(prose)s</p></div><!-- x --><article><header><h1>Head &amp; line</h1></header>
<p>%(prose)s<p>Short.<p><a href=b>More</a> of&nbsp;the <b>text &lt;3</b></p><div class=ad>Buy the best of all</div></article>
<section id="comments"><article><p>%(prose)s</p></article></section><form><p>Your name</p></form><footer>&copy; all</footer>"""
PROSE = "It was the best of times and it was the worst of times for all of us who were there on that day in the old town."


def test_main_text():
    kept = [b["text"] for b in html_text.main_blocks(PAGE % {"prose": PROSE}) if b["kept"]]
    assert kept == ["Head & line", PROSE, "Short.", "More of the text <3"]
    assert html_text.main_blocks(None) == html_text.main_blocks("") == []
    plain = "<body><div><a href=x>Menu</a> <a href=y>Other</a></div><p>" + PROSE * 3 + "</p><p>So it is.</p><p>" + PROSE * 3
    assert [b["text"][:9] for b in html_text.main_blocks(plain) if b["kept"]] == ["It was th", "So it is.", "It was th"]


def test_chat_round_trip(spark):
    rng = random.Random(10)
    parts = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "[ROLE=x]", "\\", "\\a", "\n", "]", "hi", "é"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) if conv % 2 else "plain"
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "to]ol", None]), rng.choice([text, text, None]), 1))
    rows += [rows[0], (None, None, "user", CONFLICT, 1)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place int"))
    got = got.withColumns({"back": chat.parse(F.col("formatted")), "masked": chat.loss_text(F.col("formatted"), F.col("loss"))}).collect()
    for r in got:
        own = sorted(
            [(x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id],
            key=lambda x: (x[0], x[1].encode(), x[2].encode()),
        )
        assert [tuple(t) for t in r.back] == [(a, b) for _, a, b in own] and r.exact
        assert r.masked == "".join(b for _, a, b in own if a == "assistant")
    assert {r.level for r in got} == {0, 1} and len(got) == 41


def test_query_digests(spark):
    got = {r.conv_id: r for r in QUERIES["op10_chat"](spark, SMALL).collect()}
    said = f"user\n{CONFLICT}\nassistant\n{CONFLICT}\n"
    assert got[-1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(CONFLICT.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    build = QUERIES[name]

    def widened(s, sf):
        df = build(s, sf)
        return df.withColumn("rank", F.col("rank").cast("bigint")) if "rank" in df.columns else df

    assert difference(connect(SMALL), spark, SMALL, widened, SQL[name].replace("AS INTEGER", "AS BIGINT")) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op10_chat" else 0)


def test_long_texts_are_counted_in_slices(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc É日.") for _ in range(n)) for n in (0, 1, 9, 10, 11, 20, 21, 500)]
    whole = languages.trigram_counts(texts)
    monkeypatch.setattr(languages, "SLICE", 10)
    cut = languages.trigram_counts(texts)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    assert whole[1].tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.count(), corpus_pipeline.saved(stage(spark, docs, SMALL), name)
        if name != "packed":
            assert docs.columns == names
        if name == "near_duplicates":
            assert docs.count() < before
    assert "sequence_id" in docs.columns


def replanned(monkeypatch, spark, *modules):
    """Has Spark plan scans for one and for many cores by turns, as when executors come and go; one file a partition or all."""
    write, turns = modules[0].saved, [0]

    def saved(df, name):
        turns[0] += 1
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16" if turns[0] % 2 else "1")
        return write(df, name)

    for module in modules:
        monkeypatch.setattr(module, "saved", saved)


@pytest.fixture
def many_files(spark, tmp_path):
    """Documents in twelve files of uneven sizes, and the rows."""
    rows = rows_of(11)
    path = str(tmp_path / "dealt")
    full = [(d, t, "en", s, 1, "u", "l", 2, "k") for d, t, s in rows]
    for k in range(12):
        spark.createDataFrame(full[k::12], DOCS).coalesce(1).write.mode("append").parquet(path)
    yield spark.read.parquet(path), rows
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_repeats_keep_row_ids_between_jobs(spark, many_files, monkeypatch):
    docs, rows = many_files
    replanned(monkeypatch, spark, common, repeats)
    got = repeats.remove_repeats(docs, 200).collect()
    assert Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(rows, 200)


def test_near_duplicates_keep_row_ids_between_jobs(spark, many_files, monkeypatch):
    docs, _ = many_files
    want = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.link(docs).collect())
    replanned(monkeypatch, spark, common, near_dup, components)
    got = near_dup.link(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_pipeline_stage_keeps_row_ids_between_jobs(spark, many_files, monkeypatch):
    import corpus_pipeline

    docs, _ = many_files
    want = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    replanned(monkeypatch, spark, common, near_dup, components, corpus_pipeline)
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def sentences(rng, letters, n):
    """Words of a language that has its own ``letters``."""
    kinds = ["".join(random.Random(f"{letters}{k}").choices(letters, k=4)) for k in range(40)]
    return " ".join(rng.choices(kinds, k=n))


def test_language_sets_and_stage(spark):
    import corpus_pipeline

    rng = random.Random(12)
    tongues = dict(zip("pqrst", ["abcde", "fghij", "klmno", "uvwxy", "αβγδε"]))
    rows = [(k, sentences(rng, x, 60), lang) for lang, x in tongues.items() for k in range(1000 * ord(lang), 1000 * ord(lang) + 30)]
    for n in range(1, 6):  # balanced, of n languages
        rows.append((n, " ".join(sentences(rng, x, 60) for x in list(tongues.values())[:n]), None))
    rows.append((6, "".join(rng.choices("zжщюэф ", k=400)), None))  # no language that was learned
    rows += [(7, "12 %", None), (8, None, None), (9, sentences(rng, "abcde", 2), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = languages.predict(docs, *languages.train(docs.where(~languages.held_out())))
    found = {r.row.doc_id: r for r in found.where("row.doc_id < 10").collect()}
    for n in range(1, 6):
        assert {x.lang for x in found[n].languages} == set("pqrst"[:n])
        assert all(abs(x.share - 1 / n) < 0.1 for x in found[n].languages)
    assert found[7].languages == [] and found[7].fit is None and found[8].lang_pred == "und"
    assert found[6].fit < found[5].fit
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {d for d, _, _ in rows} - {6, 7, 8}


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>One two.<|endoftext|>", "A <|ENDOFTEXT|>b", "x\n<|endoftext|>\ty z", "no such"])
def test_added_tokens_in_texts(spark, tmp_path, text):
    plain = Tokenizer.from_file(WORD_BPE)
    want = [plain.encode(x, add_special_tokens=False).ids for x in ("a b", text, "b a")]
    ids, sizes = Encoder(WORD_BPE).encode(["a b", text, "b a"])
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [k for x in want for k in x]
    docs = documents(spark, tmp_path, [(1, "a b", None), (2, text, None), (3, "b a", None)])
    found = token_files.read_token_files(spark, token_files.write_token_files(docs, WORD_BPE, 2)).collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [[*x, 2] for x in want]
    pieces = defaultdict(list)
    for p in sorted(packing.pack(docs, WORD_BPE, 2, 256).collect(), key=lambda p: p.start):
        pieces[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert pieces == {k + 1: [*x, 2] for k, x in enumerate(want)}


def kept_text(html):
    return [b["text"] for b in html_text.main_blocks(html) if b["kept"]]


def test_main_text_without_known_stop_words():
    polish = "Rano rybacy wypłynęli na jezioro, ponieważ wiatr ucichł i woda była spokojna jak szkło przed świtem. " * 3
    chinese = "清晨渔民们驾船驶向湖心，因为风已经停了，湖水平静得像一面镜子。" * 10
    for prose in (polish.strip(), chinese):
        page = f"<body><div><a href=x>Menu</a> <a href=y>{prose}</a></div><div><p>{prose}</p><p>{prose}</p></div><div class=footer><p>{prose}</p></div>"
        assert kept_text(page) == [prose, prose]


def test_named_elements_without_prose_exclude_nothing():
    page = f"<body><h1 class='entry-title'>Head</h1><div class='post-meta'>By Ann, May 2</div><div><p>{PROSE * 3}</p><p>{PROSE * 3}</p></div>"
    assert [x for x in kept_text(page) if len(x) > 70] == [PROSE * 3] * 2
    assert kept_text(f"<body><div><p>{PROSE * 2}</p></div><article><p>{PROSE * 3}</p></article>") == [PROSE * 3]


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>" * 100_000 + "</span>" * 70_000, '<a ">"' * 170_000, "<script>" + "</script " * 110_000,
     "<nav>" + "<article>" * 110_000, "<p><div>" + "<b>" * 100_000 + "<p></p>" * 90_000, "<p>x<![CDATA[" * 80_000],
)
def test_malformed_pages_take_time_in_proportion(page):
    """A megabyte each; in the square of its length any of these would take minutes."""
    begin = time.process_time()
    html_text.main_blocks(page)
    assert time.process_time() - begin < 15


def test_tags_end_as_they_begin():
    """Open elements by a plain walk through the stack."""
    rng = random.Random(8)
    tags = ["p", "a", "b", "div", "li", "nav", "form", "td"]
    for _ in range(300):
        elements, stack = html_text._Open(), []
        for _ in range(40):
            tag = rng.choice(tags)
            beside = False
            for name in reversed(stack):
                if name == tag or name not in html_text.INLINE:
                    beside = name == tag
                    break
            assert elements.beside(tag) == beside
            if rng.random() < 0.6:
                stack.append(tag)
                elements.push(tag, -1 if tag in ("nav", "form") else 0, 0)
            else:
                assert elements.close(tag) == (tag in stack)
                if tag in stack:
                    while stack.pop() != tag:
                        pass
            assert [t for t, _, _ in elements.stack] == stack and elements.outside == stack.count("nav")


def test_letters_of_newer_alphabets_through_the_pipeline(spark):
    """U+10570 is a letter for Python and none for older Java."""
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(k, sentences(rng, "abcde", 40), "p") for k in range(40)] + [(99, "\U00010570\U00010571", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept >= set(range(40))


def test_pipeline_on_odd_tables(spark):
    """Empty tables, null ids and texts, repeated rows, and columns whose names the operators use inside."""
    import corpus_pipeline

    rng = random.Random(14)
    base = "doc_id bigint, text string, lang string, source string"
    odd = base + ", uid string, hash int, row string, times int, component int, size int"
    texts = [sentences(rng, x, 60) for x in ("abcde", "fghij") for _ in range(30)]
    rows = [(k, t, "pq"[k >= 30], "s") for k, t in enumerate(texts)] + [(None, texts[0] + " x", None, None), (None, None, None, None), (3, texts[3], "p", "s")]
    for docs in (spark.createDataFrame([], base), spark.createDataFrame([(*r, "u", 1, "r", 2, 3, 4) for r in rows], odd)):
        names, empty = docs.columns, docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.saved(stage(spark, docs, SMALL), name)
            assert name == "packed" or docs.columns == names
        assert docs.isEmpty() == empty


def brute_verdicts(rows):
    """kept per row, with quartiles of sorted values instead of merged sketches."""
    facts = []
    for doc_id, text, lang, source in rows:
        n, chars, symbols, lines, dup, again = quality.measures(text)
        values = {
            "word_length": chars / max(n, 1), "symbols": symbols / max(chars, 1), "dup_lines": dup / max(lines, 1), "repeats": again / max(n, 1),
        }
        facts.append((doc_id, lang, source, n < 10 or 100 * again > 20 * n, values))

    def rounded(v):
        return 0.0 if v <= 1e-9 else 2 * quality.GAMMA ** math.ceil(math.log(v) / math.log(quality.GAMMA)) / (quality.GAMMA + 1)

    def fence(group, name):
        ordered = sorted(rounded(f[4][name]) for f in group)
        q1, q3 = (ordered[math.ceil(share * len(ordered)) - 1] for share in (0.25, 0.75))
        least, both = quality.MEASURES[name]
        reach = quality.REACH * max(q3 - q1, least)
        return (q1 - reach if both else -1.0), q3 + reach

    kept = []
    for doc_id, lang, source, failed, values in facts:
        passed = [f for f in facts if not f[3]]
        groups = [[f for f in passed if f[1:3] == (lang, source)], [f for f in passed if f[1] == lang], passed]
        group = next((g for g in groups[:2] if len(g) >= quality.LEAST_GROUP), passed)
        inside = all(low <= values[m] <= high for m in values for low, high in [fence(group, m)])
        kept.append((doc_id, failed, not failed and inside))
    return kept


def test_quality_verdicts_against_brute_force(spark):
    """Groups with fences of their own, small ones with their language's, and a small language with those of all."""
    rng = random.Random(15)

    def text(letters, marks):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(*letters))) for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(0, marks)):
            words[rng.randrange(len(words))] += rng.choice("#*$%")
        if rng.random() < 0.1:
            words += words[:7]
        lines = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
        return "\n".join(lines + lines[:1] * (rng.random() < 0.2))

    kinds = [("en", "a", 130, (3, 7), 1), ("en", "b", 60, (3, 7), 30), ("de", "a", 140, (6, 14), 2), ("de", None, 9, (3, 4), 0), (None, "c", 30, (1, 2), 3)]
    rows = [(text(letters, marks), lang, source) for lang, source, n, letters, marks in kinds for _ in range(n)]
    rows += [(text((20, 30), 0), "en", "a"), ("word " * 40, "en", "a"), ("", "xx", "a"), (None, None, None)]
    rows = [(k, *r) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in quality.judge(docs).collect())
    assert got == brute_verdicts(rows)
    assert 20 < sum(not failed and not kept for _, failed, kept in got) < len(got) / 2


def near_groups(rows, width):
    """The number of each row's group of near duplicates, and each row's shingles."""
    sets = [shingles(t, width) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(rows))], sets


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """The rows that the second to the fourth stage keep, each on what its predecessor kept."""
    import corpus_pipeline

    rows = [*rows_of(16, 60), (500, " ".join(f"u{k}" for k in range(90)), "c"), (501, " ".join(f"u{k}" for k in range(60)), "c")]
    docs = documents(spark, tmp_path, rows).withColumn("n_chars", F.char_length("text"))

    docs = corpus_pipeline.saved(corpus_pipeline.near_duplicates(spark, docs, ""), "near")
    group, sets = near_groups(rows, 5)
    members = defaultdict(list)
    for k, row in enumerate(rows):
        members[group[k] if sets[k] else ("alone", k)].append(row)
    stay = [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in members.values()]
    got = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert Counter(r[0] for r in got) == Counter(r[0] for r in stay)
    known = {(r[0], r[1]) for r in rows}
    assert all((d, t) in known for d, t, _ in got)

    docs = corpus_pipeline.saved(corpus_pipeline.repeated_passages(spark, docs, ""), "passages")
    want = Counter()
    for (doc_id, _, _, _, kept), n in brute_repeats(got, 200).items():
        want[doc_id, kept.decode(errors="ignore"), len(kept.decode(errors="ignore"))] += n
    assert Counter((r.doc_id, r.text or "", r.n_chars) for r in docs.collect()) == want
    assert any(n < 400 for d, _, n in want if d == 500)  # a passage that two documents share

    mix = Counter()
    for r in mixing.mix(docs).collect():
        mix[r.doc_id, r.taken] += 1
    size = {(r.doc_id, r.text): len(quality.WORDS.findall(r.text or "")) for r in docs.collect()}
    times = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixture(spark, docs, "").collect())
    taken = Counter((d, n * size[d, t]) for (d, t), n in times.items() if size[d, t])
    assert taken == Counter({k: n for k, n in mix.items() if k[1]})
