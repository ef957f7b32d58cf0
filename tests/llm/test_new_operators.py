"""Fill-in-the-middle, archives and spelling variants against brute force: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetroll.llm import archives, fill_middle, variants
from fleetroll.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F
from tests.llm.test_operators import documents
from tests.oracle import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_archives", "op13_variants"])
def test_query_matches_sql(spark, name):
    assert difference(connect(SMALL), spark, SMALL, QUERIES[name], SQL[name]) is None


# Fill in the middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fill(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), output


def odd_texts(seed, n):
    """Long words, long white space, many bytes a letter, passages that repeat, marks and pieces of marks."""
    rng = random.Random(seed)
    shared = "".join(rng.choice("abcdé 日\n") for _ in range(5000))
    pieces = [shared, "x" * 9000, " " * 9000, "日本語 " * 700, "a b " * 3000, "<P", "<<S", "S>", " ", "\n", "é", "word", " ", "\x1c"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))) for _ in range(n)]
    return [*texts, "", None, " ", "\t\n ", "a", " a", "a ", "<P>", "a <M> b", "x" * 100_000, ("ab" * 40 + " ") * 3000]


def test_fill_middle_against_brute_force(spark, tmp_path):
    rows = [(k, t, "s") for k, t in enumerate(odd_texts(1, 250))] + [(None, "a b c d", "s"), (None, None, None), (3, "again and again", "s"), (3, "again and again", "s")]
    made = fill_middle.fill_middle(documents(spark, tmp_path, rows))
    made = made.withColumn("back", fill_middle.restore("output", "form")).collect()
    key = str
    assert sorted([tuple(r)[:6] for r in made], key=key) == sorted([brute_fill(d, t) for d, t, _ in rows], key=key)
    assert Counter(r.back for r in made) == Counter(t or "" for _, t, _ in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_every_cut_of_every_text():
    """Each number of tokens gives the cut that the pattern gives, for chunks of any size."""
    summaries = fill_middle.Summaries()
    for text in odd_texts(2, 60):
        text = text or ""
        data = text.encode()
        counted = next(fill_middle.count_all([data], summaries))
        tokens = TOKEN.findall(text)
        assert counted.tokens == len(tokens)
        for k in {0, 1, 2, len(tokens) // 2, len(tokens) - 1, len(tokens)}:
            if 0 <= k <= len(tokens):
                front = "".join(tokens[:k])
                assert counted.end_of(k) == (len(front.encode()), len(front))


def test_chunks_follow_content_and_are_kept():
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(200_000)).encode()
    summaries = fill_middle.Summaries()
    for _ in fill_middle.count_all([shared], summaries):
        pass
    first = summaries.made
    assert 60 < first < 400
    for _ in fill_middle.count_all([b"another beginning " + shared, shared + b" another end"], summaries):
        pass
    assert summaries.made - first <= 6  # but for the chunks at the ends all are known
    small = fill_middle.Summaries(kept=10_000)
    for _ in fill_middle.count_all([shared] * 3, small):
        pass
    assert sum(map(len, small.young)) + sum(map(len, small.old)) < 40_000
    zeros = np.zeros(3_000_000, np.uint8)  # a cut at every byte, or at none
    ends = fill_middle.chunks(0, len(zeros), fill_middle.cut_points(zeros).tolist())
    assert len(ends) <= len(zeros) // fill_middle.LEAST + 1 and ends[-1] == len(zeros)


def test_fill_middle_of_nothing(spark, tmp_path):
    assert fill_middle.fill_middle(documents(spark, tmp_path, [(1, "a", "s")]).limit(0)).count() == 0


# Archives


def pages(spark, tmp_path, rows):
    """Pages with columns whose names the operator uses inside."""
    path = str(tmp_path / "pages")
    full = [(*r, "t", "b", 7, "d") for r in rows]
    spark.createDataFrame(full, "page_id bigint, url string, html string, type string, block string, at int, digest string").write.parquet(path)
    return spark.read.parquet(path)


PAGES = [
    (5, "http://a/1", "same"), (3, "http://a/2 with space\n", "same"), (9, None, "same"), (3, "http://a/3", "same"), (1, "-", ""), (2, "http://e", None),
    (None, "http://n", "alone"), (None, "http://n", "alone"), (7, "http://crlf", "a\r\n\r\nWARC/1.0\r\n\r\nb\n\n"), (8, "http://é/日", "é日" * 10), (10, "http://long", "xyz " * 500_000),
]


def brute_pages(rows, least=0):
    first = {}
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page_id)
    out, used = [], set()
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= least and data in used
        used.add(data)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, segment", [(0, archives.SEGMENT), (1, 300), (5, 300)])
def test_archives_round_trip(spark, tmp_path, monkeypatch, least, segment):
    monkeypatch.setattr(archives, "SEGMENT", segment)
    given = pages(spark, tmp_path, PAGES)
    arc = archives.write_arc(given)
    back = archives.read_warc(spark, archives.convert(spark, arc, least_bytes=least))
    assert back.where("error IS NOT NULL").count() == 0
    told = archives.with_referred(back.where("type <> 'warcinfo'"))
    got = told.select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute_pages(PAGES, least)
    payloads = Counter((r.page_id, bytes(r.payload)) for r in told.where("type = 'response'").collect())
    whole = {len((h or "").encode()): (h or "").encode() for _, _, h in PAGES}  # these have different sizes
    assert payloads == Counter((p, whole[n]) for p, n, _, t, _ in brute_pages(PAGES, least) if t == "response")
    kept = {r.url for r in archives.read_arc(spark, arc).where("type = 'response'").collect()}
    assert {"http://a/2%20with%20space%0A", "http://é/日", None} <= kept
    assert {r.version for r in archives.read_arc(spark, arc).collect()} == {1, 2} or segment > 300
    files = {r.f for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(arc).select(F.col("path").alias("f")).collect()}
    assert len(files) > 5 or segment > 300


def test_archives_of_nothing(spark, tmp_path):
    warc = archives.convert(spark, archives.write_arc(pages(spark, tmp_path, PAGES).limit(0)))
    assert archives.read_warc(spark, warc).count() == 0


V1 = b"filedesc://x.arc 0.0.0.0 20011231235959 text/plain 69\n1 0 Some Org\nURL IP-address Archive-date Content-type Archive-length\n"


def foreign(body, head=V1):
    about = head.split(b"\n", 1)[1]
    line = head.split(b"\n", 1)[0].rsplit(b" ", 1)[0] + b" %d\n" % len(about)
    return line + about + body


def test_foreign_arc_files(spark, tmp_path):
    """Binary payloads, records that are no HTTP answers, short dates, damage in the middle, no version block, plain and gzipped."""
    http = b"HTTP/1.0 404 Not Found\nContent-Type: image/gif\n\n\xff\xfe\x00GIF"
    good = b"\nhttp://h/x.gif 10.0.0.1 2002 image/gif %d\n%s" % (len(http), http) + b"\ndns:h 10.0.0.1 20020230000000 text/dns 5\nh. IN\n"
    bad = good + b"\nhttp://h/cut 10.0.0.1 20020101000000 text/html 5000\nHTTP/1.0 200 OK\n\nshort"
    two = V1.replace(b"\n1 0", b"\n2 0")
    v2 = b"\nhttp://h/2 10.0.0.2 20030405060708 text/html 200 - - 71 x.arc %d\n%s" % (len(http), http)
    files = {"part-1": foreign(good), "part-2": gzip.compress(foreign(bad)[:200]) + gzip.compress(foreign(bad)[200:]), "part-3": foreign(v2, two), "part-4": b"no archive", "part-5": b"", "part-6": foreign(v2)}
    (tmp_path / "arc").mkdir()
    for name, data in files.items():
        (tmp_path / "arc" / name).write_bytes(data)
    rows = archives.read_arc(spark, str(tmp_path / "arc")).collect()
    errors = {r.archive[-1]: r.error for r in rows if r.error}
    assert set(errors) == {"2", "4", "6"}
    assert errors["2"].startswith("declared length beyond the end") and errors["4"].startswith("no version block") and errors["6"].startswith("10 fields in a header of version 1")
    found = sorted((r.archive[-1], r.version, r.type, r.date, r.ip) for r in rows if not r.error)
    own = "2001-12-31T23:59:59Z"
    assert found == [
        ("1", 1, "resource", own, "10.0.0.1"), ("1", 1, "response", "2002-01-01T00:00:00Z", "10.0.0.1"), ("1", 1, "warcinfo", own, "0.0.0.0"),
        ("2", 1, "resource", own, "10.0.0.1"), ("2", 1, "response", "2002-01-01T00:00:00Z", "10.0.0.1"), ("2", 1, "warcinfo", own, "0.0.0.0"),
        ("3", 2, "response", "2003-04-05T06:07:08Z", "10.0.0.2"), ("3", 2, "warcinfo", own, "0.0.0.0"), ("6", 1, "warcinfo", own, "0.0.0.0"),
    ]
    back = archives.read_warc(spark, archives.convert(spark, str(tmp_path / "arc"))).collect()
    assert Counter(r.type for r in back) == {"warcinfo": 4, "response": 1, "revisit": 2, "resource": 2}
    assert {bytes(r.payload) for r in back if r.type == "response"} == {b"\xff\xfe\x00GIF"}
    assert not any(r.error for r in back)


def test_damaged_warc_is_told():
    record = archives.warc_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", "sha1:" + archives.sha1(b"payload"))], b"HTTP/1.1 200 OK\r\n\r\npayload")
    whole = list(archives.parse_warc("f", record + b"\r\n\r\n" + record.replace(b"\r\npayload", b"\r\nPayload")))
    assert [r[8] for r in whole] == [None, "payload differs from its digest"]
    assert list(archives.parse_warc("f", record[:-3]))[0][8].startswith("f: no record at byte 0")


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def spelled(seed, n, kinds=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abéÉÿ") for _ in range(rng.randint(4, 9))) for _ in range(kinds)]
    rows = []
    for k in range(n):
        own = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(words)
            at = rng.randrange(len(w))
            own.append(rng.choice([w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "a" + w[at + 1 :]]))
        rows.append((k, rng.choice([" ", "-", "日", "Ā "]).join(own), "s"))
    long = "z" * 3000
    chain = " ".join(["qqqqqr"] * 20 + ["qqqqqrr"] * 8 + ["qqqqqrrr"] * 3)
    return [*rows, (None, chain, "s"), (None, "nullid nullid nullid nullie nullie nullie", "s"), (n, None, None), (n + 1, "", "s"), *[(n + 2 + k, f"{long} {long}y", "s") for k in range(3)], rows[0], rows[0]]


@pytest.mark.parametrize("block", [3, 1024])
def test_variants_against_brute_force(spark, tmp_path, monkeypatch, block):
    """Small blocks are halved until one letter is free."""
    rows = spelled(1, 60)
    docs = documents(spark, tmp_path, rows)
    words = variants.count_words(docs).where("n >= 3")
    near = {r.word: (r.n_near, r.form, r.form_n) for r in variants.near_words(variants.blocks(words, block)).collect()}
    want = brute_variants(rows)
    assert {w: c for w, _, _, _, c, _ in want if c} == {w: v[0] for w, v in near.items()}
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(docs).collect()]
    assert sorted(got, key=str) == want
    assert any(f is not None and f != r for _, f, r, *_ in want)  # ways of more than one step


def test_runs_are_whole_wherever_a_piece_ends(monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 7)
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("abÉ 日-") for _ in range(rng.randint(0, 60)))
        runs = [r.decode("latin-1") for part in variants._pieces(text) for r in part]
        assert runs == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_distances_of_letter_counts():
    codes = variants._letters(["abcde", "abcdf", "abcdee", "edcba", "abcdeé"], 6)
    counts = variants.letter_counts(codes)
    distance = ((counts[:, None] - counts[None]) ** 2).sum(2)
    assert distance[0].tolist() == [0, 2, 1, 0, 1]
    a, b = variants.near_pairs(codes, 5, 0, 5)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (0, 2), (0, 4)]
    a, b = variants._small_blocks(codes, 5, 5, 0, 4)
    assert not len(a)  # these edits are in the last place


def test_variants_of_nothing(spark, tmp_path):
    assert variants.variants(documents(spark, tmp_path, [(1, "abcde", "s")]).limit(0)).count() == 0
