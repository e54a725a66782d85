"""Vector codes, WARC archives and fill-in-middle against brute force, on odd, empty and skewed tables."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.llm import fill_in_middle, vector_codes, warc
from gaugewise.llm.common import written

from .fixtures import empty, odd, words

LONGEST = 2**63 - 1


# 11


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """rows (vec_id, vector, label); every distance by Python's integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    whole = lambda v: [math.floor(Fraction(x) * 1024) for x in v] + [0] * (parts * width - len(v))
    pieces = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    vectors = [pieces(whole(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[vectors[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(v[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for v in vectors]

    for _ in range(rounds):
        members = defaultdict(list)
        for v, got in zip(vectors, assign()):
            for p, (_, j) in enumerate(got):
                members[p, j].append(v[p])
        for (p, j), of in members.items():
            books[p][j] = [sum(c) // len(of) for c in zip(*of)]
    out, by_label = [], Counter()
    for (i, _, label), got in zip(kept, assign()):
        out.append((i, "".join(f"{j:02x}" for _, j in got), min(sum(d for d, _ in got), LONGEST), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for part in books for e in part for c in e).encode()).hexdigest()
    return Counter((i, c, e, min(by_label[label], LONGEST), digest) for i, c, e, label in out)


def told(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def vector_table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string, error string").repartition(3)


def some_vectors(n, size, seed, scale=1.0):
    r = random.Random(seed)
    f = lambda: float(np.float32(r.gauss(0, scale)))
    return [(i, [f() for _ in range(size)], r.choice([0, 1, None]), "c", "e") for i in range(n)]


@pytest.mark.parametrize("size,entries", [(8, 5), (12, 16), (20, 7), (64, 4)])
def test_codes(spark, size, entries):
    rows = some_vectors(90, size, size)
    rows += rows[:9] + [(1000 + k, [0.5] * size, 7, "c", "e") for k in range(60)]  # repeated rows and one large group
    got = vector_codes.compress(vector_table(spark, rows), entries=entries)
    assert told(got) == codes_by_hand([r[:3] for r in rows], entries=entries)


def test_codes_of_odd_vectors(spark):
    rows = [*some_vectors(30, 8, 1), (100, None, 1, "", ""), (101, [1.0, None] * 4, 1, "", ""), (102, [math.nan] * 8, 1, "", ""), (103, [math.inf] + [0.0] * 7, 1, "", ""), (104, [-math.inf] + [0.0] * 7, 1, "", "")]
    rows += [(105, [], None, "", ""), (106, [1.5], None, "", ""), (107, [-0.0009] * 9, 2, "", ""), (None, [0.25] * 8, 2, "", ""), (-5, [0.125] * 8, 2, "", ""), (-5, [0.0625] * 8, 2, "", "")]
    df = vector_table(spark, rows)
    assert told(vector_codes.compress(df, entries=6)) == codes_by_hand([r[:3] for r in rows], entries=6)
    assert told(vector_codes.compress(df)) == codes_by_hand([r[:3] for r in rows])  # fewer rows than entries
    large = [(i, [x * 10.0**i for x in v], label, "", "") for i, (_, v, label, *_) in enumerate(some_vectors(35, 8, 2))]  # sums beyond a long
    assert told(vector_codes.compress(vector_table(spark, large, "double"), entries=6)) == codes_by_hand([r[:3] for r in large], entries=6)
    nothing = vector_table(spark, [(1, None, 1, "", "")])
    assert vector_codes.compress(nothing).collect() == [] and vector_codes.compress(nothing).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    same = vector_codes.compress(vector_table(spark, [(i, [], None, "", "") for i in range(3)])).collect()
    assert {(r.code, r.error, r.label_error) for r in same} == {("00000000", 0, 0)}


def test_sequency_and_elimination():
    r = np.random.default_rng(5)
    for width in (1, 2, 4, 16, 32):
        h = vector_codes.transformed(np.eye(width, dtype=np.int64)).T
        assert [int((row[:-1] != row[1:]).sum()) for row in h] == list(range(width)) and (h @ h.T == width * np.eye(width)).all()
        x, e = r.integers(-9, 9, (700, width)), r.integers(-9, 9, (40, width))  # many ties
        x[::3] += np.arange(width) * 50
        e[::3] += np.arange(width) * 50
        far = ((x[:, None] - e[None]) ** 2).sum(2)
        codes, sums = vector_codes.nearest(vector_codes.transformed(x), vector_codes.transformed(e))
        assert (codes == far.argmin(1)).all() and (sums == width * far.min(1)).all()


def test_codes_decoded(spark):
    rows = some_vectors(40, 8, 3)
    kept = written(vector_codes.kept_vectors(vector_table(spark, rows)), "t")
    shape, books = vector_codes.fit(kept, entries=40)
    back = vector_codes.decode(vector_codes.encode(kept, shape, books), books).collect()
    want = {r[0]: r[1] for r in rows}
    assert all(abs(a - b) <= 1 / 1024 for r in back for a, b in zip(r.approximation, want[r.vec_id]))  # an entry a vector


# 12


def sha1(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def archived_by_hand(rows):
    best = defaultdict(list)
    for i, html in rows:
        best[html or ""].append(i)
    most = {t: max((i for i in ids if i is not None), default=None) for t, ids in best.items()}
    return Counter((i, len((t or "").encode()), sha1((t or "").encode()), *(("response", None) if i == most[t or ""] else ("revisit", most[t or ""])), True) for i, t in rows)


def page_rows():
    texts = [None, "", "", "a", "héllo 😀", "WARC/1.1\r\n\r\n0\r\n\r\n", words(3000, 1), words(9000, 2), words(3000, 1), "<html>\r\n\r\n</html>", "b" * 70_000]
    rows = [(i, f"http://x/{i} ü%20\n", t) for i, t in enumerate(texts)] + [(4, None, "héllo 😀")] * 2 + [(None, "http://n", "n"), (None, "http://n", "a"), (None, None, None), (-7, "", "only")]
    return rows + [(100 + k, "u", "one of many " * 400) for k in range(200)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "d", 1) for i, u, h in rows], "page_id long, url string, html string, payload string, digest string, segment int").repartition(3)


@pytest.mark.parametrize("segment", [300, 5000, 16_384])
def test_archives(spark, segment):
    rows = page_rows()
    got = warc.archived(pages(spark, rows), segment=segment)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) for r in got.collect()) == archived_by_hand([(i, h) for i, _, h in rows])


def test_archives_hold_payloads_and_nothing(spark, tmp_path):
    rows, path = page_rows(), f"{tmp_path}/warc"
    warc.write_archives(pages(spark, rows), path, segment=1000, compression="gzip")
    back = warc.read_archives(spark, path, with_payload=True).collect()
    texts = {str(i): h for i, _, h in rows if i is not None}
    assert len(back) == len(rows) and all(r.complete for r in back)
    assert all(bytes(r.payload).decode() == (texts[r.page_id] or "") for r in back if r.record_type == "response" and r.page_id)
    assert {r.uri for r in back if r.page_id == "9"} == {"http://x/9%20%C3%BC%20%0A"}
    assert warc.archived(pages(spark, rows).where("false")).collect() == []


def test_damaged_segments(spark, tmp_path):
    """A segment that lacks, is there twice, or has a wrong number or length: the record is not complete; others are."""
    text = words(400, 3).encode()
    whole = list(warc.records_of(1, "u", text, 0, None, 500))
    assert len(whole) > 4
    cases = {
        "whole": whole, "turned": whole[::-1], "lacks": whole[:2] + whole[3:], "twice": [*whole, whole[2]], "no end": whole[:-1], "no start": whole[1:],
        "total": [re.sub(rb"Total-Length: \d+", b"Total-Length: 7", r) for r in whole], "digest": [r.replace(b"sha1:", b"sha1:A") for r in whole], "framing": [re.sub(rb"chunked\r\n\r\n.", b"chunked\r\n\r\n1", r) for r in whole],
    }
    for name, records in cases.items():
        raw = b"".join(r + b"\r\n\r\n" for r in records)
        for content in (raw, b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)):
            assert [b for _, b in warc.parsed(content)] == [r.partition(b"\r\n\r\n")[2] for r in records]
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        spark.createDataFrame([(raw[:-4],)], "v binary").select(F.col("v").cast("string")).write.option("lineSep", "\r\n\r\n").text(path)
        rows = warc.read_archives(spark, path, with_payload=True).collect()
        good = name in ("whole", "turned")
        assert [(r.complete, r.payload and bytes(r.payload), r.payload_bytes) for r in rows] == [(good, text if good else None, len(text) if good else None)], name


def test_dechunker():
    r = random.Random(4)
    for payload in (b"", b"x", bytes(r.randrange(256) for _ in range(5000))):
        message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n" + warc.chunked(payload, 700).replace(b"0\r\n\r\n", b"0;last=1\r\nTrailer: 1\r\n\r\n" if not payload else b"0\r\n\r\n")
        for step in (1, 3, 64, 10_000):
            d = warc.Dechunker()
            assert b"".join(x for i in range(0, len(message), step) for x in d.feed(message[i : i + step])) == payload and d.complete
        for bad in (message[:-1], message + b"x", message[5:]):
            d = warc.Dechunker()
            list(d.feed(bad))
            assert not d.complete
    d = warc.Dechunker()
    assert b"".join(d.feed(b"HTTP/1.0 200 OK\r\n\r\n5\r\nhello")) == b"5\r\nhello" and d.complete


# 13


def middle_by_hand(doc_id, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text or ""
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle(spark, monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("ab <P>SMé日😀\n\r7") for _ in range(r.randrange(60))) for _ in range(300)] + [words(4000, 8), "z" * 3000, "日" * 999, "<", "a<S", "a<S>", "<P>", ">", None]
    df = spark.createDataFrame([(i, t, "n", "o") for i, t in enumerate(texts)], "doc_id long, text string, n string, output string").unionByName(odd(spark).selectExpr("doc_id", "text", "row as n", "word as output"))
    rows = df.collect()
    want = Counter((x.doc_id, *middle_by_hand(x.doc_id, x.text)) for x in rows)
    out = written(fill_in_middle.transform(df), "t")
    got = out.collect()
    assert Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got) == want and {x.form for x in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert all(x.output_sha256 == sha(x.output) for x in got)
    assert Counter((x.doc_id, x.restored_sha256) for x in got) == Counter((x.doc_id, sha(x.text)) for x in rows)
    assert Counter((x.doc_id, x.restored) for x in fill_in_middle.restore(out).collect()) == Counter((x.doc_id, x.text or "") for x in rows)
    assert fill_in_middle.transform(empty(spark)).collect() == [] and "output" not in fill_in_middle.transform(empty(spark), with_output=False).columns


def test_cuts_of_long_texts(monkeypatch):
    """Slices of a long text give what one matrix gives, wherever runs and characters are cut."""
    r = random.Random(7)
    for most in (1, 2, 3, 7, 64):
        monkeypatch.setattr(fill_in_middle, "PASS_BYTES", most)
        for k in range(60):
            text = "".join(r.choice("aab é日😀") for _ in range(r.randrange(1, 90))).encode()
            h = fill_in_middle.draws([k])
            assert [x.tolist() for x in fill_in_middle._long_cuts(text, h)] == [x.tolist() for x in fill_in_middle._cuts([text], h)]


def test_wavelet_matrix():
    r = np.random.default_rng(8)
    for n, bits in ((0, 2), (1, 1), (63, 2), (64, 3), (1000, 4)):
        symbols = r.integers(0, 1 << bits, n).astype(np.uint8)
        matrix, at = fill_in_middle.WaveletMatrix(symbols, bits), np.arange(n + 1)
        for s in range(1 << bits):
            assert (matrix.rank(s, at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
