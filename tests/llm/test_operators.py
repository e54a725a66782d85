"""Each operator against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewise.llm import byte_bpe, chaining, components, exact_dedup, language_id, lm_scoring, mixing, progressive_jpeg, simhash, suffix_dedup, toxicity
from gaugewise.llm.common import released

from .fixtures import A, B, empty, odd, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    """The odd table as a file, as operators that read twice ask for."""
    import tempfile

    path = tempfile.mkdtemp() + "/odd"
    odd(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def everything(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def sha(x):
    return hashlib.sha256(x).hexdigest()


# 10


def test_exact(spark, table):
    rows = everything(table)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    for capacity in (1, 255):
        got = exact_dedup.exact_duplicates(table, capacity=capacity).collect()
        assert Counter((r.doc_id, r.digest.hex(), r.keep_id, r.group_size) for r in got) == Counter((i, sha(t.encode()), best[t], len(groups[t])) for i, t in rows)
        kept = [r for r in got if r.kept]
        assert Counter(r.digest.hex() for r in kept) == Counter(sha(t.encode()) for t in groups)
    clean = exact_dedup.deduplicated(table)
    assert clean.columns == table.columns and Counter(r.text or "" for r in clean.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_misra_gries():
    r = random.Random(3)
    keys = [bytes([min(int(r.expovariate(0.3)), 250)]) for _ in range(5000)]
    counts = {}
    for i in range(0, len(keys), 137):
        counts = exact_dedup.misra_gries(counts, Counter(keys[i : i + 137]), 8)
    true = Counter(keys)
    assert len(counts) <= 8 and all(k in counts for k, n in true.items() if n > len(keys) / 9)
    assert all(true[k] - len(keys) / 9 <= n <= true[k] for k, n in counts.items())


# 6


def simhash_by_hand(text, width=4):
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids_fps):
    parent = list(range(len(ids_fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids_fps)):
        for j in range(i):
            if bin(ids_fps[i][1] ^ ids_fps[j][1]).count("1") <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(ids_fps):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [(i, f, least[root(k)]) for k, (i, f) in enumerate(ids_fps)]


def test_simhash(spark, table, documents):
    assert simhash.fingerprint(A.encode()) == simhash_by_hand(A) and simhash.fingerprint(b" \t") == 0
    for df in (table, documents):
        rows = [(i, simhash_by_hand(t)) for i, t in everything(df)]
        got = simhash.simhash_components(df).collect()
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter(reach(rows))
        groups = defaultdict(int)
        for r in got:
            groups[r.component_id, r.fp if r.component_id is None else 0] += r.kept
        assert set(groups.values()) == {1}
    assert simhash.representatives(table).columns == table.columns
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_trie_finds_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 9), replace=False)) for b in base for _ in range(12)]
    dense = [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    fps = np.unique(np.array(fps + dense, np.uint64))
    rot, turned = [], []
    for r in range(5):
        by = np.uint64(sum(simhash.BLOCKS[:r]))
        rot.append(np.full(len(fps), r))
        turned.append(fps if not by else fps << by | fps >> (np.uint64(64) - by))
    out = simhash._links_of(np.concatenate(rot), np.concatenate(turned))
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
        assert bin((u ^ v) % (1 << 64)).count("1") >= 1
        parent[root(u % (1 << 64))] = root(v % (1 << 64))
    for i, f in enumerate(fps):
        for g in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ f) <= 4]:
            assert root(int(f)) == root(int(g))


def test_near_copies_against_exact_similarity(spark):
    """Texts with some words changed, and texts of one hot line: of pairs of 0.8 and more nearly all are found in each band, and no group is held together by less."""
    r = random.Random(11)
    texts = []
    for k in range(60):
        base = words(r.choice((60, 150, 400)), 500 + k).split()
        texts.append(" ".join(base))
        for share in (0.005, 0.015, 0.02, 0.025, 0.03, 0.04, 0.06):
            texts.append(" ".join("changed%d" % r.randrange(10**6) if r.random() < share else w for w in base))
    texts += [A * 40 + words(200, 900 + k) for k in range(6)] + ["", " ", "few words", "few words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.root for x in simhash.alike(df).collect()}
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) or {tuple(t.split())} for t in texts]
    found, near = defaultdict(list), defaultdict(set)
    for i, x in enumerate(sets):
        for j in range(i):
            similarity = len(x & sets[j]) / len(x | sets[j])
            if similarity >= 0.8:
                found[min(int(similarity * 20), 19)].append(got[i] == got[j])
                near[i].add(j)
                near[j].add(i)
    counts = {k: (sum(x), len(x)) for k, x in found.items()}
    assert set(found) == {16, 17, 18, 19}, counts
    assert all(n > 20 and k >= 0.9 * n for k, n in counts.values()), counts
    for group in set(got.values()):
        members = {i for i in got if got[i] == group}
        reached, todo = set(), [min(members)]
        while todo:
            i = todo.pop()
            if i not in reached:
                reached.add(i)
                todo += near[i] & members
        assert reached == members
    kept = simhash.representatives(df)
    assert kept.count() == len(set(got.values())) and simhash.alike(empty(spark)).count() == 0


def test_workers_give_memory_back():
    """What a task remembers is bounded and gone when it ends; its rows are as they were."""
    restorer = toxicity.Restorer(np.ones((toxicity.SYMBOLS,) * toxicity.ORDER))
    of = released(lambda batches: (b for b in batches if restorer.words("plain w0rds")), restorer.forget)
    batches = of(iter([1, 2]))
    assert next(batches) == 1 and restorer.clean
    assert list(batches) == [2] and not restorer.clean and not restorer.memory
    assert toxicity.COUNTED <= 100_000


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(parent) if root(x) != x}


# 7


def test_bpe(spark, table, documents):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    ranks = byte_bpe.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (table, documents.limit(60)):
        want = Counter()
        for i, t in everything(df):
            ids = lib.encode_ordinary(t)
            want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode(df, path=path).collect()) == want
    bpe = byte_bpe.load(path, public_tokenizers.PATTERN)
    text = "naïve 日本語 😀"
    ids = bpe.encode(text)
    assert bpe.decode(ids) == text and b"".join(text.encode()[a:b] for a, b, _, _ in bpe.offsets(text)) == text.encode()
    assert [text.encode()[a:b] for a, b, _, _ in bpe.offsets(text)] == [bpe.tokens[i] for i in ids] == [lib.decode_single_token_bytes(i) for i in ids]
    assert all(bpe.tokens[i].decode("utf-8", "ignore") in text[a:b] for i, (_, _, a, b) in zip(ids, bpe.offsets(text))) and bpe.offsets(text)[-1][3] == len(text)
    assert bpe.tokens == {r: t for t, r in ranks.items()}
    part = bpe.encode("😀")[:1]
    assert bpe.decode(part) == "�" and bpe.decode_chars(bpe.stand_in(text.encode())) == text.encode()
    full = byte_bpe.encode(table.where("doc_id = 1"), with_offsets=True).first()
    assert len(full.ids) == full.n_tokens == len(full.offsets) and full.offsets[-1].end == len(A * 3)
    assert byte_bpe.encode(empty(spark)).count() == 0


# 8


def repeats_by_hand(rows, length=50):
    first = {}
    rows = [(i, t.encode()) for i, t in rows]
    for i, t in rows:
        for k in range(len(t) - length + 1) if i is not None else ():
            first[t[k : k + length]] = min(first.get(t[k : k + length], i), i)
    out = Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1) if i is not None else ():
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(t), len(t) - len(kept), spans, sha(kept)] += 1
    return out


def test_suffix_array():
    rng = np.random.default_rng(0)
    for letters, n in ((1, 90), (2, 900), (5, 900), (200, 900)):
        t = rng.integers(30, 30 + letters, n).astype(np.uint8)
        raw = t.tobytes()
        order = suffix_dedup.two_stage_order(t)
        assert sorted(order.tolist()) == list(range(n))
        assert [raw[i : i + 64] for i in order] == sorted(raw[i : i + 64] for i in range(n))
        for k, m in enumerate(suffix_dedup.common_prefixes(t, order)):
            x, y = raw[order[k] :][:64], raw[order[k + 1] :][:64]
            assert m == next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_repeats(spark, table, documents):
    for df in (table, documents):
        got = suffix_dedup.remove_repeats(df).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats_by_hand(everything(df))
    one = suffix_dedup.remove_repeats(table, with_text=True).where("doc_id = 3").first()
    assert sum(s.end - s.start for s in one.spans) == one.n_removed and len(one.kept) == one.n_bytes - one.n_removed
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_long_texts_in_slices(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "LONG", 300)
    ends = np.array([200, 1500, 1500, 1600])
    assert [(s, e) for s, e, _ in suffix_dedup._passes(ends)] == [(0, 200), (200, 549), (500, 849), (800, 1149), (1100, 1449), (1400, 1500), (1500, 1600)]
    b = np.random.default_rng(0).integers(97, 100, 1600).astype(np.uint8)
    whole = suffix_dedup.entities(b, np.array([1600]))
    assert sum(int((x[2] - x[1] + 1).sum()) for x in [whole]) == 1551


# 1


def test_passages(spark, table):
    got = {r.doc_id: r for r in chaining.linked_documents(table).collect() if r.doc_id is not None}
    assert got[11].links == [10] or got[10].links == [11]
    both = got[11] if got[11].links else got[10]
    span = max(both.passages, key=lambda p: p.columns)
    assert 66 <= span.columns <= 76 and both.n_links == 1
    assert got[10].class_id == got[11].class_id == 10 and got[12].n_links == 0 and got[12].class_id == 12
    assert got[1].class_id == got[2].class_id == got[3].class_id and got[6].n_links == got[7].n_links == got[13].n_links == 0
    assert chaining.linked_documents(empty(spark)).count() == 0


def test_fuzzy_passages(spark):
    base = words(80, 1).split()
    rows = []
    for k, every in enumerate((0, 20, 12, 9)):
        own = [("zz" + w if every and i % every == every - 1 else w) for i, w in enumerate(base)]
        rows.append((k, words(60, 50 + k) + " " + " ".join(own) + " " + words(60, 70 + k)))
    rows += [(9, words(200, 90)), (10, words(200, 91))]
    got = {r.doc_id: r for r in chaining.linked_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [got[k].class_id for k in range(4)] == [0] * 4 and got[9].n_links == got[10].n_links == 0


def test_chain_is_the_best_one():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 12))
        a = np.sort(rng.integers(0, 40, n))
        b = rng.integers(0, 40, n)
        a, b = np.array(sorted(set(zip(a.tolist(), b.tolist())))).T

        def worth(chain):
            s = float(chaining.K)
            for p, q in zip(chain[:-1], chain[1:]):
                s += chaining.K - chaining.GAP * (a[q] - a[p] + b[q] - b[p])
            return s

        best = np.zeros(len(a))
        for i in range(len(a)):
            best[i] = chaining.K + max([best[j] - chaining.GAP * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if a[j] < a[i] and b[j] < b[i]] + [0])
        chains = chaining.best_chains(a, b)
        assert sorted(np.concatenate(chains).tolist()) == list(range(len(a)))
        assert worth(chains[0]) == pytest.approx(best.max())


def test_second_passage_after_a_long_one():
    """A near predecessor is taken where the best one is too far away."""
    first = np.arange(0, 200, 5)
    second = np.arange(300, 360, 5)
    chains = chaining.best_chains(np.concatenate((first, second)), np.concatenate((first, second)))
    assert sorted(map(len, chains)) == [len(second), len(first)]


def linked(spark, rows):
    return {r.doc_id: r for r in chaining.linked_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}


def test_parts_first_seen_elsewhere(spark):
    """A passage is found though its parts have other first owners, each of them too short for a passage."""
    passage = words(60, 900).split()
    own = lambda k: words(50, 910 + k)
    parts = [(1, f"{own(1)} {' '.join(passage[:28])} {own(2)}"), (2, f"{own(3)} {' '.join(passage[26:])} {own(4)}")]
    rows = parts + [(k, f"{own(2 * k)} {' '.join(passage)} {own(2 * k + 1)}") for k in range(3, 9)]
    got = linked(spark, rows)
    assert [got[k].class_id for k in range(1, 9)] == [1, 2] + [3] * 6
    assert all(any(p.columns >= 60 for p in got[k].passages) for k in range(4, 9))


def test_texts_in_rounds(spark, monkeypatch):
    """Texts of each block in a round of their own have the same links, and what the jobs exchange is gone when they end."""
    base = words(60, 31)
    rows = [(k, f"{words(40, 3100 + k)} {base if k % 3 else words(30, 32)} {words(40, 3200 + k)}") for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    show = lambda df: sorted((r.doc_id, r.class_id, r.n_links, r.n_words) for r in df.collect())
    want = show(chaining.linked_documents(df))
    assert [x[2] for x in want] == [0 if k % 3 == 0 else 15 for k in range(24)]
    names, written = [], chaining.written
    monkeypatch.setattr(chaining, "written", lambda df, name: names.append(name) or written(df, name))
    monkeypatch.setattr(chaining, "ROUND", 0)
    exchanged = lambda: {f for _, _, files in os.walk(spark.conf.get("spark.local.dir")) for f in files if f.startswith("shuffle_")}
    before = exchanged()
    out = chaining.linked_documents(df)
    assert exchanged() <= before
    assert show(out) == want and names.count("chaining-passages") == 4
    assert chaining._rounds([(2, 5), (1, 5), (3, 9), (4, 1)], 10) == [[1, 2], [3, 4]] and chaining._rounds([], 0) == [[]]


def test_fuzzy_passages_at_the_rule(spark):
    """Sixty words with every sixth, seventh or eighth changed: 83 to 88 % are equal."""
    rows, n = [], 0
    for every in (6, 7, 8):
        for k in range(10):
            base, n = words(60, 5000 + n).split(), n + 1
            own = [("zz" + w if i % every == every - 1 else w) for i, w in enumerate(base)]
            rows += [(2 * n, f"{words(50, 6000 + n)} {' '.join(base)} {words(50, 7000 + n)}"), (2 * n + 1, f"{words(50, 8000 + n)} {' '.join(own)} {words(50, 9000 + n)}")]
    got = linked(spark, rows)
    assert all(got[i].class_id == i // 2 * 2 for i in got)


def test_fuzzy_passages_first_seen_elsewhere(spark):
    """Eighty words with every sixth to ninth changed, whose words earlier texts have in stretches too short for a passage."""
    early, late = [], []
    for n in range(32):
        base, every = words(80, 20_000 + n).split(), 6 + n % 4
        early += [f"{words(20, 30_000 + 100 * n + i)} {' '.join(base[i : i + 14])} {words(20, 40_000 + 100 * n + i)}" for i in range(0, 80, 10)]
        own = [("zz" + w if i % every == every - 1 else w) for i, w in enumerate(base)]
        late += [f"{words(30, 50_000 + n)} {' '.join(base)}", f"{' '.join(own)} {words(30, 60_000 + n)}"]
    got = linked(spark, list(enumerate(early + late)))
    first = len(early)
    assert [got[first + 2 * n + 1].class_id for n in range(32)] == [first + 2 * n for n in range(32)]
    assert all(got[i].n_links == (i >= first) for i in got)


def test_all_links_against_every_pair(spark):
    """Classes and numbers of links by chaining all pairs: parts and fuzzy copies of a few passages, repeats within a text."""
    r = random.Random(5)
    bases = [words(n, 7000 + n).split() for n in (45, 80, 120)]
    rows = []
    for k in range(90):
        text = words(r.randrange(1, 60), 8000 + k).split()
        for _ in range(r.randrange(3)):
            base, every, start = r.choice(bases), r.choice((0, 6, 7, 9, 20)), r.randrange(30)
            part = base[start : start + 14] if r.random() < 0.3 else base
            text += [w for i, w in enumerate(part) if not every or i % every] if r.random() < 0.4 else [f"{w}{k}" if every and i % every == 0 else w for i, w in enumerate(part)]
        text += words(r.randrange(1, 30), 9000 + k).split()
        rows.append((k, " ".join(text * 2 if k % 10 == 0 else text)))
    known = {}
    for k, t in rows:
        x = chaining.word_hashes(t.encode()).astype(np.uint32) | np.uint32(1)
        h = chaining.seeds(x)[: max(len(x) - chaining.K + 1, 0)]
        known[k] = x, (np.sort(h), np.argsort(h, kind="stable"))
    links, group = Counter(), list(range(len(rows)))
    for i in known:
        for j in range(i):
            (x, _), (y, of) = known[i], known[j]
            a, b = chaining.matches(x, of)
            if any(len(c) > 1 and chaining.align(x, y, a[c], b[c]) for c in chaining.best_chains(a, b)):
                links.update((i, j))
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = linked(spark, rows)
    assert {i: got[i].n_links for i in got} == {i: links[i] for i in got} and sum(links.values()) > 400
    assert {i: got[i].class_id for i in got} == dict(enumerate(group))


def block_of(texts):
    raw = [(chaining.word_hashes(t.encode()).astype(np.uint32) | np.uint32(1)).tobytes() for t in texts]
    return chaining._Block(pa.table({"row": pa.array(range(len(raw)), pa.int64()), "doc_id": pa.array(range(len(raw)), pa.int64()), "block": pa.array([0] * len(raw), pa.int64()), "words": pa.array(raw, pa.binary())}))


def met(texts):
    """Points of pairs of texts in one block, as they are sent."""
    kinds = [np.uint32, np.uint32, np.uint16, np.uint8, np.uint32, np.uint32, np.uint32, np.uint32, np.uint64]
    (_, _, *columns), = chaining._Seeds(block_of(texts), 1).records()
    columns = [np.frombuffer(x, kind) for x, kind in zip(columns, kinds)]
    columns[1] = columns[1].astype(np.int64)
    return chaining._paired(chaining._meeting(*columns)[0])


def test_one_short_run_makes_no_pair():
    """A line of very many texts and one equal word before or after it, or two lines far apart, are no passage; a fuzzy one is, and its words are sent alone."""
    line, far = words(14, 1), [words(7, 2), words(7, 3)]
    texts = [f"{words(60, 100 + k)} only{k % 5} {line} then{k % 7} {words(60, 1000 + k)}" for k in range(chaining.MANY + 40)]
    texts += [f"{far[0]} {words(300, 2000 + k)} {far[1]} {words(200, 2100 + k)}" for k in range(20)]
    base, n = words(60, 9).split(), len(texts)
    texts += [f"{words(400, 3000)} {' '.join(base)} {words(500, 3001)}", f"{words(90, 3002)} {' '.join('zz' + w if i % 9 == 8 else w for i, w in enumerate(base))}"]
    points, sure = met(texts)
    assert set(zip(points[:, 0].tolist(), points[:, 1].tolist())) == {(n + 1, n)} and not sure.any()
    own = chaining._around(960, points[:, 4], np.empty(0, np.int64))
    assert own[400 - chaining.BEYOND : 460 + chaining.BEYOND].all() and own.sum() < 300
    assert not own[:300].any() and chaining._around(960, points[:, 4], np.array([300, 330, 370, 700]))[270:400].all()


def test_passage_of_many_texts(spark):
    """More texts with a passage than are paired with each other: every link is counted."""
    n = chaining.MANY + 40
    rows = [(k, f"{words(9, 100 + k)} {words(60, 1)} {words(9, 9000 + k)}") for k in range(n)] + [(n, words(80, 3))]
    got = linked(spark, rows)
    assert {(got[k].n_links, got[k].class_id) for k in range(n)} == {(n - 1, 0)} and got[n].n_links == 0


def test_second_place_of_seeds():
    """A passage is found where the other text has its seeds before, in another order."""
    x = np.arange(1, 61, dtype=np.uint32) * 2 + 1
    y = np.concatenate([x[i : i + 6] for i in range(54, -1, -6)] + [x])
    h = chaining.seeds(y)[: len(y) - chaining.K + 1]
    a, b = chaining.matches(x, (np.sort(h), np.argsort(h, kind="stable")))
    assert any(chaining.align(x, y, a[c], b[c]) == (0, 60, 60, 120, 60, 60) for c in chaining.best_chains(a, b))


# 2


def by_hand(lattice, word):
    """The probability of a word by kind, without logarithms."""
    known, f = lattice.known, len(lattice.known.first)
    paths = {0: np.exp(lattice.log[0])}
    for j in range(1, len(word) + 1):
        total = np.zeros(lattice.log.shape[1])
        if word[:j] in known.first:
            total += np.exp(lattice.log[known.first[word[:j]]])
        for i in range(j):
            if word[i:j] in known.later:
                total += paths[i] * np.exp(lattice.log[f + known.later[word[i:j]]])
        paths[j] = total
    return paths[len(word)] * np.exp(lattice.end)


def test_lattice_sums_all_segmentations():
    known = lm_scoring.pieces(byte_bpe.vocabulary_path(lm_scoring.VOCABULARY))
    assert "▁С"[1:].encode() in known.first and b"the" in known.first and b"T" not in known.first
    rng = np.random.default_rng(0)
    lattice = lm_scoring.Lattice(known, rng.random((len(known.first), 2)) + 0.01, rng.random((known.end + 1, 2)) + 0.01)
    words_ = [b"the", b"stings", "über".encode(), b"\x00\xff", b"a" * 40, b"x", b"-" * 70, b"the", "Стой".encode()]
    for word, got in zip(words_, lattice.log_p(words_)):
        assert np.allclose(got, np.log(by_hand(lattice, word)))
    assert lattice.log_p([]).shape == (0, 2)
    n = lattice.expected(words_[:4], 1)  # an expected count is how the log probability follows the log weight
    for i in np.flatnonzero(n > 1e-3):
        more = lattice.log.copy()
        more[i] += 1e-4
        assert n[i] == pytest.approx((lm_scoring.Lattice.of(known, more).log_p(words_[:4]).sum(axis=0) - lattice.log_p(words_[:4]).sum(axis=0))[1] / 1e-4, rel=1e-2, abs=1e-3)


def test_lm_is_the_marginal_of_whole_documents(spark, table):
    """Scores against a plain sum over kinds of products over tokens of sums over segmentations and whole words."""
    from gaugewise.llm.common import crc_mod

    df = table.where(F.length("text") < 3000)
    names = sorted({r.lang or "" for r in df.where(crc_mod(F.col("doc_id"), 10) != 0).select("lang").collect()})
    base = df.select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.coalesce("lang", F.lit(""))) - 1, F.lit(0)).cast("int").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    model, words_, _, _ = lm_scoring.train(base, names, byte_bpe.vocabulary_path(lm_scoring.VOCABULARY))
    counts = {bytes(r.word): np.array(r.c, float) for r in words_.collect()}
    lattice = lm_scoring.Lattice.of(lm_scoring.pieces(model.path), model.log)
    of = {}
    for w, c in counts.items():
        kept = np.maximum(c - model.discount, 0) / np.maximum(model.words, 1) + model.left * model.shared * c.sum() / max(model.words.sum(), 1)
        of[w] = (1 - model.end) * (kept + model.left * (1 - model.shared) * by_hand(lattice, w))
    assert all((sum(x for w, x in of.items() if counts[w].sum()) + model.end < 1 + 1e-9).tolist())
    want = Counter()
    for i, t in everything(df):
        by_kind = [math.log(p) + math.log(e) + sum(math.log(of[w][k]) for w in t.encode().lower().split()) for k, (p, e) in enumerate(zip(model.prior, model.end))]
        want[str(i), round((max(by_kind) + math.log(sum(math.exp(x - max(by_kind)) for x in by_kind))) / math.log(10), 4)] += 1
    assert Counter((str(r.doc_id), round(r.score, 4)) for r in lm_scoring.score(df).collect()) == want


def test_lm(spark, table, documents):
    for df in (table, documents):
        rows = everything(df)
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        tokens = lambda t: [*t.encode().lower().split(), None]
        c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 5)) for i, t in rows)
        got = lm_scoring.score(df).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 1.05
    assert lm_scoring.score(empty(spark)).count() == 0


# 3, 5


def test_toxicity(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    insults = ["idiot", "moron"]
    clean = [(1000 + i, words(60, i), 0) for i in range(120)]
    bad = [(2000 + i, words(30, 500 + i) + f" {insults[i % 2]} " + words(30, 700 + i), 1) for i in range(60)]
    hidden = [(3000, words(20, 1) + " m0r0n " + words(9, 2), None), (3001, words(9, 3) + " m o r o n " + words(9, 4), None), (3002, "you mooooron", None), (3003, words(30, 5), None), (3004, None, None), (None, "", None)]
    df = spark.createDataFrame([(i, t) for i, t, _ in clean + bad + hidden], "doc_id long, text string")
    own = spark.createDataFrame([(i, y) for i, _, y in clean + bad] + [(None, 1), (1000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, own, with_text=True).collect()}
    assert all(got[i].predicted == y for i, _, y in clean + bad)
    assert [got[i].predicted for i in (3000, 3001, 3002, 3003, 3004, None)] == [1, 1, 1, 0, 0, 0]
    assert " moron " in got[3001].restored and got[3000].score > 0.5 and 0 <= got[3004].score < 0.5
    kept = toxicity.without_toxic(df, own)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    none = toxicity.score(empty(spark), labels)
    assert none.count() == 0 and none.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert {r.score for r in toxicity.score(df, own.limit(0)).collect()} == {0.0}
    for labels_ in (own.limit(0), own.where("toxic = 1"), own.where("toxic = 0")):
        assert toxicity.without_toxic(df, labels_).count() == df.count()
    odd_labels = spark.createDataFrame([(i, i % 2) for i in range(16)], "doc_id long, toxic int")
    rows = toxicity.score(odd(spark), odd_labels).collect()
    assert len(rows) == odd(spark).count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({(r.score, r.predicted) for r in rows if r.doc_id == 9}) == 1 and toxicity.without_toxic(odd(spark), odd_labels).columns == odd(spark).columns
    assert toxicity.without_toxic(empty(spark), odd_labels).count() == 0


def test_fit_is_not_led_by_copies(spark):
    """A word that tells in all toxic texts is weighed, those of a text with many near copies are not, on either side."""
    rows = []
    for i in range(400):
        rows.append((f"{words(40, i)} {'idiot ' if i % 4 == 0 else ''}{words(40, 1000 + i)}", int(i % 4 == 0)))
    copied, other = words(60, 5000), words(60, 5001)
    rows += [(f"{copied} {words(3, 6000 + i)}", 0) for i in range(600)] + [(f"{other} idiot {words(3, 7000 + i)}", 1) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(9001, f"{other} {words(9, 1)}"), (9002, f"{copied} 1d10t {words(9, 2)}")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")).collect()}
    assert sum(got[i] == y for i, (_, y) in enumerate(rows)) >= 0.99 * len(rows) and got[9002] == 1


def test_decoder(spark):
    """Against all ways through the channel, one by one; and every form of obfuscation reaches it."""
    from itertools import groupby, product

    prose = [("you idiot are a moron and an ass with shit on the street of the good books " + w) for w in ("idiot", "moron", "shit", "ass", "all", "good")] * 40
    restorer = toxicity.Restorer(toxicity.char_counts(spark.createDataFrame([(p,) for p in prose], "text string")))

    def cost(text):
        state, total = 0, 0.0
        for c in [*(ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27 for x in text), 0]:
            total += float(restorer.cost[state * toxicity.SYMBOLS + c])
            state = (state * toxicity.SYMBOLS + c) % toxicity.SYMBOLS ** (toxicity.ORDER - 1) if c else 0
        return total

    for noisy in ("1d10t", "m.o.r0n", "sh1t", "iddiot", "goood", "4$$", "a l l", "mmorron", "!diot", "b00ks"):
        options = [restorer.options(c, len(list(run))) for c, run in groupby(noisy)]
        ways = [("".join(t for t, _ in way), sum(c for _, c in way)) for way in product(*options)]
        best = min(cost(t) + c for t, c in ways)
        got = restorer.word(noisy)
        assert any(t.strip() == got and cost(t) + c < best + 1e-3 for t, c in ways)
    for noisy, want in (("1d10t!", "idiot!"), ("(m0r0n)", "(moron)"), ("iddiot", "idiot"), ("mmorron", "moron"), ("455", "ass"), ("4$$", "ass"), ("!diot", "idiot"), ("shi+", "shit"), ("good", "good"), ("sh.i.t", "shit"), ("12345678", "12345678"), ("2026", "2026"), ("a@b.de", "a@b.de")):
        assert restorer.text(f"the {noisy} of") == f"the {want} of"
    assert [restorer.text(t) for t in ("you m o r o n now", "you m - o - r - o - n", "you a s s", "1 2 3 4")] == ["you moron now", "you moron", "you ass", "1 2 3 4"]


def test_language(spark, table, documents):
    got = language_id.identify(documents).withColumnRenamed("doc_id", "i").join(documents, F.col("i") == F.col("doc_id"))
    assert got.where("held_out").selectExpr("avg(int(lang = lang_pred))").first()[0] > 0.97
    rows = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert [rows[i].lang_pred for i in (6, 7, 8, 15)] == ["und"] * 4 and rows[6].score == 0
    assert rows[1].lang_pred == "en" and rows[4].lang_pred == "de" and all(0 <= r.score <= 1 for r in rows.values())
    assert language_id.identify(empty(spark)).count() == 0
    unlearned = language_id.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_codes_against_a_direct_sum(spark, table):
    """Scores of texts by plain loops over their n-grams; one language; slices of a long text."""
    texts = {"en": A, "de": B, "xx": words(200, 3)}
    counts = np.zeros((3, language_id.BUCKETS))
    for i, t in enumerate(texts.values()):
        for m in language_id.grams([t])[0]:
            counts[i] += np.bincount(m, minlength=language_id.BUCKETS)[: language_id.BUCKETS]
    model = language_id.OutputCodes(list(texts), counts)
    long = (A + B) * 3000
    probes = [A[:60], B[5:90], words(20, 4), "a", long]
    best, share, _ = model.predict(probes)
    for t, b, s in zip(probes, best, share):
        margin = np.zeros(model.code.shape[1])
        for m in language_id.grams([t])[0]:
            n = np.bincount(m, minlength=language_id.BUCKETS)
            margin += n[: language_id.BUCKETS] @ model.ratio.astype(float)
        margin = np.clip(margin / 3, -30, 30)
        loss = (np.log1p(np.exp(-margin * model.code)) * model.weight).sum(axis=1) / model.weight.mean()
        want = np.exp(-loss) / np.exp(-loss).sum()
        assert b == want.argmax() and s == pytest.approx(want.max(), rel=1e-3)
    one = language_id.identify(table.withColumn("lang", F.lit("en"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0), ("und", 0.0)}


def test_codewords():
    for n in (2, 3, 4, 5, 9):
        code = language_id.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert len(code) == n and apart[~np.eye(n, dtype=bool)].min() >= 1 + (n > 3)


# 4


def water_fill(sizes, weights, limit=3):
    total, capped, target = sum(sizes), set(), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        room = total - sum(limit * sizes[i] for i in capped)
        target = {i: limit * sizes[i] for i in capped} | {i: room * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if target[i] > limit * sizes[i]}
        if not over:
            return target
        capped |= over


def test_mixing(spark, table, documents):
    for df in (table, documents, documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.col("source")))):
        rows = [(r.doc_id, len((r.text or "").encode().split()), r.source) for r in df.collect()]
        names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
        sizes = [sum(n for _, n, s in rows if s == name) for name in names]
        target = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
        slots, out = mixing.mix(df)
        got = out.collect()
        assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, n, sizes[names.index(s)]) for i, n, s in rows)
        assert all(r.target == pytest.approx(target[names.index(r.source)]) and r.taken <= 3 * r.size for r in got)
        for k, name in enumerate(names):
            taken = sum(r.taken for r in got if r.source == name)
            assert abs(taken - target[k]) <= 2 * mixing.BLOCK
        again = mixing.mix(df.repartition(5))[1].collect()
        assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
        assert slots.groupBy("shard").agg(F.count("*").alias("n")).where(f"n > {mixing.SHARD}").count() == 0
        other = mixing.mix(df, seed=8)[1].collect()  # of the odd table all sources are at their limits
        assert (Counter((r.doc_id, r.taken) for r in other) == Counter((r.doc_id, r.taken) for r in got)) == (df is table)
    drawn_again = mixing.mix(documents, draw=8)[1].collect()  # another draw alone: other blocks, the same totals but for blocks that are not full
    first = mixing.mix(documents)[1].collect()
    assert sum(a != b for a, b in zip(*(sorted((r.row, r.taken) for r in x) for x in (first, drawn_again)))) > len(first) / 10
    for name in {r.source for r in first}:
        a, b = (sum(r.taken for r in x if r.source == name) for x in (first, drawn_again))
        assert abs(a - b) <= 2 * mixing.BLOCK
    assert mixing.repeated(documents).columns == documents.columns
    assert mixing.mix(empty(spark))[1].count() == 0


def test_draws_are_multinomial_and_totals_hold(spark):
    """Many small shards: counts by shard stray as draws do, and each source's slots are whole passes over its blocks and a part of one."""
    shares = spark.createDataFrame([("a", 500, 1300), ("b", 40, 90), (None, 700, 610), ("c", 9, 0), ("d", 3, 9)], "source string, blocks long, uses long")
    rows = mixing.drawn(shares, 3, 16).collect()
    n = 1300 + 90 + 610 + 9
    by_shard = Counter(r.shard for r in rows)
    assert len(rows) == n and set(by_shard) == set(range(-(-n // 16))) and all(by_shard[s] == 16 for s in range(n // 16))
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(by_shard[s])) for s in (0, 7, max(by_shard)))
    assert Counter(r.source for r in rows) == {"a": 1300, "b": 90, None: 610, "d": 9}
    for source, blocks, uses in (("a", 500, 1300), ("b", 40, 90), (None, 700, 610), ("d", 3, 9)):
        times = Counter(r.block for r in rows if r.source == source)
        assert set(times) <= set(range(blocks)) and set(times.values()) <= {uses // blocks, -(-uses // blocks)} and sum(times.values()) == uses
    of_a = list(Counter(r.shard for r in rows if r.source == "a").values())
    p = 1300 / n
    assert 0.6 < np.var(of_a) / (16 * p * (1 - p)) < 1.6
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.drawn(shares, 3, 16).collect())) != Counter(map(tuple, mixing.drawn(shares, 4, 16).collect()))
    assert mixing.drawn(shares.limit(0), 3).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1023):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("key"))).collect()]
        assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


# 9


def test_media(spark, table, documents):
    for df in (table, documents.limit(40)):
        rows = everything(df)
        got = progressive_jpeg.media(df, with_media=True).collect()
        by = {r.payload_sha256: r for r in got}
        want = Counter()
        for i, t in rows:
            raw = t.encode()
            pay = raw + b" " * (-len(raw) % 192 if raw else 192)
            want[i, len(raw), len(pay), sha(pay), zlib.crc32(pay[-16:])] += 1
            r = by[sha(pay)]
            assert len(r.media) == r.media_bytes and sha(r.media) == r.media_sha256
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        assert len({(r.payload_sha256, r.feature, r.media_sha256) for r in got}) == len(by)
    assert progressive_jpeg.media(empty(spark)).count() == 0
    made = progressive_jpeg.media(table.where("doc_id in (1, 9)"), with_media=True)
    t = progressive_jpeg.tensors(made.unionByName(made.limit(1).withColumn("media", F.lit(b"no image"))), "doc_id", "media").collect()
    assert any(r.rgb is None for r in t) and all(len(r.rgb) == r.height * r.width * 3 for r in t if r.rgb is not None)


def test_images_with_sampling_and_restarts():
    y, x = np.mgrid[0:37, 0:53]
    rgb = np.stack((120 + 80 * np.sin(x / 9), y * 4, 128 + 60 * np.cos((x + y) / 7)), -1).astype(np.uint8)
    for sampling in (((1, 1),) * 3, ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))):
        for interval in (0, 1, 3):
            a, b = progressive_jpeg.decode([progressive_jpeg.encode(rgb, sampling, 3, interval), progressive_jpeg.encode(rgb[:20, :11], sampling, 3, interval)])
            assert np.abs(a.astype(int) - rgb).mean() < 3 and b.shape == (20, 11, 3)


def test_sparse_coefficients():
    rng = np.random.default_rng(1)
    image = progressive_jpeg.Image(50, 40, [(2, 2), (1, 1), (1, 1)], [1, 2, 3])
    blocks = [np.where(rng.random((image.grid(c)[0] * image.grid(c)[1], 64)) < 0.1, rng.integers(-60, 60, (image.grid(c)[0] * image.grid(c)[1], 64)), 0) for c in range(3)]
    got = progressive_jpeg.coefficients([progressive_jpeg.parse(progressive_jpeg.encode_blocks(image, blocks, b"\1" * 64, 2))[0]])[0]
    for c in range(3):
        own = np.zeros(image.grid(c), bool)
        own[: image.own(c)[0], : image.own(c)[1]] = True
        assert (got[c][own.ravel()] == blocks[c][own.ravel()]).all()


def test_vector_writer_agrees_with_the_plain_one():
    raw = np.random.default_rng(2).integers(0, 256, (3, 4, 64))
    value = np.where(raw >= 128, raw, raw - 255)
    image = progressive_jpeg.Image(48, 8, list(progressive_jpeg.SAMPLING), [1, 2, 3])
    plain = progressive_jpeg.encode_blocks(image, [value[:, :2].reshape(-1, 64), value[:, 2], value[:, 3]], b"\1" * 64, 1)
    comment = b"\xff\xfe\0\4" + (12).to_bytes(2, "big")
    assert progressive_jpeg.store([raw.astype(np.uint8).tobytes()])[0].replace(comment, b"") == plain


def test_feature_is_of_the_upsampled_tensor(spark):
    """Feature and tensor against a direct inverse transform, block by block, of the payload."""
    text = words(300, 8)
    r = progressive_jpeg.media(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_tensor=True).first()
    raw = text.encode()
    raw += b" " * (-len(raw) % 192)
    raw += b"\x80" * (-len(raw) % 256)
    k, x = np.mgrid[0:8, 0:8]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) / 2 * np.where(k == 0, 1 / np.sqrt(2), 1)
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))

    def block(b):
        f = np.zeros((8, 8))
        for (i, j), v in zip(order, b):
            f[i, j] = v if v >= 128 else int(v) - 255
        return np.clip(np.floor(basis.T @ f @ basis + 128.5 + 1e-7), 0, 255)

    rows = []
    for m in range(0, len(raw), 256):
        y0, y1, cb, cr = (block(raw[m + 64 * i : m + 64 * i + 64]) for i in range(4))
        y, cb, cr = np.hstack((y0, y1)), np.repeat(cb, 2, axis=1) - 128, np.repeat(cr, 2, axis=1) - 128
        rows.append(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=-1))
    want = np.clip(np.floor(np.concatenate(rows, axis=1) + 0.5 + 1e-7), 0, 255).astype(np.uint8)
    got = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
    assert got.shape == want.shape and (got == want).all()
    assert [float(v) for v in r.feature.split(",")] == pytest.approx(want.reshape(-1, 3).mean(axis=0).tolist(), abs=1e-3)
