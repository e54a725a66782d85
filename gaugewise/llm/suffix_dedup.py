"""Suffix-array deduplication: bytes covered by long strings that an earlier document has too."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gaugewise.llm.common import arrow_of, id_and_text, in_blocks, schema_of, text_bytes, written

#: A string of so many bytes is a repeat.
LENGTH = 50
#: Bytes of an anchor; each window of LENGTH bytes has one, the place in it whose hash is least.
ANCHOR = 8
#: Bytes on one side of an anchor, so that a window holds them on its left or on its right.
SIDE = (LENGTH - ANCHOR) // 2
#: Bytes of text in a block, in a pass over it, and in a slice of a longer text.
BLOCK_BYTES, PASS, LONG = 16_000_000, 1_000_000, 8_000_000
#: Bytes of distinct surroundings that one suffix array is built over.
SORTED = 1_500_000
_M = np.uint64(0x9E3779B97F4A7C15)


def words8(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, first byte highest; zeros beyond the end."""
    w = np.concatenate((b, np.zeros(8, np.uint8))).astype(np.uint64)
    w = w[:-1] << np.uint64(8) | w[1:]
    w = w[:-2] << np.uint64(16) | w[2:]
    return (w[:-4] << np.uint64(32) | w[4:])[: len(b)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def entities(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a pass of texts (bytes one after the other, with their ends) holds: hash, first and last window of each entity.

    A window is the LENGTH bytes from a place on, within one text. The windows with one anchor are parted in those that
    have SIDE bytes to the anchor's left, and the others, which have as many to its right. Such a part is an entity;
    its hash is of the anchor and the bytes on that side. Equal windows are in entities of equal hashes.
    """
    n = len(b)
    if n < LENGTH:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2)
    w = words8(b)
    key = _mixed(w) >> np.uint64(24) << np.uint64(24) | np.arange(n, dtype=np.uint64)
    least = key[: n - ANCHOR + 1]
    span, want = 1, LENGTH - ANCHOR + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)  # the anchor of the window from each place on
    whole = np.zeros(len(at) + 1, np.int8)
    starts = np.concatenate(([0], ends[:-1]))
    long = ends - starts >= LENGTH
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - LENGTH + 1, -1)
    place = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8))
    anchor = at[place]
    right = place > anchor - SIDE
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (right[1:] != right[:-1])
    i = np.flatnonzero(new)
    first, last = place[i], place[np.append(i[1:], len(place)) - 1] if len(i) else place[:0]
    p, r = anchor[i], right[i]
    base = np.where(r, p, p - SIDE)  # ANCHOR + SIDE = 29 bytes from here
    h = _mixed(w[base] + r.astype(np.uint64))
    for off in (8, 16, ANCHOR + SIDE - 8):
        h = _mixed(h ^ w[base + off])
    return h, first, last


def two_stage_order(text: np.ndarray, depth: int = 64) -> np.ndarray:
    """The suffix array of a byte array, in order of the first `depth` bytes at least.

    Only the suffixes smaller than their successors are sorted by their bytes. The others follow from a scan of the
    buckets of first bytes from the least on: each place in order puts its predecessor, if that one is of the other
    kind, at the next free place of the predecessor's bucket.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    decided = np.where(step != 0, np.arange(n), n - 1)
    larger = step[np.minimum.accumulate(decided[::-1])[::-1]] < 0  # than its successor
    w = words8(np.concatenate((text, np.zeros(depth, np.uint8))))
    order = np.flatnonzero(~larger)
    order = order[np.argsort(w[order], kind="stable")]
    if len(order) > 1:
        head = np.ones(len(order), bool)
        head[1:] = w[order[1:]] != w[order[:-1]]
        for off in range(8, depth, 8):
            tied = ~head
            tied[:-1] |= ~head[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            group = np.cumsum(head)[at]
            key = w[order[at] + off]
            resorted = np.lexsort((key, group))
            order[at], key, group = order[at][resorted], key[resorted], group[resorted]
            head[at[1:]] |= key[1:] != key[:-1]
    sorted_by = np.split(order, np.searchsorted(text[order], np.arange(1, 256)))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[text[-1]].append(np.array([n - 1]))
    out = []
    for c in np.unique(text).tolist():
        wave = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        bucket = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & larger[before]]
            bucket.append(wave)
        whole = np.concatenate([*bucket, sorted_by[c]])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        if len(before):
            by = text[before]
            before = before[np.argsort(by, kind="stable")]
            chars, n_each = np.unique(by, return_counts=True)
            for ch, part in zip(chars.tolist(), np.split(before, np.cumsum(n_each)[:-1])):
                pending[ch].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = 64) -> np.ndarray:
    """For each place of a suffix array but the first, how many bytes it has in common with the one before, `most` at most."""
    w = words8(np.concatenate((text, np.zeros(most, np.uint8))))
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    at = np.arange(len(a))
    for off in range(0, most, 8):
        x = w[a[at] + off] ^ w[b[at] + off]
        same = np.zeros(len(x), np.int8)
        for k in range(8):  # leading bytes that agree
            same += x < np.uint64(1 << 8 * k)
        out[at] += same
        at = at[x == 0]
        if not len(at):
            break
    return np.minimum(np.minimum(out, most), len(text) - np.maximum(a, b))


def least_owners(contexts: list[bytes], windows: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of each context (the first `windows` places of it), the least document that has that window."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)  # 0xff is in no UTF-8 text
    owner = np.repeat(np.arange(len(contexts)), sizes)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    is_window = inner < windows[owner]
    order = two_stage_order(text)
    head = np.ones(len(order), bool)
    head[1:] = common_prefixes(text, order) < length
    keep = is_window[order]
    group = np.cumsum(head)[keep]
    place = order[keep]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(docs[owner[place]], starts)
    out = np.empty(len(text), np.int64)
    out[place] = np.repeat(least, np.diff(np.append(starts, len(place))))
    return out[is_window]


# Spark


def _passes(ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices of a block's bytes with the ends of the texts in them; a very long text is taken in slices that overlap."""
    starts = np.concatenate(([0], ends[:-1]))
    i = 0
    while i < len(ends):
        if ends[i] - starts[i] > LONG:
            for s in range(int(starts[i]), int(ends[i]), LONG):
                e = min(int(ends[i]), s + LONG + LENGTH - 1)
                yield s, e, np.array([e - s])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PASS, "right")))
        long = np.flatnonzero(ends[i:j] - starts[i:j] > LONG)
        j = i + int(long[0]) if len(long) else j
        yield int(starts[i]), int(ends[j - 1]), ends[i:j] - starts[i]
        i = j


class _Block:
    """The texts of a block as bytes; those without an id have no part in repeats."""

    def __init__(self, texts: pa.Table):
        self.ids = texts.column("doc_id")
        ids = self.ids.cast(pa.int64())
        self.known = np.array(ids.is_valid())
        self.doc = pc.fill_null(ids, 0).to_numpy()
        self.texts = [t for chunk in texts.column("text").chunks for t in text_bytes(chunk)]
        self.bytes = np.frombuffer(b"".join(t if k else b"" for t, k in zip(self.texts, self.known)), np.uint8)
        self.ends = np.cumsum([len(t) if k else 0 for t, k in zip(self.texts, self.known)])

    def entities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for s, e, ends in _passes(self.ends):
            h, first, last = entities(self.bytes[s:e], ends)
            found.append((h, first + s, last + s))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2)


def _batch(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), types)], names)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept: bytes, with_text).

    A byte goes if a string of LENGTH bytes covers it that also starts in a text with a smaller id; all strings are
    those of the input. Ids are whole numbers, and the order of rows does not matter; a text with a null id neither loses bytes nor makes others lose any,
    and so do rows of one id among each other. Null counts as the empty text. Spans are maximal removed runs. What is
    left may begin or end within a character. Long texts are taken whole, slice by slice where hashes are made. Other
    columns of df are not looked at. An empty table gives an empty one.

    Texts are written once, in blocks, to a table bucketed by block, so that no later step shuffles them. First the
    hashes of what the windows are anchored on are compared, four bytes each, once a block; then the surroundings of
    the anchors that occur twice go to their hash's task, once a block, where a suffix array over them finds the equal
    windows and their least document.
    """
    spark = df.sparkSession
    base = id_and_text(df, id_col, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    by_block = lambda df: df.groupBy("block")

    def hashes(texts: pa.Table) -> pa.Table:
        h = np.unique(_Block(texts).entities()[0])
        part = (h % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        h, part = h[order], part[order]
        at = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), part[1:] != part[:-1])))
        block = texts.column("block")[0].as_py()
        rows = [(int(part[a]), block, (x // np.uint64(parts)).astype(np.uint32).tobytes()) for a, x in zip(at, np.split(h, at[1:]))] if len(h) else []
        return _batch(["part", "block", "hashes"], rows, [pa.int32(), pa.int64(), pa.binary()])

    def shared(sent: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint32) for x in sent.column("hashes").to_pylist()]
        _, place, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        twice = np.split(times[place] > 1, np.cumsum([len(x) for x in each])[:-1])
        rows = [(b, p, np.packbits(t).tobytes()) for b, p, t in zip(sent.column("block").to_pylist(), sent.column("part").to_pylist(), twice) if t.any()]
        return _batch(["block", "part", "twice"], rows, [pa.int64(), pa.int32(), pa.binary()])

    def surroundings(texts: pa.Table, told: pa.Table) -> pa.Table:
        names, types = ["chunk", "block", "hash", "doc", "windows", "times", "places", "bytes"], [pa.int32(), pa.int64(), *(pa.binary(),) * 6]
        if not len(texts):
            return _batch(names, [], types)
        block = _Block(texts)
        h, first, last = block.entities()
        own, place, times = np.unique(h, return_inverse=True, return_counts=True)
        part = (own % np.uint64(parts)).astype(np.int64)
        yes = times > 1
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p, bits in zip(told.column("part").to_pylist(), told.column("twice").to_pylist()):
            at = order[ends[p] : ends[p + 1]]
            yes[at] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
        keep = yes[place]
        h, first, last = h[keep], first[keep], last[keep]
        raw = block.bytes.tobytes()
        same: dict[tuple[int, bytes], list[int]] = {}
        for i, (x, a, b) in enumerate(zip(h.tolist(), first.tolist(), (last + LENGTH).tolist())):
            same.setdefault((x, raw[a:b]), []).append(i)
        doc = block.doc[np.searchsorted(block.ends, first, "right")]
        by_chunk: dict[int, list[tuple[int, bytes, list[int]]]] = {}
        for (x, c), at in same.items():
            by_chunk.setdefault(x % chunks, []).append((x // chunks & 0xFFFFFFFF, c, at))
        rows = []
        number = texts.column("block")[0].as_py()
        for k, members in by_chunk.items():
            members.sort(key=lambda m: m[0])
            flat = np.array([i for m in members for i in m[2]])
            n_each = np.array([len(m[2]) for m in members])
            least = np.minimum.reduceat(doc[flat], np.cumsum(n_each) - n_each)
            rows.append((k, number, np.array([m[0] for m in members], np.uint32).tobytes(), least.tobytes(), np.array([len(m[1]) - LENGTH + 1 for m in members], np.uint8).tobytes(), n_each.astype(np.uint32).tobytes(), first[flat].astype(np.uint32).tobytes(), b"".join([m[1] for m in members])))
        return _batch(names, rows, types)

    def owners(sent: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(x, t) for x in sent.column(c).to_pylist()]
        hs, docs, wins, times, places = read("hash", np.uint32), read("doc", np.int64), read("windows", np.uint8), read("times", np.uint32), read("places", np.uint32)
        which = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        h, doc, win = np.concatenate(hs), np.concatenate(docs), np.concatenate(wins).astype(np.int64)
        raw = sent.column("bytes").to_pylist()
        size = win + LENGTH - 1
        end_in = np.concatenate([np.cumsum(x.astype(np.int64) + LENGTH - 1) for x in wins])
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1], [True])))
        filled = np.cumsum(size[order])
        runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first window, windows, least document, of all distinct surroundings
        first_run, n_runs, lowest = (np.zeros(len(h), np.int64) for _ in range(3))
        so_far = a = 0
        while a < len(heads) - 1:  # whole hashes, about SORTED bytes together
            start = filled[heads[a] - 1] if heads[a] else 0
            b = max(a + 1, int(np.searchsorted(filled[heads[1:] - 1], start + SORTED, "right")))
            at = order[heads[a] : heads[b]]
            own: dict[bytes, int] = {}
            ends = end_in[at]
            number = np.array([own.setdefault(raw[w][s:e], len(own)) for w, s, e in zip(which[at].tolist(), (ends - size[at]).tolist(), ends.tolist())])
            least = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(least, number, doc[at])
            windows = np.zeros(len(own), np.int64)
            windows[number] = win[at]
            found = least_owners(list(own), windows, least)
            begin = np.cumsum(windows) - windows
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            new[begin] = True
            place = np.flatnonzero(new)
            of = np.searchsorted(begin, place, "right") - 1
            runs.append((place - begin[of], np.diff(np.append(place, len(found))), found[place]))
            each = np.bincount(of, minlength=len(own))
            first_run[at], n_runs[at] = (so_far + np.cumsum(each) - each)[number], each[number]
            lowest[at] = np.minimum.reduceat(found, begin)[number]
            so_far += len(place)
            a = b
        run_first, run_windows, run_least = (np.concatenate(x) for x in zip(*runs))
        rows, base = [], 0
        for block, t, p in zip(sent.column("block").to_pylist(), times, places):
            i = np.repeat(np.arange(base, base + len(t)), t)
            told = np.repeat((t > 1) | (lowest[base : base + len(t)] != doc[base : base + len(t)]), t)  # else there is none before it
            i, p = i[told], p[told].astype(np.int64)
            base += len(t)
            if len(i):
                n_each = n_runs[i]
                run = np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each) + np.repeat(first_run[i], n_each)
                rows.append((block, (np.repeat(p, n_each) + run_first[run]).astype(np.uint32).tobytes(), run_windows[run].astype(np.uint8).tobytes(), run_least[run].tobytes()))
        return _batch(["block", "start", "windows", "least"], rows, [pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    more = (("spans", "array<struct<start:long,end:long>>"), ("kept", "binary")) * with_text
    schema = schema_of(base, ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *more)

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        block = _Block(texts)
        depth = np.zeros(len(block.bytes) + 1, np.int32)
        for s, w, least in zip(*(found.column(c).to_pylist() for c in ("start", "windows", "least"))):
            s, w, least = np.frombuffer(s, np.uint32).astype(np.int64), np.frombuffer(w, np.uint8), np.frombuffer(least, np.int64)
            later = block.doc[np.searchsorted(block.ends, s, "right")] > least
            np.add.at(depth, s[later], 1)
            np.add.at(depth, s[later] + w[later] + LENGTH - 1, -1)
        gone = np.cumsum(depth[:-1]) > 0
        rows, start = [], 0
        for t, known, end in zip(block.texts, block.known.tolist(), block.ends.tolist()):
            own = gone[start:end] if known else np.zeros(len(t), bool)
            start = end
            kept, spans = t, np.empty((0, 2), np.int64)
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                spans = edge.reshape(-1, 2)
                kept = np.frombuffer(t, np.uint8)[~own].tobytes()
            row = (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
            rows.append(row + ([{"start": a, "end": b} for a, b in spans.tolist()], kept) * with_text)
        columns = zip(*rows)
        return pa.table([block.ids, *(pa.array(c, arrow_of(f.dataType)) for c, f in zip(columns, schema.fields[1:]))], schema.names)

    try:
        in_blocks(base, BLOCK_BYTES).write.option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
        texts = spark.table(name)
        # as many parts as keep one, with what all blocks send it, as large as a block sends whatever the number of blocks
        parts = chunks = n * 4 + texts.select("block").distinct().count()
        told = by_block(texts).applyInArrow(hashes, "part int, block long, hashes binary").groupBy("part").applyInArrow(shared, "block long, part int, twice binary")
        sent = by_block(texts).cogroup(by_block(told)).applyInArrow(surroundings, "chunk int, block long, hash binary, doc binary, windows binary, times binary, places binary, bytes binary")
        found = sent.groupBy("chunk").applyInArrow(owners, "block long, start binary, windows binary, least binary")
        return written(by_block(texts).cogroup(by_block(found)).applyInArrow(cut, schema), "suffix-result")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
