"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie within a Hamming budget."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import fresh, id_and_text, passes, released, schema_of, text_bytes, written
from gaugewise.llm.components import connected_components
from gaugewise.llm.suffix_dedup import _mixed


@dataclass(frozen=True)
class Budget:
    """How many bits two linked fingerprints may differ in.

    blocks: lengths of one block more than `bits`, from the highest bit. Of two fingerprints that differ in at most
    `bits`, some rotation of the blocks has fewer than j differing bits in its first j blocks, for every j; so its first
    `key` bits agree. They name the trie's subtree, and the task. totals: the most that all fingerprints of two texts,
    where they have several, may differ in together, as ascending levels; pairs within a lower level are linked first.
    """

    blocks: tuple[int, ...]
    bits: int
    key: int
    totals: tuple[int, ...] = ()


FOUR_BITS = Budget((13, 13, 13, 13, 12), 4, 12)
BLOCKS = FOUR_BITS.blocks
#: Fingerprints of a text where links go by similarity.
SEVERAL = 7


def by_similarity(jaccard: float) -> Budget:
    """Eight bits in one of SEVERAL fingerprints, and in all together as many as texts of that similarity differ in on average, less and more two standard deviations."""
    p = math.acos(2 * jaccard / (1 + jaccard)) / math.pi
    n = 64 * SEVERAL
    return Budget((7,) * 8 + (8,), 8, 7, tuple(int(n * p + z * math.sqrt(n * p * (1 - p))) for z in (-2, 0, 2)))


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    return _majority(_shingle_hashes(text, width))


def several(text: bytes, width: int = 5) -> list[int]:
    """SEVERAL fingerprints of the set of shingles, from their hashes and from remixed ones."""
    h = np.unique(_shingle_hashes(text, width))
    return [_majority(_mixed(h + np.uint64(k * 0x632BE59BD9B4E019 % (1 << 64))) if k else h) for k in range(SEVERAL)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, row (its place in df) and fp (the fingerprint as a signed long) for every row; null text counts as empty."""
    base = id_and_text(df, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                fp = np.array([fingerprint(x, width) for x in text_bytes(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])

    return base.mapInArrow(run, schema_of(base, ("row", "long"), ("fp", "long")))


class _Trie:
    """The binary trie over sorted distinct numbers: a node is the range of those with one prefix.

    The pairs of nodes are joined level by level. A pair is dropped when its differing bits exceed what the level
    allows, or when all its leaves are known to be of one component.
    """

    #: Pairs of nodes with so few pairs of leaves are compared at once.
    SMALL = 32
    #: Pairs of nodes carried at a time; so many where texts have several fingerprints, whose rows are wider.
    FRONT, FRONT_OF_SEVERAL = 1 << 20, 1 << 16

    def __init__(self, sorted_fps: np.ndarray, roots: np.ndarray, rotation: np.ndarray, budget: Budget = FOUR_BITS, others: np.ndarray | None = None):
        """others: the other fingerprints of each text, for a budget with a total."""
        self.a, self.roots, self.rotation, self.budget, self.others = sorted_fps, roots, rotation, budget, others
        self.label = np.arange(len(sorted_fps))
        self.front = self.FRONT if others is None else self.FRONT_OF_SEVERAL
        self.total = budget.totals[0] if budget.totals else None
        self.tree: list[tuple[np.ndarray, np.ndarray]] = []
        bounds = np.array([np.cumsum(np.roll(budget.blocks, -r)) for r in range(len(budget.blocks))])
        self.allowed = np.array([[np.searchsorted(b, depth, "left") for depth in range(65)] for b in bounds])

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the components of i and j, pairwise. Of the pairs that join two components one is kept in `tree`."""
        label = self.label
        while len(i):
            x, y = label[i], label[j]
            differ = x != y
            if not differ.any():
                break
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            high, low = np.maximum(x, y), np.minimum(x, y)
            np.minimum.at(label, high, low)
            if self.total is not None:
                won = np.flatnonzero(label[high] == low)
                won = won[np.unique(high[won], return_index=True)[1]]
                self.tree.append((i[won], j[won]))
            while (up := label[label]).tobytes() != label.tobytes():
                label = self.label = up

    def near(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = np.bitwise_count(self.a[i] ^ self.a[j]).astype(np.int64)
        close = apart <= self.budget.bits
        if self.others is not None:
            i, j, apart = i[close], j[close], apart[close]
            close = apart + np.bitwise_count(self.others[i] ^ self.others[j]).sum(axis=1, dtype=np.int64) <= self.total
        self.link(i[close], j[close])

    def components(self) -> np.ndarray:
        """For each number, the place of the first one in its component."""
        for self.total in self.budget.totals or (None,):
            self.join()
        return self.label

    def join(self) -> None:
        a, roots = self.a, self.roots
        if len(a) < 2:
            return
        inner = np.ones(len(a) - 1, bool)
        inner[roots[1:-1] - 1] = False
        for step in (1, 2, 3):  # neighbours in order first, so that dense groups are one component from the start
            i = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(inner, step).all(axis=1)) if len(inner) >= step else np.empty(0, np.int64)
            self.near(i, i + step)
        lo, hi = roots[:-1], roots[1:]
        many = hi - lo > 1
        lo, hi, rot = lo[many], hi[many], self.rotation[many]
        stack = [(self.budget.key, lo, hi, lo, hi, np.zeros(len(lo), np.int8), rot)]
        ones_at: dict[int, np.ndarray] = {}
        while stack:
            depth, al, ah, bl, bh, err, rot = stack.pop()
            run_end = self.run_ends()
            go = (al != bl) | (ah - al > 1)
            go &= ~((self.label[al] == self.label[bl]) & (run_end[al] >= ah) & (run_end[bl] >= bh))
            small = go & ((ah - al) * (bh - bl) <= self.SMALL)
            self.near(*self.leaves(al[small], ah[small], bl[small], bh[small]))
            go &= ~small
            if depth == 64 or not go.any():
                continue
            al, ah, bl, bh, err, rot = (x[go] for x in (al, ah, bl, bh, err, rot))
            if depth not in ones_at:
                ones_at[depth] = np.concatenate(([0], np.cumsum((a >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
            ones = ones_at[depth]
            am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
            same = al == bl
            kids = [(al, am, bl, bm, err, rot, None), (am, ah, bm, bh, err, rot, None), (al, am, bm, bh, err + 1, rot, None), (am, ah, bl, bm, err + 1, rot, ~same)]
            parts = []
            for xl, xh, yl, yh, e, r, only in kids:
                ok = (xh > xl) & (yh > yl) & (e <= self.allowed[r, depth + 1])
                if only is not None:
                    ok &= only
                parts.append([x[ok] for x in (xl, xh, yl, yh, e, r)])
            merged = [np.concatenate(x) for x in zip(*parts)]
            for s in range(0, len(merged[0]), self.front):
                stack.append((depth + 1, *(x[s : s + self.front] for x in merged)))

    def run_ends(self) -> np.ndarray:
        """For each place, where the run of equal labels that it is in ends."""
        label = self.label
        ends = np.flatnonzero(np.concatenate((label[1:] != label[:-1], [True]))) + 1
        return np.repeat(ends, np.diff(np.concatenate(([0], ends))))

    @staticmethod
    def leaves(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        na, nb = ah - al, bh - bl
        n = na * nb
        pair = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        i, j = al[pair] + k // nb[pair], bl[pair] + k % nb[pair]
        return i[i < j], j[i < j]


def _rotated(fp: Column, rotation: int, blocks: tuple[int, ...]) -> Column:
    by = sum(blocks[:rotation])
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def _links_of(rotation: np.ndarray, fps: np.ndarray, ids: np.ndarray | None = None, others: np.ndarray | None = None, budget: Budget = FOUR_BITS) -> pa.RecordBatch:
    """Edges among rotated fingerprints that share their key; ids are the fingerprints themselves where none are given.

    They are stars (id, first id of its component), or, with `others`, near pairs: a tree for each component, of the
    nearest ones as far as the levels of `totals` tell. rotation may count on over several tries: it is taken modulo the number of blocks.
    """
    order = np.lexsort((fps, rotation))
    fps, rotation = fps[order], rotation[order]
    key = fps >> np.uint64(64 - budget.key)
    new = np.concatenate(([True], (rotation[1:] != rotation[:-1]) | (key[1:] != key[:-1])))
    roots = np.concatenate((np.flatnonzero(new), [len(fps)]))
    turn = rotation % len(budget.blocks)
    trie = _Trie(fps, roots, turn[roots[:-1]], budget, None if others is None else others[order])
    label = trie.components()
    if ids is None:
        by = np.cumsum((0, *budget.blocks[:-1])).astype(np.uint64)[turn]
        back = np.where(by == 0, fps, (fps >> by) | (fps << ((np.uint64(64) - by) % np.uint64(64)))).view(np.int64)
    else:
        back = ids[order]
    if others is None:
        u = np.flatnonzero(label != np.arange(len(label)))
        v = label[u]
    else:
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*trie.tree) if trie.tree else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(back[u]), pa.array(back[v])], ["u", "v"])


def _joins(budget: Budget):
    """Joins the tries of a partition that is sorted by rotation and key, some whole keys at a time."""
    most = 1 << (14 if budget.totals else 17)  # rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def links(rot: np.ndarray, fps: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
            return _links_of(rot, fps, more[0], np.stack(more[1:], axis=1), budget) if more else _links_of(rot, fps, budget=budget)

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy().view(np.uint64), *(batch.column(i).to_numpy() if i == 2 else batch.column(i).to_numpy().view(np.uint64) for i in range(2, batch.num_columns))))
            n += len(batch)
            if n < most:
                continue
            rot, fps, *more = (np.concatenate(x) for x in zip(*held))
            key = rot << budget.key | (fps >> np.uint64(64 - budget.key)).astype(np.int64)
            last = np.flatnonzero(key != key[-1])
            cut = last[-1] + 1 if len(last) else 0  # the last key may go on in the next batch
            if cut:
                yield links(rot[:cut], fps[:cut], *(x[:cut] for x in more))
            held, n = [(rot[cut:], fps[cut:], *(x[cut:] for x in more))], len(fps) - cut
        if n:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def _turned(fp: str, budget: Budget, first: int = 0, *more: str) -> Column:
    """All rotations of a fingerprint: rot (from `first` on), rfp, and other columns."""
    return F.array(*[F.struct(F.lit(first + r).alias("rot"), _rotated(F.col(fp), r, budget.blocks).alias("rfp"), *more) for r in range(len(budget.blocks))])


def _linked(turned: DataFrame, budget: Budget) -> DataFrame:
    key = F.shiftrightunsigned("rfp", 64 - budget.key)
    return turned.withColumn("_key", key).repartition("rot", "_key").sortWithinPartitions("rot", "_key").drop("_key").mapInArrow(released(_joins(budget)), "u long, v long")


def near_links(fps: DataFrame) -> DataFrame:
    """Edges u, v that connect all distinct fp of the table which differ in at most four bits."""
    return _linked(fps.select(F.explode(_turned("fp", FOUR_BITS)).alias("x")).select("x.rot", "x.rfp"), FOUR_BITS)


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row per row of df: doc_id, fp, component_id (the smallest doc_id reachable over links of at most four bits), kept, row.

    Null or empty texts and texts without words have fingerprint 0 and are linked like any other. A null doc_id is
    never a component_id unless the whole component has none. kept marks one row of each component, the first with
    that id. Repeated rows get equal results but for that; an empty table gives an empty one. Other columns of df are
    not looked at.
    """
    fps = written(fingerprints(df, id_col, text_col, width), "simhash-fp")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = written(fps.groupBy("fp").agg(F.min(first).alias("first")), "simhash-classes")
    labels = connected_components(written(near_links(classes.select("fp")), "simhash-links"))
    named = classes.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-named")
    smallest = named.groupBy("root").agg(F.min("first").alias("first"))
    ids = written(named.select("fp", "root").join(smallest, "root").select("fp", "first"), "simhash-ids")
    return fps.join(ids, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), "row")


def alike(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of df: doc_id, row, root (a number of its group), kept (one row of each group, the first with the smallest id).

    A text has SEVERAL fingerprints of its set of shingles, each with a trie of its own. Two texts may be linked where one
    fingerprint differs in at most eight bits, and all together in no more than by_similarity() allows. A task keeps a
    tree of such pairs for each component that it finds, near ones first, so there are fewer pairs than fingerprints;
    these are confirmed by the Jaccard similarity of the sets themselves. Texts with all fingerprints equal are taken
    for equal. A pair is missed if every fingerprint differs in over eight bits, or if the tree goes by other texts and
    one of its pairs is not confirmed.

    Null and empty texts and texts without words have the fingerprint 0 and are one group. A null doc_id comes last in
    the order of a group. Ties and repeated rows: the first row with the smallest id stays. Long texts are taken whole.
    An empty table gives an empty one. Other columns of df are not looked at.
    """
    budget = by_similarity(similarity)
    base = id_and_text(df, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("mark"), "text")
    names = [f"f{k}" for k in range(SEVERAL)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                fp = np.array([several(x, width) for x in text_bytes(part.column("text"))], np.uint64).reshape(-1, SEVERAL).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), part.column("mark"), *map(pa.array, fp.T.copy())], ["doc_id", "row", "mark", *names])

    fps = written(base.mapInArrow(released(run), schema_of(base, ("row", "long"), ("mark", "binary"), *[(x, "long") for x in names])), "alike-fp")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "mark")
    classes = written(fps.groupBy(*names).agg(F.min(first).alias("first")).withColumn("id", F.col("first.row")), "alike-classes")
    edges, tries = [], []
    for k, name in enumerate(names):
        own = classes.groupBy(name).agg(F.min(F.struct("id", *[x for x in names if x != name])).alias("one"))
        own = written(own.select(name, "one.*"), "alike-distinct")
        edges.append(classes.select(name, F.col("id").alias("u")).join(own.select(name, F.col("id").alias("v")), name).where("u <> v").select("u", "v"))
        turned = own.select(F.explode(_turned(name, budget, k * len(budget.blocks), "id", *[F.col(x).alias(f"o{i}") for i, x in enumerate(x for x in names if x != name)])).alias("x"))
        tries.append(turned.select("x.*"))
    near = tries[0]
    for t in tries[1:]:
        near = near.unionByName(t)
    near = _linked(near, budget)
    for e in edges:
        near = near.unionByName(e)
    labels = connected_components(_confirmed(base, classes.select("first.row", "first.mark"), written(near, "alike-pairs"), width, similarity))
    named = written(classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select(*names, "first", F.coalesce("root", "id").alias("root")), "alike-named")
    smallest = named.groupBy("root").agg(F.min("first").alias("least"))
    ids = written(named.join(smallest, "root").select(*names, "root", "least"), "alike-ids")
    return fps.join(ids, names).select("doc_id", "row", "root", (F.col("row") == F.col("least.row")).alias("kept"))


def _confirmed(base: DataFrame, marks: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs u, v whose texts' sets of shingles are as similar as that. marks: row and mark; a text of base is found by its mark, whatever its row."""
    pairs = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "alike-distinct-pairs")
    rows = pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).distinct()
    marks = written(marks.join(rows, "row"), "alike-marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                h = [np.unique(_shingle_hashes(x, width)).view(np.int64) for x in text_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("mark"), pa.array(h, pa.list_(pa.int64()))], ["mark", "h"])

    sets = base.select("mark", "text").join(marks.select("mark"), "mark", "left_semi").mapInArrow(released(run), "mark binary, h array<long>").dropDuplicates(["mark"])
    sets = written(marks.join(sets, "mark").select("row", "h"), "alike-sets")
    both = pairs.join(sets.select(F.col("row").alias("u"), F.col("h").alias("a")), "u").join(sets.select(F.col("row").alias("v"), F.col("h").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return written(both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v"), "alike-links")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of df for each group of alike(), with df's columns: the first row with the group's smallest id.

    Null and empty texts and texts without words are one group. df must read alike twice, as files do. Rows with equal
    ids are rows of their own. An empty table gives an empty one.
    """
    row = fresh(df, "row")
    dropped = alike(df, id_col, text_col, width, similarity).where("not kept").select(F.col("row").alias(row))
    return df.withColumn(row, F.monotonically_increasing_id()).join(written(dropped, "alike-dropped"), row, "left_anti").select(*df.columns)
