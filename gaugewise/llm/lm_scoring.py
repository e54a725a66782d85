"""Language-model scoring: a subword lattice whose pieces weigh all segmentations of each word."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewise.llm.byte_bpe import vocabulary_path
from gaugewise.llm.common import arrow_of, crc_mod, passes, schema_of, text_bytes, written

VOCABULARY = "piece_bpe_32k.model"
#: The most frequent words, whose probabilities are broadcast; their number bounds it. Rarer words are joined.
FREQUENT = 100_000
#: Distinct words that a worker counts before it passes the counts on.
COUNTED = 600_000
#: How many pieces the vocabulary's own weights are worth beside those that are counted, on either side of a word's first piece.
PRIOR = 100.0
#: Rounds in which the pieces' weights are re-estimated from all segmentations.
ROUNDS = 4
#: The share of words' ends among what goes on a word, before re-estimation.
ENDS = 0.4
#: How much of the mass left for words new to a kind of text goes to words known from others.
SHARED = 0.2
#: Bytes of words that are segmented at a time.
AT_ONCE = 300_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased in A-Z alone, split at \\x20 and \\x09-\\x0D alone."""
    return text.lower().split()


class Edges:
    """The pieces at all places of many words.

    Nodes are numbered place by place: first the words' beginnings, then the nodes after one byte, and so on; within a
    place the longer words come first, so that the words which reach it are the first ones. The last node is where
    pieces that begin a word start from. Edges (piece, start, end) are in order of `end`.
    """

    def __init__(self, known: Pieces, words: list[bytes]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        n = len(words)
        raw = np.frombuffer(b"".join([words[i] for i in self.order.tolist()]), np.uint8)
        longest = int(size[0]) if n else 0
        reach = np.searchsorted(-size, -np.arange(longest), "left")  # words longer than each place
        base = np.concatenate(([0], np.cumsum(reach)))
        place = np.repeat(np.arange(longest), reach)
        word = np.arange(len(place)) - base[place]
        chars = raw[(np.cumsum(size) - size)[word] + place]
        self.bounds = n + base  # the nodes after j bytes are bounds[j-1]:bounds[j]
        self.last = np.where(size > 0, self.bounds[np.maximum(size - 1, 0)] + np.arange(n), np.arange(n))
        self.none = n + len(chars)
        start = np.where(place > 0, n + base[np.maximum(place - 1, 0)] + word, word)
        pieces, starts, ends = [], [], []
        live, node, step = np.arange(len(chars)), known.next[0, chars], 1
        while len(live):
            end = n + base[place[live] + step - 1] + word[live]
            goes_on = known.later_at[node]
            at = np.flatnonzero(goes_on >= 0)
            pieces.append(goes_on[at] + len(known.first))
            starts.append(start[live[at]])
            ends.append(end[at])
            at = np.flatnonzero((known.first_at[node] >= 0) & (place[live] == 0))
            pieces.append(known.first_at[node[at]])
            starts.append(np.full(len(at), self.none))
            ends.append(end[at])
            more = np.flatnonzero((known.deeper[node]) & (place[live] + step < size[word[live]]))
            live = live[more]
            node = known.next[node[more], chars[base[place[live] + step] + word[live]]]
            at = np.flatnonzero(node >= 0)
            live, node, step = live[at], node[at], step + 1
        self.piece, self.start, self.end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (pieces, starts, ends))
        by_end = np.argsort(self.end, kind="stable")
        self.piece, self.start, self.end = self.piece[by_end], self.start[by_end], self.end[by_end]
        self.n = n


class Pieces:
    """The pieces of an existing vocabulary: those that begin a word (the empty one too), and those that go on.

    Every single byte can go on a word, so that every word has a segmentation. The last id that goes on is the end of
    the word. A trie finds the pieces at all places of many words at once. Texts are lower-cased in A-Z, so pieces with
    such letters are left out; all others are in.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        first, later = {b"": 0}, {bytes([b]): b for b in range(256)}
        scores: list[dict[int, float]] = [{}, {}]
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or any("A" <= c <= "Z" for c in piece):
                continue
            if piece.startswith("▁") and "▁" not in piece[1:]:
                scores[0][first.setdefault(piece[1:].encode(), len(first))] = sp.get_score(i)
            elif "▁" not in piece:
                scores[1][later.setdefault(piece.encode(), len(later))] = sp.get_score(i)
        self.first, self.later, self.end = first, later, len(later)
        self.begin = self._weights(scores[0], len(first)), self._weights(scores[1], len(later) + 1)
        self.begin[1][self.end] = ENDS / (1 - ENDS) * self.begin[1].sum()
        self.begin = tuple(x / x.sum() for x in self.begin)
        nodes: dict[bytes, int] = {b"": 0}
        for piece in [*first, *later]:
            for i in range(1, len(piece) + 1):
                nodes.setdefault(piece[:i], len(nodes))
        self.next = np.full((len(nodes), 256), -1, np.int32)
        self.first_at, self.later_at = np.full(len(nodes), -1, np.int64), np.full(len(nodes), -1, np.int64)
        for piece, node in nodes.items():
            if piece:
                self.next[nodes[piece[:-1]], piece[-1]] = node
        self.deeper = (self.next >= 0).any(axis=1)
        for piece, i in first.items():
            if piece:
                self.first_at[nodes[piece]] = i
        for piece, i in later.items():
            self.later_at[nodes[piece]] = i

    @staticmethod
    def _weights(scores: dict[int, float], n: int) -> np.ndarray:
        """Weights before re-estimation: from log probabilities, or, if the scores are merge ranks below zero, by Zipf's law."""
        out = np.full(n, 1e-5)
        logs = min(scores.values(), default=0.0) > -50
        for i, score in scores.items():
            out[i] = math.exp(score) if logs else 1 / (2 - score)
        return out


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Log probabilities of words, one a kind of text: sums over all segmentations into pieces, in log space."""

    def __init__(self, known: Pieces, first: np.ndarray, later: np.ndarray):
        """first, later: weights of pieces, by piece and kind."""
        self.known = known
        self.log = np.log(np.vstack((first / first.sum(axis=0), later / later.sum(axis=0))))

    @classmethod
    def of(cls, known: Pieces, log: np.ndarray) -> Lattice:
        """From log weights that are ready: the pieces that begin a word, then those that go on."""
        out = cls.__new__(cls)
        out.known, out.log = known, log
        return out

    @property
    def end(self) -> np.ndarray:
        return self.log[len(self.known.first) + self.known.end]

    @staticmethod
    def _sums(terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log sums over runs of terms that begin at `at`."""
        top = np.maximum.reduceat(terms, at)
        return top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, np.diff(np.append(at, len(terms))), axis=0)), at))

    def _forward(self, edges: Edges) -> np.ndarray:
        """By node: the log sum over all ways to get there."""
        alpha = np.empty((edges.none + 1, self.log.shape[1]), self.log.dtype)
        alpha[: edges.n], alpha[edges.none] = self.log[0], 0.0
        heads = np.flatnonzero(np.concatenate(([True], edges.end[1:] != edges.end[:-1]))) if len(edges.end) else np.empty(0, np.int64)
        cuts = np.append(heads, len(edges.end))[np.append(edges.bounds - edges.n, 0)[: len(edges.bounds)]] if len(heads) else [0]
        for j in range(1, len(edges.bounds)):
            lo, hi = cuts[j - 1], cuts[j]
            nodes = slice(edges.bounds[j - 1], edges.bounds[j])
            alpha[nodes] = self._sums(alpha[edges.start[lo:hi]] + self.log[edges.piece[lo:hi]], heads[edges.bounds[j - 1] - edges.n : edges.bounds[j] - edges.n] - lo)
        return alpha

    @staticmethod
    def _batches(words: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        size = np.cumsum([len(w) for w in words])
        cut = np.flatnonzero(np.diff(size // AT_ONCE, prepend=0)) if len(words) else []
        for at in np.split(np.arange(len(words)), cut):
            if len(at):
                yield at, [words[i] for i in at.tolist()]

    def log_p(self, words: list[bytes], whole: np.ndarray | None = None) -> np.ndarray:
        """The natural logarithm of each word's probability in each kind; whole: log weights of the words as pieces of their own, which end where the word does."""
        out = np.empty((len(words), self.log.shape[1]))
        for at, batch in self._batches(words):
            edges = Edges(self.known, batch)
            total = self._forward(edges)[edges.last] + self.end
            out[at[edges.order]] = total if whole is None else np.logaddexp(total, whole[at[edges.order]])
        return out

    def expected(self, words: list[bytes], kind: int = 0) -> np.ndarray:
        """How often each piece is used over all segmentations of the words, in one kind."""
        own = Lattice.of(self.known, np.ascontiguousarray(self.log[:, [kind]], np.float32))
        known, n = self.known, np.zeros(len(self.log))
        for _, batch in self._batches(words):
            edges = Edges(known, batch)
            alpha = own._forward(edges)[:, 0]
            beta = np.empty(edges.none + 1, np.float32)
            beta[edges.last] = own.end[0]
            goes_on = np.flatnonzero(edges.start != edges.none)
            goes_on = goes_on[np.argsort(edges.start[goes_on], kind="stable")]
            start, end, piece = edges.start[goes_on], edges.end[goes_on], edges.piece[goes_on]
            heads = np.flatnonzero(np.concatenate(([True], start[1:] != start[:-1]))) if len(start) else np.empty(0, np.int64)
            nodes = start[heads]
            places = np.append(np.searchsorted(nodes, np.append(0, edges.bounds)), len(nodes)) if len(heads) else np.zeros(len(edges.bounds) + 2, np.int64)
            ends = np.append(heads, len(start))
            for j in range(len(edges.bounds) - 2, -1, -1):
                a, b = places[j], places[j + 1]
                if b > a:
                    lo, hi = ends[a], ends[b]
                    beta[nodes[a:b]] = self._sums(beta[end[lo:hi]] + own.log[piece[lo:hi], 0], heads[a:b] - lo)
            total = alpha[edges.last] + own.end[0]
            word = np.arange(edges.none)
            word = np.where(word < edges.n, word, word - (edges.bounds[np.searchsorted(edges.bounds, word, "right") - 1]))
            n += np.bincount(edges.piece, np.exp(alpha[edges.start] + own.log[edges.piece, 0] + beta[edges.end] - total[word[edges.end]]), len(n))
            n[0] += np.exp(own.log[0, 0] + beta[: edges.n] - total).sum()
            n[len(known.first) + known.end] += edges.n
        return n


def _summed(words: DataFrame, kinds: int, path: str, log: np.ndarray) -> np.ndarray:
    """The pieces' expected counts over all distinct words (word, c by kind), by piece and kind. The driver gets a number a piece and kind."""
    shared = words.sparkSession.sparkContext.broadcast(log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice.of(pieces(path), shared.value)
        n = np.zeros(own.log.shape)
        for batch in batches:
            words = batch.column("word").to_pylist()
            seen = batch.column("c").flatten().to_numpy().reshape(len(words), kinds) > 0
            for k in np.flatnonzero(seen.any(axis=0)).tolist():
                n[:, k] += own.expected([words[i] for i in np.flatnonzero(seen[:, k]).tolist()], k)
        at, kind = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(n[at, kind])], ["at", "kind", "n"])

    got = words.mapInArrow(run, "at int, kind int, n double").groupBy("at", "kind").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(log.shape)
    out[got.column("at").to_numpy(), got.column("kind").to_numpy()] = got.column("n").to_numpy()
    return out


class Model:
    """The lattice of each kind of text, with the training words as further pieces of it.

    In a kind, a token is the text's end (by the number of texts), or a word. A word is drawn as one piece, which its
    training count there less a discount weighs, or out of what the discounts leave: as one piece that the counts of
    other kinds weigh (SHARED of it), or by the pieces of the vocabulary. One recursion sums all of these. A kind
    without training words has the lattice alone.
    """

    def __init__(self, path: str, log: np.ndarray, words: np.ndarray, distinct: np.ndarray, once: np.ndarray, twice: np.ndarray, texts: np.ndarray):
        """Numbers by kind: words, distinct words, those that occur once and twice, and texts in training."""
        self.path, self.log, self.words, self.texts = path, log, words, texts
        self.end = (texts + 0.5) / (words + texts + 1)
        self.discount = (once + 0.5) / (once + 2 * twice + 1)
        self.left = np.where(words > 0, self.discount * distinct / np.maximum(words, 1), 1.0)
        self.shared = SHARED if words.sum() else 0.0
        self.prior = (texts + 0.1) / (texts + 0.1).sum()

    def whole(self, counts: np.ndarray) -> np.ndarray:
        """Log weights of words as pieces, from their counts by kind."""
        seen = np.maximum(counts - self.discount, 0) / np.maximum(self.words, 1)
        with np.errstate(divide="ignore"):
            return np.log((1 - self.end) * (seen + self.left * self.shared * counts.sum(axis=1, keepdims=True) / max(self.words.sum(), 1)))

    def log10_p(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """The log10 probability of each word in each kind."""
        known = pieces(self.path)
        log = self.log.copy()
        log[: len(known.first)] += np.log((1 - self.end) * self.left * (1 - self.shared))
        return Lattice.of(known, log).log_p(words, self.whole(counts)) / math.log(10)


def _counted(texts: DataFrame) -> DataFrame:
    """word, kind, n: occurrences in the training texts of a kind; kind -1 and n 0 for the words of held-out texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for kind, words in seen.items():
                n = pa.array(np.fromiter(words.values(), np.int64, len(words)) if kind >= 0 else np.zeros(len(words), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(np.full(len(words), kind, np.int32)), n], ["word", "kind", "n"])
            seen.clear()

        for batch in batches:
            for part in passes(batch):
                for held_out, kind, text in zip(part.column("held_out").to_pylist(), part.column("kind").to_pylist(), text_bytes(part.column("text"))):
                    seen.setdefault(-1 if held_out else kind, Counter()).update(words_of(text))
                if sum(map(len, seen.values())) > COUNTED:
                    yield from out()
        yield from out()

    return texts.select("held_out", "kind", "text").mapInArrow(run, "word binary, kind int, n long")


def train(base: DataFrame, names: list[str], path: str) -> tuple[Model, DataFrame, int, int]:
    """From base (held_out, kind: an index of names, text): the model, all words with their counts (word, c by kind), tokens, distinct tokens."""
    kinds = len(names)
    c = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in range(kinds)]
    words = written(_counted(base).groupBy("word").agg(F.array(*c).alias("c")), "lm-words")
    texts = np.zeros(kinds)
    for r in base.where(~F.col("held_out")).groupBy("kind").count().collect():
        texts[r.kind] = r["count"]
    each = words.select(F.posexplode("c").alias("kind", "n")).where("n > 0").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"))
    stats = np.zeros((4, kinds))
    for r in each.collect():
        stats[:, r.kind] = r.n, r.v, r.one, r.two
    training = words.where(F.exists("c", lambda n: n > 0))
    known = pieces(path)
    log = Lattice(known, *(np.repeat(x[:, None], kinds, axis=1) for x in known.begin)).log
    for _ in range(ROUNDS):
        n = _summed(training, kinds, path, log) + PRIOR * np.concatenate(known.begin)[:, None]
        log = Lattice(known, n[: len(known.first)], n[len(known.first) :]).log
    ends = int(texts.sum())
    return Model(path, log, *stats, texts), words, int(stats[0].sum()) + ends, training.count() + (ends > 0)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind_col: str | None = "lang", holdout: int = 10, path: str | None = None) -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id as text is not divisible by `holdout`. Tokens are lower-cased words and
    one end. score is the log10 probability of the text: a sum over kinds of text, each weighed by its share of the
    training texts, of the product over tokens of their marginal probabilities, each summed over all segmentations of
    the word by the forward recursion (see Model). Pieces are those of an existing vocabulary, re-estimated from all
    segmentations of the distinct training words of a kind, and the training words. kind_col names the kinds of
    training texts (null is one) and is not an input of a score; None is one kind. It must be a column of few values,
    such as languages: the driver holds a number a piece and kind.

    Null and empty texts are one end. With nothing to learn from, words are left to the lattice. Very long words and
    texts are taken whole. Repeated rows get equal results; other columns of df are not looked at; an empty table gives
    an empty one.

    A text's frequent words are summed where the text is read; of its rarer words only the words go to their
    probabilities, by a shuffle, and come back as sums. The driver gets sums, a number a piece and kind, and the
    FREQUENT most frequent words.
    """
    path = path or vocabulary_path(VOCABULARY)
    kind_of = F.coalesce(F.col(kind_col).cast("string"), F.lit("")) if kind_col else F.lit("")
    held = crc_mod(F.col(id_col), holdout) == 0
    names = sorted(r.kind for r in df.where(~held).select(kind_of.alias("kind")).distinct().collect()) or [""]
    kinds = len(names)
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, names)), kind_of) - 1, F.lit(0)).cast("int")  # of held-out texts it is not looked at
    base = df.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), kind.alias("kind"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model, words, n, v = train(base, names, path)
    shared = df.sparkSession.sparkContext.broadcast(model)
    smoothed = n + 0.1 * (v + 1)
    columns = [f"p{k}" for k in range(kinds)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("c").flatten().to_numpy().reshape(len(batch), kinds)
            p = shared.value.log10_p(batch.column("word").to_pylist(), c)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c.sum(axis=1)), *map(pa.array, p.T.copy())], ["word", "c", *columns])

    weighed = written(words.mapInArrow(weigh, "word binary, c long, " + ", ".join(f"{x} double" for x in columns)), "lm-weighed")
    steps = weighed.where("c > 0").groupBy(F.floor(F.log("c") * 20).alias("step")).count().orderBy(F.desc("step")).collect()
    enough = [s.step for s, so_far in zip(steps, accumulate(s["count"] for s in steps)) if so_far <= FREQUENT]
    top = weighed.where((F.col("c") > 0) & (F.floor(F.log("c") * 20) >= min(enough, default=1 << 30))).toArrow()
    common = df.sparkSession.sparkContext.broadcast((top.column("word").to_pylist(), np.append(top.column("c").to_numpy(), int(model.texts.sum())), np.vstack([np.column_stack([top.column(x).to_numpy() for x in columns]), np.log10(model.end)])))
    summed = ["n_known", "base", *columns]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text with the sums over its frequent words, and a row for each of its rarer words."""
        top, c, p = common.value
        place = {w: i for i, w in enumerate(top)}
        values = np.column_stack(((c > 0).astype(float), np.log10((c + 0.1) / smoothed), p))
        values = np.vstack((values, np.zeros((1, values.shape[1]))))  # the last row is of words that are not here
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in passes(batch):
                tokens, starts, rare, rare_n, rare_row = [], [], [], [], []
                each = [words_of(t) for t in text_bytes(part.column("text"))]
                counts = np.array([len(x) + 1 for x in each], np.int64)
                for x in each:
                    starts.append(len(tokens))
                    tokens += x
                    tokens.append(None)  # the end
                at = np.fromiter(map(place.get, tokens, repeat(-1)), np.int64, len(tokens))
                at[np.cumsum(counts) - 1] = len(top)
                sums = np.add.reduceat(values[at], starts, axis=0)
                away = np.flatnonzero(at < 0)
                bounds = np.searchsorted(away, [*starts, len(tokens)]).tolist()
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    if b > a:
                        others = Counter([tokens[j] for j in away[a:b].tolist()])
                        rare += others.keys()
                        rare_n += others.values()
                        rare_row.append(np.full(len(others), row + i))
                none = pa.nulls(len(part), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(part))), part.column("doc_id"), part.column("held_out"), none, pa.array(counts), *map(pa.array, sums.T.copy())], shape.names)
                row += len(part)
                if rare:
                    k = len(rare)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare_row)), pa.nulls(k, id_type), pa.nulls(k, pa.bool_()), pa.array(rare, pa.binary()), pa.array(rare_n, pa.int64()), *[pa.nulls(k, pa.float64())] * len(summed)], shape.names)

    id_type = arrow_of(base.schema["doc_id"].dataType)
    shape = schema_of(base, ("held_out", "boolean"), ("word", "binary"), ("n", "long"), *[(x, "double") for x in summed])
    shape = T.StructType([T.StructField("row", T.LongType()), *shape.fields])
    found = written(base.select("doc_id", "held_out", "text").mapInArrow(look_up, shape), "lm-found")
    joined = found.where(F.col("word").isNotNull()).select("row", "word", "n").join(weighed, "word")
    times = [F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("double").alias("n_known"), (F.col("n") * F.log10((F.col("c") + 0.1) / smoothed)).alias("base"), *[(F.col("n") * F.col(x)).alias(x) for x in columns]]
    rarer = joined.select("row", *times).groupBy("row").agg(*[F.sum(x).alias(f"{x}_rare") for x in summed])
    both = found.where(F.col("word").isNull()).join(rarer, "row", "left").select("doc_id", "held_out", "n", *[(F.col(x) + F.coalesce(f"{x}_rare", F.lit(0.0))).alias(x) for x in summed])
    by_kind = F.array(*[F.col(x) + float(w) for x, w in zip(columns, np.log10(model.prior))])
    total = F.array_max("by_kind") + F.log10(F.aggregate("by_kind", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - F.array_max("by_kind"))))
    return both.withColumn("by_kind", by_kind).select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), F.round("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), total.alias("score")
    )
