"""Toxicity behind a noisy channel: obfuscated words are restored by Viterbi decoding, then the restored text is scored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import crc_mod, id_and_text, passes, released, schema_of

#: Fixed values of the channel: letters that a sign can stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Costs in nats: a sign for a letter, a sign put in, a separator put in, a space that does part words, a letter doubled, a run of three or more shortened to one or two, or kept.
SIGN, NOISE, SEPARATOR, BOUNDARY, DOUBLED, SHORTENED, KEPT = 1.0, 7.0, 0.5, 2.0, 4.0, 0.7, 5.0
#: Symbols of the character model: the word's edge, a to z, any other letter.
SYMBOLS = 28
#: Symbols in a row that it knows.
ORDER = 4
#: The most labelled rows that the classifier is fitted on, by a hash of their ids; it bounds what is broadcast.
LABELLED = 40_000
#: Gradient steps of the classifier's fit, and its shrinkage.
STEPS, SHRINKAGE = 400, 0.02
#: Words that a worker remembers how to restore.
REMEMBERED = 400_000
#: Distinct words that a worker counts before it passes the counts on.
COUNTED = 100_000

_S = "a-z0-9@$!|+"
#: Three letters or more, or signs for them, set apart by separators.
SPACED = re.compile(rf"(?<!\S)[{_S}](?:[ ._*-]+[{_S}]){{2,}}(?=[\s.,;:?!]|$)")
#: What the channel can have changed in a word: a sign that can stand for a letter, a separator, a run of one letter. All else comes out of the decoder as it is.
CHANGED = re.compile(r"[0-9@$!|+._*\-]|([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
_SINGLE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789@$!|+")
_TAIL = re.compile(r"([@$!|+])\1{2,}$")
_EDGES = ".,;:?\"'()[]{}<>#%&=/\\~^`*-_"
#: Signs alone are a word up to so many of them; longer ones are numbers.
SIGNS = 6
_NOT_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27


def char_counts(df: DataFrame) -> np.ndarray:
    """Counts of ORDER symbols in a row over all texts of df (text); the driver gets at most SYMBOLS ** ORDER rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for part in passes(batch):
                c = _CODE[np.frombuffer("   ".join(["", *part.column("text").to_pylist(), ""]).lower().encode(), np.uint8)]
                last = len(c) - ORDER + 1
                n += np.bincount(sum(c[i : last + i] * SYMBOLS ** (ORDER - 1 - i) for i in range(ORDER)), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["at", "n"])

    got = df.select("text").mapInArrow(released(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SYMBOLS**ORDER)
    n[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return n.reshape((SYMBOLS,) * ORDER)


class Restorer:
    """Viterbi decoding of a word's lattice of letters under a character model of ORDER symbols."""

    def __init__(self, counts: np.ndarray):
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(1, ORDER + 1):
            n = counts.sum(axis=tuple(range(ORDER - order))) + 5 * p[None] if order > 1 else counts.sum(axis=tuple(range(ORDER - 1))) + p
            p = n / n.sum(axis=-1, keepdims=True)
        self.cost = (-np.log(p)).astype(np.float32).reshape(-1)
        self.memory: dict[str, str] = {}
        self.clean: set[str] = set()

    def forget(self) -> None:
        self.clean.clear()
        self.memory.clear()

    def word(self, noisy: str) -> str:
        """The likeliest word (or words) behind lower-case characters; they themselves if nothing but signs is in them."""
        runs = [(m.group()[0], len(m.group())) for m in re.finditer(r"(.)\1*", noisy, re.DOTALL)]
        size, cost = SYMBOLS ** (ORDER - 1), self.cost
        best: dict[int, tuple[float, str]] = {0: (0.0, "")}
        for char, run in runs:
            options = [(s, c, [ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27 for x in s]) for s, c in self.options(char, run)]
            after: dict[int, tuple[float, str]] = {}
            for state, (before, text) in best.items():
                for letters, extra, codes in options:
                    at, total = state, before + extra
                    for c in codes:
                        step = at * SYMBOLS + c
                        total += float(cost[step])
                        at = step % size if c else 0
                    old = after.get(at)
                    if old is None or total < old[0]:
                        after[at] = total, text + letters
            best = after
        return min((total + float(cost[at * SYMBOLS]), text) for at, (total, text) in best.items())[1].strip() or noisy

    @staticmethod
    def options(char: str, run: int) -> list[tuple[str, float]]:
        """What a run of one character can stand for, with costs."""
        if char.isalpha():
            if run == 1:
                return [(char, 0.0)]
            if run == 2:
                return [(char * 2, 0.0), (char, DOUBLED)]
            return [(char, SHORTENED), (char * 2, SHORTENED), (char * 3, KEPT)]
        out = [("", SEPARATOR if char in " ._*-" else NOISE)]
        if char == " ":
            out.append((" ", BOUNDARY))
        for letter in LEET.get(char, ""):
            out.append((letter, SIGN))
            if run == 2:
                out.append((letter * 2, SIGN * 1.5))
        return out

    @staticmethod
    def core(token: str) -> str:
        """A lower-case token without the marks around it; a sign before a letter and one other than ! after it are its own."""
        core = _TAIL.sub("", token.strip(_EDGES).rstrip("!" + _EDGES))
        return core if re.match(r"!+\w", core) else core.lstrip("!" + _EDGES)

    def restored(self, token: str) -> str:
        """A lower-case token with its core decoded, if the channel can have changed it. Addresses of mail are left alone."""
        core = self.core(token)
        if not CHANGED.search(core) or "@" in core[1:-1] and "." in core:
            return token
        if not _LETTER.search(core) and (not 3 <= len(core) <= SIGNS or any(c not in LEET for c in core)):
            return token
        at = token.index(core)
        return token[:at] + self.word(core) + token[at + len(core) :]

    def _suspects(self, tokens: set[str]) -> dict[str, str]:
        """Of the tokens those that come out otherwise, with what they come to."""
        unknown = tokens - self.clean
        for token in unknown - self.memory.keys():
            fixed = self.restored(token)
            if len(self.clean) + len(self.memory) >= REMEMBERED:
                self.forget()
            if fixed == token:
                self.clean.add(token)
            else:
                self.memory[token] = fixed
        return {t: self.memory[t] if t in self.memory else self._again(t) for t in unknown if t not in self.clean}

    def _again(self, token: str) -> str:
        """A token that was forgotten while others of its text were looked at."""
        return self._suspects({token}).get(token, token)

    def _parted(self, text: str) -> tuple[str, set[str]]:
        """The text in lower case, letters set apart restored, and its distinct tokens."""
        text = text.lower()
        tokens = set(text.split())
        if len(_SINGLE & tokens) >= 2 and (apart := SPACED.sub(lambda m: self.word(m.group()) if _LETTER.search(m.group()) else m.group(), text)) != text:
            return apart, set(apart.split())
        return text, tokens

    def text(self, text: str) -> str:
        """The text in lower case with suspect words restored; the rest is as it was."""
        text, tokens = self._parted(text)
        fixed = self._suspects(tokens)
        return re.sub(r"\S+", lambda m: fixed.get(m.group(), m.group()), text) if fixed else text

    def words(self, text: str) -> set[bytes]:
        """The distinct words of the restored text, without writing it out."""
        _, tokens = self._parted(text)
        fixed = self._suspects(tokens)
        return words_of(" ".join((tokens - fixed.keys()).union(fixed.values()) if fixed else tokens))


def words_of(restored: str) -> set[bytes]:
    """The distinct runs of letters of a restored text."""
    return set(restored.encode().translate(_NOT_LETTERS).split())


def _word_counts(labelled: DataFrame, restorer: Restorer) -> DataFrame:
    """word, bad, good: in how many texts of either label each word occurs. The empty word counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})

        def out() -> pa.RecordBatch:
            words = list({**n[0], **n[1]})
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([x.get(w, 0) for w in words], pa.int64()) for x in (n[1], n[0]))], ["word", "bad", "good"])
            n[0].clear()
            n[1].clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for w in [b"", *restorer.words(text)]:
                    n[toxic][w] = n[toxic].get(w, 0) + 1
                if len(n[0]) + len(n[1]) > COUNTED:
                    yield out()
        yield out()

    return labelled.mapInArrow(released(run, restorer.forget), "word binary, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


class Model:
    """Weights of words, each once a text, and the logistic curve of their sum."""

    def __init__(self, weights: dict[bytes, float], offset: float, tells: bool = True):
        """tells: whether it has seen both labels."""
        self.weights, self.offset, self.tells = weights, offset, tells

    def total(self, words: set[bytes]) -> float:
        return sum(sorted(self.weights[w] for w in words & self.weights.keys()))

    def score(self, total: float) -> float:
        x = total + self.offset
        return 0.0 if x < -500 else 1 / (1 + math.exp(-x))


def _telling(counts: DataFrame) -> set[bytes]:
    """The words whose split over labels is no accident: a likelihood-ratio test against the number of words tried. They are words of the labelled sample, which bounds them."""
    whole = counts.where(F.length("word") == 0).agg(F.sum("bad"), F.sum("good")).first()
    bad, good = (float(x or 0) for x in whole)
    if not bad or not good:
        return set()
    b, g, n = F.col("bad").cast("double"), F.col("good").cast("double"), bad + good
    part = lambda x, of, total: F.when(x > 0, x * F.log(x * n / ((b + g) * total) if of else x * n / ((n - b - g) * total))).otherwise(0.0)
    test = 2 * (part(b, True, bad) + part(g, True, good) + part(F.lit(bad) - b, False, bad) + part(F.lit(good) - g, False, good))
    kept = counts.where((F.length("word") > 0) & (b + g < n)).withColumn("test", test)
    tried = max(2, counts.count())
    kept = kept.where(F.col("test") > 2 * math.log(tried) + 2)
    return {bytes(r.word) for r in kept.select("word").collect()}


def _fitted(toxic: np.ndarray, row: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, float]:
    """Weights of words and an offset: logistic regression of labels on the words of each row (row, word: what is in what), with shrinkage.

    All words are weighed together, so that a word which is common in one label only because one text has many near
    copies adds nothing to the words that tell in all of them. No weight is below zero, so that harmless words cannot
    hide others. Gradient steps of a size of their own for each weight.
    """
    w, b = np.zeros(n_words), math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))
    mean, power = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[word], len(toxic)) + b
        miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic
        grad = np.append(np.bincount(word, miss[row], n_words) + SHRINKAGE * w, miss.sum())
        mean, power = 0.9 * mean + 0.1 * grad, 0.99 * power + 0.01 * grad * grad
        move = 0.3 * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-9)
        w, b = np.maximum(w - move[:-1], 0.0), b - move[-1]
    return w, float(b)


def train(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, holdout: int) -> tuple[Restorer, Model]:
    """The restorer, from all documents, and the classifier, from at most about LABELLED labelled rows outside the holdout."""
    texts = documents.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    restorer = Restorer(char_counts(texts))
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), holdout) != 0))
    usable = usable.groupBy(F.col(id_col).alias("_label_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    n = usable.count()
    place = F.shiftrightunsigned(F.xxhash64("_label_id"), 33)
    sample = usable.where(place < int(min(1.0, 0.95 * LABELLED / max(n, 1)) * (1 << 31))) if n > LABELLED else usable
    labelled = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample.limit(LABELLED)), F.col("_id") == F.col("_label_id")).groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies teach once
    counts = _word_counts(labelled, restorer).persist()
    chosen = _telling(counts)
    counts.unpersist()
    names = sorted(chosen)
    place = {x: i for i, x in enumerate(names)}

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[w] for w in restorer.words(t) & place.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("toxic")], ["words", "toxic"])

    rows = labelled.mapInArrow(released(telling, restorer.forget), "words array<int>, toxic int").orderBy("toxic", "words").toArrow()  # LABELLED rows at most
    toxic = rows.column("toxic").to_numpy().astype(float)
    if not len(toxic):
        return restorer, Model({}, -math.inf, False)
    words = rows.column("words").combine_chunks()
    each = words.value_lengths().to_numpy(zero_copy_only=False)
    w, offset = _fitted(toxic, np.repeat(np.arange(len(toxic)), each), words.flatten().to_numpy(), len(names))
    return restorer, Model(dict(zip(names, w.tolist())), offset, bool(0 < toxic.sum() < len(toxic)))


def score(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", holdout: int = 5, with_text: bool = False) -> DataFrame:
    """One row per row of documents: doc_id, held_out, score, predicted (and restored, with_text).

    The character model is of all texts. The classifier learns from labels of the rows whose crc32 of the id as text
    is not divisible by `holdout`; labels and ids are never inputs of a score. A document with several labels is toxic
    if one says so; null labels and ids teach nothing. Null texts are scored as empty ones, at the rate of texts
    without a telling word. With labels of one kind alone every score is that rate, and without labels it is 0.
    Long texts are read whole, and their distinct words decoded; ties between restored words go to the first in order
    of letters. Repeated rows get equal results; other columns are not looked at; an empty table gives an empty one.

    Every token that the channel could have changed is decoded (signs that can stand for letters, separators, runs of a
    letter), also letters set apart over several tokens; what it could not have changed comes out as it is. Numbers
    (no letters, more than SIGNS signs or a sign that stands for none) and addresses of mail are left alone.
    """
    restorer, model = train(documents, labels, id_col, text_col, label_col, holdout)
    base = id_and_text(documents, id_col, text_col).withColumn("held_out", crc_mod(F.col("doc_id"), holdout) == 0)
    more = (("restored", "string"),) if with_text else ()
    schema = schema_of(base, ("held_out", "boolean"), ("score", "double"), ("predicted", "int"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                texts = part.column("text").to_pylist()
                scores = [model.score(model.total(restorer.words(t))) for t in texts]
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([restorer.text(t) for t in texts], pa.string())] if with_text else [])], schema.names)

    return base.mapInArrow(released(run, restorer.forget), schema)


def without_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", holdout: int = 5) -> DataFrame:
    """documents without the rows that are scored toxic; the columns, and all else, as in score().

    All rows stay where the labels are not of both kinds, as nothing then tells texts apart.
    """
    restorer, model = train(documents, labels, id_col, text_col, label_col, holdout)
    if not model.tells:
        return documents
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([model.score(model.total(restorer.words(t or ""))) < 0.5 for t in texts], pa.bool_()))

    return documents.mapInArrow(released(run, restorer.forget), documents.schema)
