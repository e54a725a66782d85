"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import crc_mod, id_and_text, passes, schema_of

#: n-grams of one, two and three bytes are hashed into this many buckets.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Texts handed to one numpy pass.
PASS = 400_000
#: n-grams whose ratios are looked up at a time.
SLICE = 500_000
#: The share of the weight between the two nearest codewords below which a prediction is flagged.
AMBIGUOUS = 0.7


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """One row of -1 and +1 for each of n classes; a single class is on the + side of one bit.

    Up to five classes: every way to part the classes in two (2 ** (n - 1) - 1 bits). More: of 200 random codes of
    10 log2(n) bits, the one whose closest rows are farthest apart.
    """
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        parts = [p for p in range(1, 2 ** max(n - 1, 1))]
        return np.array([[1 if i and p >> (i - 1) & 1 else -1 for p in parts] for i in range(n)], np.float64)
    rng, best, far = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2
        near = apart[~np.eye(n, dtype=bool)].min()
        if near > far:
            best, far = code, near
    return best


def _letters() -> np.ndarray:
    """Byte to byte: what is not a letter becomes a space; bytes of longer characters stay."""
    keep = np.full(256, 32, np.uint8)
    keep[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    keep[128:] = np.arange(128, 256)
    return keep


LETTERS = _letters()


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the buckets of all n-grams, and where each text begins. Texts are padded with spaces, so n-grams stay within one."""
    raw = [b"  " + t.lower().encode() + b"  " for t in texts]
    starts = np.cumsum([0, *map(len, raw)])
    b = LETTERS[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    b = np.concatenate((b, np.full(2, 32, np.uint32)))
    two = b[:-2] << np.uint32(8) | b[1:-1]
    three = two << np.uint32(8) | b[2:]
    mixed = [((x + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(17) for k, x in ((1 << 26, b[:-2]), (1 << 25, two), (0, three))]
    return mixed, starts


def _counts(df: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of df (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out(lang: str) -> pa.RecordBatch:
            n = sums.pop(lang)
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

        for batch in batches:
            for part in passes(batch, most=PASS):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in dict.fromkeys(langs):
                    if lang not in sums and len(sums) >= 64:  # the least seen goes on, so that a worker's memory is bounded
                        yield out(min(sums, key=lambda x: sums[x].sum()))
                    mixed, _ = grams([t for t, x in zip(texts, langs) if x == lang])
                    for m in mixed:
                        sums[lang] = sums.get(lang, 0) + np.bincount(m, minlength=BUCKETS)
        for lang in list(sums):
            yield out(lang)

    return df.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class OutputCodes:
    """A binary n-gram classifier for each bit of the codewords; decoding weighs each bit's loss by its confidence."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs))
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        ratios, weights = [], []
        for bit in self.code.T:
            yes, no = (p[side].mean(axis=0) if side.any() else np.full(BUCKETS, 1 / BUCKETS) for side in (bit > 0, bit < 0))
            ratios.append(np.log(yes / no))
            weights.append(np.abs(yes - no).sum() / 2)  # how well the bit's two sides can be told apart
        self.ratio = np.ascontiguousarray(np.array(ratios, np.float32).T)
        self.weight = np.array(weights)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each text, its share of the weight, and whether the second-nearest codeword is close."""
        mixed, starts = grams(texts)
        sums = np.zeros((len(texts), self.ratio.shape[1]))
        of = np.repeat(np.arange(len(texts)), np.diff(starts))
        for a in range(0, len(of), SLICE):  # a very long text is summed slice by slice
            own = of[a : a + SLICE]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            for m in mixed:
                sums[own[first]] += np.add.reduceat(self.ratio[m[a : a + SLICE]], first, axis=0, dtype=np.float64)
        margin = np.clip(sums / len(ORDERS), -30, 30)
        loss = np.log1p(np.exp(-margin[:, None, :] * self.code[None])) * self.weight  # text, class, bit
        loss = loss.sum(axis=2) / max(self.weight.mean(), 1e-9) / max(1, len(self.langs) // 2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = share[np.arange(len(best)), best]
        return best, top, top < AMBIGUOUS


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(labelled: DataFrame) -> OutputCodes | None:
    """From all rows of text and non-null lang. The driver gets BUCKETS counts a language, whatever the number of rows."""
    rows = _counts(labelled).toArrow()
    names = rows.column("lang").combine_chunks().dictionary_encode()
    if not len(rows):
        return None
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    langs = names.dictionary.to_pylist()
    counts = np.zeros((len(langs), BUCKETS))
    counts[names.indices.to_numpy(zero_copy_only=False), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    order = sorted(range(len(langs)), key=langs.__getitem__)
    return OutputCodes([langs[i] for i in order], counts[order])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", holdout: int = 5) -> DataFrame:
    """One row per row of df: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from the text and non-null language of the rows whose crc32 of the id as text is not divisible by
    `holdout`; the id decides only that, and language is never an input of a prediction. Null texts and texts without
    a letter are `und` with score 0 and flagged. With nothing to learn from, every row is. With one language learned,
    every other row is of it, with score 1. Of equally near codewords the first language in order of names is taken;
    long texts are read whole, slice by slice. Repeated rows get equal results; other columns of df are not looked at;
    an empty table gives an empty one.
    """
    held = crc_mod(F.col(id_col), holdout) == 0
    model = train(df.where(~held & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))
    base = id_and_text(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", "t").withColumn("held_out", crc_mod(F.col("doc_id"), holdout) == 0)
    schema = schema_of(base, ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, most=PASS):
                texts = part.column("text").to_pylist()
                known = [model is not None and has_letter(t) for t in texts]
                langs, scores, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if any(known):
                    at = [i for i, k in enumerate(known) if k]
                    for i, c, s, u in zip(at, *(x.tolist() for x in model.predict([texts[i] for i in at]))):
                        langs[i], scores[i], unsure[i] = model.langs[c], min(max(s, 0.0), 1.0), u
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], schema.names)

    return base.mapInArrow(run, schema)
