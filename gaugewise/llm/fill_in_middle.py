"""Fill-in-middle: texts are cut at token boundaries that a wavelet matrix over classes of bytes locates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import PASS_BYTES, id_and_text, passes, schema_of, text_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_SHARE, SPM_SHARE, SEED = 10, 20, "1"

#: Classes of a byte of UTF-8: inside a character, a character that is no letter, the first letter of a run, a further one.
INSIDE, OTHER, OPENING, LETTER = range(4)


class WaveletMatrix:
    """Ranks and selects over a sequence of symbols below 2**bits: a bit vector a level, zeros before ones on the level below."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.n = [], len(symbols)
        for level in reversed(range(bits)):
            ones = (symbols >> level & 1).astype(bool)
            words = np.zeros(len(ones) // 64 + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((level, words, before, self.n - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before position `at`: a count a word, and the bits of one word."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & mask)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each position."""
        start = 0
        for level, words, before, zeros in self.levels:
            ones, ones_first = self._ones(words, before, at), int(self._ones(words, before, np.array([start]))[0])
            if symbol >> level & 1:
                at, start = zeros + ones, zeros + ones_first
            else:
                at, start = at - ones, start - ones_first
        return at - start

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """Tokens that open before each position: characters that are no letters, and runs of letters."""
        return self.rank(OTHER, at) + self.rank(OPENING, at)

    def characters(self, at: np.ndarray) -> np.ndarray:
        return self.tokens(at) + self.rank(LETTER, at)

    def end_of(self, token: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The end of the token-th token (from 0: nothing): the last position with no more tokens before it, by bisection between low and high."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.tokens(middle) <= token
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def classes(raw: np.ndarray, starts: np.ndarray, inside_run: bool = False) -> np.ndarray:
    """The class of each byte; runs of letters end where a text starts. inside_run: a letter stands before the first byte."""
    letter = ((raw | 0x20) >= ord("a")) & ((raw | 0x20) <= ord("z"))
    before = np.concatenate([[inside_run], letter[:-1]]) if len(raw) else letter
    before[starts] = False
    return np.where(letter, np.where(before, LETTER, OPENING), np.where((raw & 0xC0) == 0x80, INSIDE, OTHER)).astype(np.uint8)


def draws(ids: list, seed: str = SEED) -> np.ndarray:
    """h1 to h4 of each id (a null one counts as the empty text)."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(len(ids), 4).astype(np.int64)


def _cuts(texts: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that are looked at together: tokens, the two cuts (bytes), and characters before each cut."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(b"".join(texts), np.uint8)
    matrix = WaveletMatrix(classes(raw, starts[sizes > 0]), 2)
    base = matrix.tokens(starts)
    n = matrix.tokens(ends) - base
    want = np.sort(h[:, :2] % (n + 1)[:, None], 1)
    at = np.stack([matrix.end_of(base + want[:, k], starts, ends) for k in range(2)], 1)
    chars = np.stack([matrix.characters(at[:, k]) - matrix.characters(starts) for k in range(2)], 1)
    return n, at - starts[:, None], chars


def _long_cuts(text: bytes, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_cuts() for one long text, a slice at a time: counts of all slices first, then a matrix of those that hold a cut."""
    raw = np.frombuffer(text, np.uint8)
    edges = np.arange(0, len(raw), PASS_BYTES)

    def sliced(k: int) -> WaveletMatrix:
        lo = int(edges[k])
        before = lo > 0 and chr(raw[lo - 1]).isascii() and chr(raw[lo - 1]).isalpha()
        return WaveletMatrix(classes(raw[lo : lo + PASS_BYTES], np.zeros(0, np.int64), before), 2)

    counts = []
    for k in range(len(edges)):
        matrix = sliced(k)
        end = np.array([matrix.n])
        counts.append((int(matrix.tokens(end)[0]), int(matrix.characters(end)[0])))
    tokens, chars = (np.concatenate([[0], np.cumsum([c[i] for c in counts])]) for i in range(2))
    n = int(tokens[-1])
    at, seen = [], []
    for want in sorted(int(x) % (n + 1) for x in h[0, :2]):
        k = max(int(np.searchsorted(tokens, want, "right")) - 1, 0)  # the last slice before which no more tokens open
        k = min(k, len(edges) - 1)
        matrix = sliced(k)
        cut = matrix.end_of(np.array([want - tokens[k]]), np.array([0]), np.array([matrix.n]))
        at.append(int(edges[k] + cut[0]))
        seen.append(int(chars[k] + matrix.characters(cut)[0]))
    return np.array([n]), np.array([at]), np.array([seen])


def join(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else prefix + middle + suffix


def restored(form: str, output: bytes) -> bytes:
    """The text again. Marks are no part of a text that is cut, and no mark can begin within a piece and end behind it."""
    if form == "plain":
        return output
    first, _, middle = output[3:].partition(MIDDLE)
    prefix, _, suffix = first.partition(SUFFIX) if form == "psm" else first.partition(PREFIX)[::-1]
    return prefix + middle + suffix


def _forms(texts: list[bytes], h: np.ndarray, plain_share: int, spm_share: int) -> list[str]:
    whole = [not t or PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts]
    return ["plain" if w or c % 100 >= 100 - plain_share else "spm" if d % 100 < spm_share else "psm" for w, c, d in zip(whole, h[:, 2].tolist(), h[:, 3].tolist())]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_output: bool = True, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE, seed: str = SEED) -> DataFrame:
    """One row per row of df: doc_id, n, form, prefix_chars, middle_chars, output (with_output), output_sha256, restored_sha256.

    Null counts as the empty text, which is plain. A null id counts as the empty text in the draw; rows of one id
    draw alike, and repeated rows get equal results. Equal draws make an empty middle. Texts are looked at together,
    2 MB at a time, and longer ones in slices of that size, so that memory follows the longest text itself and not
    its ranks. A text that holds a mark stays plain. An empty table gives an empty one. Other columns of df are not
    looked at.
    """
    base = id_and_text(df, id_col, text_col)
    schema = schema_of(base, ("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), *((("output", "string"),) * with_output), ("output_sha256", "string"), ("restored_sha256", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                texts, h = text_bytes(part.column("text")), draws(part.column("doc_id").to_pylist(), seed)
                n, at, chars = _long_cuts(texts[0], h) if len(texts) == 1 and len(texts[0]) > PASS_BYTES else _cuts(texts, h)
                forms = _forms(texts, h, plain_share, spm_share)
                outputs = [t if f == "plain" else join(f, t[:a], t[a:b], t[b:]) for t, f, (a, b) in zip(texts, forms, at.tolist())]
                plain = np.array([f == "plain" for f in forms])
                own = [pa.array(outputs, pa.binary()).cast(pa.string())] * with_output
                sums = [pa.array([hashlib.sha256(x).hexdigest() for x in told], pa.string()) for told in (outputs, (restored(f, o) for f, o in zip(forms, outputs)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 1] - chars[:, 0], pa.int64(), mask=plain), *own, *sums], schema.names)

    return base.mapInArrow(run, schema)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """df with a column `restored`: the text that transform() was given, by column functions. Null in either column gives null."""
    p, s, m = (F.lit(x.decode()) for x in (PREFIX, SUFFIX, MIDDLE))
    output, form = F.col(output_col), F.col(form_col)
    opening, inner = F.when(form == "psm", p).otherwise(s), F.when(form == "psm", s).otherwise(p)
    body = F.substring(output, F.length(opening) + 1, F.length(output))
    first = F.substring(body, F.lit(1), F.position(m, body) - 1)
    middle = F.substring(body, F.position(m, body) + 3, F.length(body))
    left = F.substring(first, F.lit(1), F.position(inner, first) - 1)
    right = F.substring(first, F.position(inner, first) + 3, F.length(first))
    cut = F.when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))
    return df.withColumn("restored", F.when(form == "plain", output).when(form.isNotNull(), cut))
