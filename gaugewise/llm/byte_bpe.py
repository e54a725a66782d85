"""Byte-level BPE over Arrow batches: encoding with offsets by the tokenizers library, and decoding by the byte table."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugewise.llm.common import id_and_text, passes, schema_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SPAN = ("start", "end", "first_char", "end_char")


@lru_cache(1)
def byte_to_char() -> list[str]:
    """The printable stand-in of each byte: bytes that print as themselves in Latin-1 do, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [chr(others.get(b, b)) for b in range(256)]


@lru_cache(1)
def char_to_byte() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_to_char())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes this one: what its bytes come to under lower ranks alone."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[at] + parts[at + 1], own) >= own:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    if len(parts) != 2:
        raise ValueError(f"rank {own} is not the merge of two lower ranks")
    return parts[0], parts[1]


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBPE:
    """Encodes texts match by match of the pattern; pieces of text that recur are looked up.

    Encoding is by the tokenizers library on the stand-in characters of the bytes, so the library's offsets count
    bytes. Decoding looks the library's token strings up in the reversed table of stand-ins, and puts the bytes
    together before it reads characters, as a token may hold a part of one.
    """

    #: Distinct pieces of text that are remembered; then the memory starts anew.
    REMEMBERED = 400_000

    def __init__(self, ranks: dict[bytes, int], split: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        as_chars = str.maketrans({b: c for b, c in enumerate(byte_to_char())})
        self.stand_in = lambda raw: raw.decode("latin-1").translate(as_chars)
        merges = [tuple(map(self.stand_in, _parts(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        self.bpe = Tokenizer(BPE({self.stand_in(t): r for t, r in ranks.items()}, merges, cache_capacity=0))
        self.tokens = {i: self.decode_chars(self.bpe.id_to_token(i)) for i in ranks.values()}
        self.find = regex.compile(split).findall
        self.memory: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: list[str]) -> None:
        if len(self.memory) + len(pieces) > self.REMEMBERED:
            self.memory.clear()
        raw = [p.encode() for p in pieces]
        for p, e in zip(pieces, self.bpe.encode_batch_fast([self.stand_in(r) for r in raw], add_special_tokens=False)):
            self.memory[p] = tuple(e.ids)

    def encode(self, text: str) -> list[int]:
        pieces = self.find(text)
        try:
            return [i for p in pieces for i in self.memory[p]]
        except KeyError:
            self._learn(list({p for p in pieces if p not in self.memory}))
            if all(p in self.memory for p in pieces):
                return [i for p in pieces for i in self.memory[p]]
            return [i for p in pieces for i in (self.memory.get(p) or self._learn([p]) or self.memory[p])]

    def offsets(self, text: str) -> list[tuple[int, int, int, int]]:
        """What each token covers: first byte, end in bytes, first character, end in characters; a character that a token holds in part counts."""
        pieces = self.find(text)
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte is of
        known = list(dict.fromkeys(pieces))
        spans = {p: e.offsets for p, e in zip(known, self.bpe.encode_batch([self.stand_in(p.encode()) for p in known], add_special_tokens=False))}
        out, start = [], 0
        for p in pieces:
            out += [(start + a, start + b, int(char[start + a]), int(char[start + b - 1]) + 1) for a, b in spans[p]]
            start += len(p.encode())
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that the ids hold, by the reversed table of stand-ins."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text; a character that the ids hold only in part becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_chars(self, chars: str) -> bytes:
        """The bytes behind stand-in characters, as the tokenizers library returns tokens."""
        return bytes(map(char_to_byte().__getitem__, chars))


@lru_cache(2)
def load(path: str, split: str) -> ByteBPE:
    """One encoder a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBPE(read_ranks(path), split)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, split: str | None = None, with_ids: bool = True, with_offsets: bool = False) -> DataFrame:
    """One row per row of df: doc_id, n_tokens, ids (with_ids), offsets (spans in bytes and in characters; with_offsets), ids_sha256, decoded_sha256.

    Each match of the pattern is encoded by itself, without special tokens; their strings are ordinary text. Null
    counts as the empty text, which has no tokens. ids_sha256 is of the decimal ids joined by commas, decoded_sha256
    of the bytes that the ids decode to. Texts are encoded whole, one at a time, so memory follows the longest text.
    Repeated rows get equal results; an empty table gives an empty one. Other columns of df are not looked at.
    """
    base = id_and_text(df, id_col, text_col)
    path, split = path or vocabulary_path(), split or pattern()
    more = (("ids", "array<int>"),) * with_ids + (("offsets", "array<struct<start:int,end:int,first_char:int,end_char:int>>"),) * with_offsets
    schema = schema_of(base, ("n_tokens", "long"), *more, ("ids_sha256", "string"), ("decoded_sha256", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, split)
        text_of = [str(i) for i in range(max(bpe.tokens) + 1)].__getitem__
        for batch in batches:
            for part in passes(batch):
                n, ids_of, offsets_of, id_sums, sums = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = bpe.encode(text)
                    n.append(len(ids))
                    id_sums.append(hashlib.sha256(",".join(map(text_of, ids)).encode()).hexdigest())
                    sums.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
                    if with_ids:
                        ids_of.append(np.array(ids, np.int32))
                    if with_offsets:
                        offsets_of.append([dict(zip(SPAN, x)) for x in bpe.offsets(text)])
                lists = [pa.array(ids_of, pa.list_(pa.int32()))] * with_ids + [pa.array(offsets_of, pa.list_(pa.struct([(x, pa.int32()) for x in SPAN])))] * with_offsets
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists, pa.array(id_sums, pa.string()), pa.array(sums, pa.string())], schema.names)

    return base.mapInArrow(run, schema)
