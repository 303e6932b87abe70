"""Byte-level BPE by way of a sentencepiece model that is written straight from the vocabulary.

Every byte string of the vocabulary becomes a piece in which each byte is one printable
character; its score is its negative rank, so the merge of the best score is the merge of
the lowest rank. The text is cut into pre-tokens first, and no merge crosses one.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import add_in_arrow, bytes_digest, file_bytes, held

#: Unicode's White_Space; the spellings of \s differ between regular expression libraries.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries that a worker remembers; when they are reached it starts again.
MEMO = 400_000
#: Longer chunks aren't remembered, so that the memo is bounded in bytes too.
LONG = 64


def byte_characters() -> list[str]:
    """For each byte a printable character: itself where it prints, else the next from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto: piece i is the byte string of rank i, the unknown piece comes last.

    Fields as in sentencepiece_model.proto: pieces 1 (piece 1, score 2, type 3), trainer_spec 2
    (model_type 3, vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43), normalizer_spec 3
    (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    pieces = [_block(1, _block(1, "".join(chars[b] for b in token).encode()) + b"\x15" + struct.pack("<f", -rank) + _number(3, 1)) for token, rank in by_rank]
    pieces.append(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", -len(by_rank)) + _number(3, 2)))
    absent = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(by_rank)) + _number(41, absent) + _number(42, absent) + _number(43, absent)
    normal = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normal)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: on each line the token in base64, a space and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class ByteBpe:
    """Encoder and decoder; texts to arrays of ids and back to bytes.

    A pre-token that is itself in the vocabulary is that one token, as in the rank file's own
    library; any other is encoded by the model.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.ranks = ranks
        self.chars = str.maketrans(dict(enumerate(byte_characters())))
        self.split = regex.compile(_spelled(pattern)).findall
        self.chunks = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        tokens = sorted(ranks, key=ranks.get)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.memo: dict[str, bytes] = {}

    def _pretoken(self, token: str) -> list[int]:
        raw = token.encode()
        rank = self.ranks.get(raw)
        return [rank] if rank is not None else self.model.encode(raw.decode("latin-1").translate(self.chars))

    def _chunk(self, chunk: str) -> bytes:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        ids = [i for t in self.split(chunk) for i in self._pretoken(t)]
        out = np.array(ids, np.int32).tobytes()
        if len(chunk) <= LONG:
            self.memo[chunk] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text. White space and what follows it up to the next white space are
        encoded together and remembered: no pre-token goes beyond them."""
        memo, parts = self.memo.get, []
        for c in self.chunks(text):
            ids = memo(c)
            parts.append(self._chunk(c) if ids is None else ids)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes()


def _spelled(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out; inside a class the bare characters, outside it a class."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append({r"\s": SPACE if inside else f"[{SPACE}]", r"\S": f"[^{SPACE}]"}.get(c, c))
        i += len(c)
    return "".join(out)


def _loaded(data: bytes, pattern: str) -> ByteBpe:
    return held(("bytes", bytes_digest(data + pattern.encode())), lambda: ByteBpe(read_ranks(data), pattern))


def encode_column(df: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids (array of int) of the whole text; null counts as empty, which has no ids. A column of that name is replaced,
    others pass, rows repeat as they are, an empty table gives an empty table. ``pattern`` must never match from a sign into following white space (as those
    of the public byte-level vocabularies): white space and what follows it are encoded by themselves."""
    sent = df.sparkSession.sparkContext.broadcast(file_bytes(ranks_path))

    def work(texts: pa.Array) -> list[pa.Array]:
        bpe = _loaded(sent.value, pattern)
        ids = [bpe.encode(cell.as_py() or "") for cell in texts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))]

    return add_in_arrow(df, text_col, {out: T.ArrayType(T.IntegerType())}, work)


def decode_column(df: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes (binary) that the ids stand for, which need not be valid UTF-8; null and empty arrays give no bytes.
    Other columns pass, one of that name is replaced, an empty table gives an empty table."""
    sent = df.sparkSession.sparkContext.broadcast(file_bytes(ranks_path))

    def work(column: pa.Array) -> list[pa.Array]:
        bpe = _loaded(sent.value, pattern)
        return [pa.array([bpe.decode(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32)) for x in column], pa.binary())]

    return add_in_arrow(df, ids_col, {out: T.BinaryType()}, work)
