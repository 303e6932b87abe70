"""Packing of token sequences to a target mixture of sources by deficit round-robin.

Each window (sequence) credits every source with its share of the window; a source with
credit gives tokens of its queue up to its credit, and what it couldn't give, or gave beyond,
stays as its deficit for the next window. Partitions hold a bounded number of tokens
and start with the deficits that the partitions before them end with, which follow from
token counts alone, so all partitions run at once.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import bytes_digest, file_bytes, held, small_batches, stored

#: Entries that a worker remembers; when they are reached it starts again.
MEMO = 1_000_000
#: Bytes of the words that a worker remembers, likewise.
MEMO_BYTES = 32 << 20


#: The splitting pattern for which words can be encoded one by one: letters, single digits, runs of other signs.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens:
    """Ids of whole texts by a tokenizer, with a memory of words.

    Where the tokenizer lower-cases, drops white space and merges within words only, texts are
    cut at blanks and line feeds and each word is encoded once by the library. Texts with the
    string of an added token, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(data.decode())
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo: dict[bytes, bytes] = {}
        self.memo_bytes = 0
        self.cut = regex.compile(_PATTERN).findall
        #: ASCII and the letters of Latin and Cyrillic blocks that have been full for long.
        self.plain = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u045f]*").fullmatch
        #: A capital before a sign beyond U+02FF, which may be a combining mark.
        self.marked = re.compile(rb"[A-Z][\xcc-\xff]").search
        spec = json.loads(data)
        self.apart = self._by_words(spec)
        self.added = [t["content"].encode().lower() for t in spec.get("added_tokens", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        #: Two bytes an id where the vocabulary allows.
        self.kind = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True

    @staticmethod
    def _by_words(spec: dict) -> bool:
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        cut = steps[0]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        removed = cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") and cut["pattern"].get("Regex") == _PATTERN
        plain = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
        whole = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", []))
        return bool(removed and plain and kinds == ["NFC", "Replace", "Lowercase"] and not whole and not spec.get("post_processor"))

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        size = sum(map(len, words))
        if len(self.memo) + len(words) > MEMO or self.memo_bytes + size > MEMO_BYTES:
            self.memo.clear()
            self.memo_bytes = 0
        self.memo_bytes += size
        texts = b" ".join(words).decode().split(" ")
        # the splitting pattern sees the normalised text: a word that normalising changes, such as one with U+0130, is left to the
        # library, and so is one with signs that one edition of Unicode calls letters and another doesn't
        stays = self.tok.normalizer.normalize_str
        cut = {w: self.cut(t) for w, t in zip(words, texts, strict=True) if not t.isalpha() and "'" not in t and (t.isascii() or self.plain(t) and stays(t) == t)}
        parts = {p for ps in cut.values() for p in ps if p.encode() not in self.memo}
        letters = {t: w for w, t in zip(words, texts, strict=True) if t.isalpha()} | {p: p.encode() for p in parts if p.isalpha()}
        names, keys = [*letters], [*letters.values()]
        # a word of letters is one stretch of merges, and its last id says that it ends
        for at in range(0, len(names), 2000):
            part = names[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and (not len(ends) or ends[-1] == len(ids)):
                raw, ends = ids.tobytes(), (ids.itemsize * ends).tolist()
                self.memo.update(zip(keys[at : at + 2000], [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                self._each(part)
        self._each([p for p in parts if not p.isalpha()])
        # other words are the words that the splitting pattern sees in them
        for w, ps in cut.items():
            self.memo[w] = b"".join([self.memo[p.encode()] for p in ps])
        self._each([w.decode() for w in words if w not in self.memo])

    def _each(self, texts: list[str]) -> None:
        for t, e in zip(texts, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.memo[t.encode()] = np.array(e.ids, self.kind).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each whole UTF-8 text, each of the width of ``kind``."""
        if not self.apart:
            return [self._whole(t) for t in texts]
        known, out, open_ = self.memo.get, [], []
        missing: set[bytes] = set()
        for text in texts:
            low = text.lower()  # A-Z only; the library lower-cases the rest
            marked = self.marked(text)
            if any(a in low for a in self.added):
                out.append([self._whole(text)])
                continue
            # the library composes letters and marks before it lower-cases
            words = (text if marked else low).replace(b"\n", b" ").split(b" ")
            ids = [*map(known, words)]
            if None in ids:
                places = [i for i, x in enumerate(ids) if x is None]
                at = [words[i] for i in places]
                missing.update(at)
                open_.append((ids, places, at))
            out.append(ids)
        if missing:
            self._learn([*missing])
            for ids, places, at in open_:
                for i, w in zip(places, at, strict=True):
                    ids[i] = self.memo[w]
        return [b"".join(x) for x in out]


def _loaded(data: bytes, key: str) -> WordTokens:
    return held(("words", key), lambda: WordTokens(data))


def tokenise(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int | None = None) -> DataFrame:
    """(id, source, ids, n_tokens): ``ids`` is binary, little-endian, unsigned, of 16 bits an id if the vocabulary has no more than 65536,
    else 32, ``end_id`` appended; a null text is empty, a null source is one source. Texts are encoded whole, however long. Repeated rows are
    rows of their own; other columns, whatever their names, stay behind. An empty table gives an empty table."""
    data = file_bytes(tokenizer_path)
    key = bytes_digest(data)
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded(sent.value, key)
        end = np.array([] if end_id is None else [end_id], words.kind).tobytes()
        width = np.dtype(words.kind).itemsize
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids = [x + end for x in words.encode([t or b"" for t in b.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64())], names=["id", "source", "ids", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, source string, ids binary, n_tokens bigint")


class Rounds:
    """Deficit round-robin over queues of (document, tokens); ``window`` gives the pieces of the next window."""

    def __init__(self, shares: dict, deficits: dict, least: int):
        self.shares, self.least = shares, least
        self.deficit = dict(deficits)
        self.queues: dict = {}
        self.left = 0

    def add(self, source, doc: int, tokens: int) -> None:
        if tokens:
            self.queues.setdefault(source, deque()).append([doc, 0, tokens])
            self.left += tokens

    def _serve(self, source, most: int, out: list) -> int:
        queue, given = self.queues[source], 0
        while given < most and queue:
            doc, at, end = queue[0]
            n = min(most - given, end - at)
            out.append((doc, at, n))
            given += n
            if at + n == end:
                queue.popleft()
            else:
                queue[0][1] = at + n
        if not queue:
            del self.queues[source]
        self.deficit[source] = self.deficit.get(source, 0.0) - given
        self.left -= given
        return given

    def window(self, size: int) -> list[tuple[int, int, int]]:
        """Pieces (document, start, length) that fill ``size`` tokens, or all that are left."""
        out: list[tuple[int, int, int]] = []
        for s in self.queues:
            self.deficit[s] = self.deficit.get(s, 0.0) + self.shares.get(s, 0.0) * size
        room = min(size, self.left)
        for s in sorted(self.queues, key=lambda s: (-self.deficit[s], s is None, s or "")):
            # a credit below the least piece is carried on
            credit = int(self.deficit[s])
            if room and credit >= min(self.least, room):
                room -= self._serve(s, min(credit, room), out)
        while room:
            # rounding and dry queues leave room: it goes to whoever is owed most
            s = max(self.queues, key=lambda s: (self.deficit[s], s is None, s or ""))
            room -= self._serve(s, min(room, max(self.least, int(self.deficit[s]))), out)
        return out


def _before(counts: DataFrame, keys: list[str], run: int = 1024) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over lower ``part`` with the same keys, first within runs of parts, then over the runs."""
    runs = counts.withColumn("run", F.floor(F.col("part") / run))
    ahead = lambda order, *by: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = runs.groupBy(*keys, "run").agg(F.sum("n").alias("t")).withColumn("earlier", zero(F.sum("t").over(ahead("run", *keys)))).drop("t")
    inner = runs.withColumn("inside", zero(F.sum("n").over(ahead("part", *keys, "run"))))
    return inner.join(totals, [*keys, "run"]).withColumn("before", F.col("earlier") + F.col("inside")).drop("earlier", "inside", "run")


def pack(tokens: DataFrame, *, window: int = 4096, shares: dict[str | None, float] | None = None, partition_tokens: int = 1 << 21, least_piece: int = 256, with_ids: bool = True) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): every token in exactly one piece.

    ``tokens``: as ``tokenise`` gives; the pieces' ids are little-endian unsigned 32-bit. ``shares``: each source's part of the tokens of a window;
    by default its part of all tokens, so that no queue runs dry early. Sources without a share
    fill what room there is. Documents are cut where a window or a credit ends. All
    sequences but a partition's last are full; the rest of a partition goes to sequences of the
    largest powers of two, so nothing is padded. A partition takes about
    ``partition_tokens``, never less than a whole document. Without ``with_ids`` the ids
    stay behind and only their CRC-32 is given. Rows of one id are packed as documents of their own, each with
    ``start`` from 0; a row without tokens has no piece. An empty table gives an empty table.
    """
    small_batches(tokens.sparkSession)
    kept = stored(tokens.select("id", "source", "ids", "n_tokens").withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = kept.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, math.ceil(total / partition_tokens))
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    name = F.to_json(F.struct("source"))  # a null source is a source too
    counts = stored(dealt.groupBy("part", "source").agg(F.sum("n_tokens").alias("n")).withColumn("name", name), "part-tokens")
    if shares is None:
        wanted = counts.groupBy("name").agg((F.sum("n") / F.lit(max(1, total))).alias("share"))
    else:
        wanted = tokens.sparkSession.createDataFrame([*shares.items()], "source string, share double").select(name.alias("name"), "share")
    # what a source is owed where a partition starts: its share of all tokens before, less its own
    gone = _before(counts.groupBy("part").agg(F.sum("n").alias("n")), []).select("part", F.col("before").alias("gone"))
    owed = _before(counts, ["name"]).join(gone, "part").join(wanted, "name", "left")
    share = F.coalesce("share", F.lit(0.0))
    owed = owed.select("part", "source", share.alias("share"), (share * F.col("gone") - F.col("before")).alias("deficit"))
    kind = dict(tokens.dtypes)["id"]

    def run(docs: pa.Table, start: pa.Table) -> pa.Table:
        docs = docs.sort_by("row")
        names = start.column("source").to_pylist()
        rounds = Rounds(dict(zip(names, start.column("share").to_pylist(), strict=True)), dict(zip(names, start.column("deficit").to_pylist(), strict=True)), least_piece)
        sizes = docs.column("n_tokens").to_pylist()
        for i, (s, n) in enumerate(zip(docs.column("source").to_pylist(), sizes, strict=True)):
            rounds.add(s, i, n)
        part = docs.column("part")[0].as_py() if docs.num_rows else 0
        flat = docs.column("ids").combine_chunks()
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        width = int(ends[-1] - ends[0]) // max(1, sum(sizes)) or 4
        every = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16 if width == 2 else np.uint32).astype("<u4").view(np.uint8) if sum(sizes) else np.zeros(0, np.uint8)
        starts = ((ends - ends[0]) // width).tolist()
        view = memoryview(every)
        at, begin, size, ids, crc, sequence, offset = [], [], [], [], [], [], []
        number = part << 32
        while rounds.left:
            full = window if rounds.left >= window else 1 << (rounds.left.bit_length() - 1)
            place = 0
            merged: list[list[int]] = []
            for d, s, n in rounds.window(full):
                if merged and merged[-1][0] == d and merged[-1][1] + merged[-1][2] == s:
                    merged[-1][2] += n
                else:
                    merged.append([d, s, n])
            for d, s, n in merged:
                at.append(d)
                begin.append(s)
                size.append(n)
                piece = view[4 * (starts[d] + s) : 4 * (starts[d] + s + n)]
                crc.append(zlib.crc32(piece))
                if with_ids:
                    ids.append(bytes(piece))
                sequence.append(number)
                offset.append(place)
                place += n
            number += 1
        whole = docs.column("id").take(pa.array(at, pa.int64()))
        real = {"ids": pa.array(ids, pa.binary())} if with_ids else {}
        return pa.table({"id": whole, "start": pa.array(begin, pa.int64()), "length": pa.array(size, pa.int64()), **real, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array([sizes[i] for i in at], pa.int64()), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    schema = f"id {kind}, start bigint, length bigint, {'ids binary, ' if with_ids else ''}ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("part").cogroup(owed.groupBy("part")).applyInArrow(run, schema)
