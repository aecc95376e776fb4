"""Token ids in directly addressable codes.

A shard holds the ids of consecutive documents. Each id is split into 8-bit chunks: level 0 has the lowest
chunk of every id, and a bitmap tells which ids go on to level 1, and so forth. A rank directory holds the
number of set bits before each 512-bit block of a bitmap, so any id is read by one lookup per level, without
decoding a block. Shards are rows of a Parquet table in ascending doc_id order, with the payload as binary.

Defined results: a null or empty text has the end id alone; null doc_ids come first; repeated rows are kept;
further columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, new_path, ranges, small_batches, word_starts

END_ID = 2
#: A shard is closed after the batch of documents by which it has this many ids.
SHARD_IDS = 1 << 20
#: Words of one generation whose ids a worker keeps.
KEPT_WORDS = 600_000
MAGIC = b"TDAC"
BLOCK = 512

SHARD_SCHEMA = "part int, seq int, first_doc long, n_docs long, n_ids long, payload binary"


class Words:
    """The ids of words between white space, kept by a worker: a number for each word, and flat arrays of ids by number.

    A word of plain letters is split by the file's own pattern and each piece merged by the library's model; pieces are
    kept as words are. The library itself takes words with other marks, and those with a special token's string. What
    is kept has two generations: a word of the older one that is met again moves to the newer one."""

    def __init__(self, tokenizer_file: str):
        import regex
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special) or "(?!)").search
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # What `pieces` does by hand must be what the file says; otherwise the library takes every word.
        self.by_hand = steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall if self.by_hand else None
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}
        self.new: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.starts, self.lengths, self.ids = array("q"), array("i"), array("i")

    def turn(self) -> None:
        """Before a batch: once there are KEPT_WORDS new words, they become the old ones, and the old ones go."""
        if len(self.new) < KEPT_WORDS:
            return
        live = np.fromiter(self.new.values(), np.int64, len(self.new))
        ids, lengths = self.of(live)
        self.old, self.new = dict(zip(self.new, range(len(live)), strict=True)), {}
        self.ids, self.lengths = array("i", ids.tobytes()), array("i", lengths.tobytes())
        self.starts = array("q", (np.cumsum(lengths, dtype=np.int64) - lengths).tobytes())

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        starts, lengths = np.frombuffer(self.starts, np.int64)[numbers], np.frombuffer(self.lengths, np.int32)[numbers]
        return np.frombuffer(self.ids, np.int32)[ranges(starts, lengths)], lengths

    def number(self, word: bytes) -> int:
        at = self.new.get(word)
        if at is None:
            at = self.old.get(word)
            if at is None:
                ids = self.ids_of(word)
                at = len(self.starts)
                self.starts.append(len(self.ids))
                self.lengths.append(len(ids))
                self.ids.extend(ids)
            # What is longer than a page is not kept.
            if len(word) < 4096:
                self.new[word] = at
        return at

    def _piece(self, p: str) -> array:
        at = self.number(p.encode())
        start = self.starts[at]
        return self.ids[start : start + self.lengths[at]]

    def ids_of(self, word: bytes) -> list[int]:
        s = word.decode()
        plain = s.isascii() and s.isprintable() or (max(s) < "ɐ" and min(s) > " " and "İ" not in s and "\x85" not in s and "\xa0" not in s and unicodedata.is_normalized("NFC", s))
        if not (plain and self.by_hand) or self.special(s):
            return self.tokenizer.encode(s, add_special_tokens=False).ids
        low = s.lower()
        if low.isalpha():
            pieces = [low]
        elif low[-1] in ".," and low[:-1].isalpha():
            pieces = [low[:-1], low[-1]]
        else:
            pieces = self.split(low)
        if len(pieces) > 1 or pieces and pieces[0] != s:
            return [i for p in pieces for i in self._piece(p)]
        coded = low if s.isascii() and s.isprintable() else word.decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.tokenizer.model.tokenize(coded)] if pieces else []


@functools.lru_cache(maxsize=2)
def words_of(tokenizer_file: str) -> Words:
    return Words(tokenizer_file)


def encode_batch(texts: pa.Array, tokenizer_file: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and how many each has. The tokenizer drops white space and no piece
    crosses it, so words are encoded one by one: each distinct word of the batch once."""
    known = words_of(tokenizer_file)
    known.turn()
    starts, first, raw = word_starts(texts)
    if not len(starts):
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    # The words' bytes end to end.
    letter = ~SPACE[raw]
    ends = np.r_[0, np.cumsum(np.add.reduceat(letter, starts, dtype=np.int64))]
    kind, offsets = (pa.binary(), ends.astype(np.int32)) if len(raw) < 1 << 31 else (pa.large_binary(), ends)
    found = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[letter])]).dictionary_encode()
    distinct = found.dictionary.to_pylist()
    numbers = np.fromiter(map(known.number, distinct), np.int64, len(distinct))[found.indices.to_numpy()]
    ids, lengths = known.of(numbers)
    before = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
    return ids, np.diff(before[first])


def encode_text(text: str, tokenizer_file: str) -> list[int]:
    return encode_batch(pa.array([text]), tokenizer_file)[0].tolist()


def pack(ids: np.ndarray) -> bytes:
    """One shard's ids as levels of chunks, continuation bitmaps and rank directories."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        chunk, high = (rest & 0xFF).astype(np.uint8), rest >> 8
        goes_on = high != 0
        bits = np.packbits(goes_on, bitorder="little")
        padded = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(bits)] = bits
        ranks = np.zeros(len(padded) // (BLOCK // 8) + 1, np.uint32)
        ranks[1:] = np.cumsum(np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1))
        out.append(struct.pack("<II", len(rest), len(ranks)) + chunk.tobytes() + padded.tobytes() + ranks.tobytes())
        rest = high[goes_on]
        if not len(rest):
            return struct.pack("<4sII", MAGIC, len(ids), len(out)) + b"".join(out)


class Shard:
    """Random access to a packed shard."""

    def __init__(self, data: bytes):
        magic, self.n, levels = struct.unpack_from("<4sII", data)
        if magic != MAGIC:
            raise ValueError("not a packed shard")
        at, self.levels = 12, []
        for _ in range(levels):
            n, n_ranks = struct.unpack_from("<II", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            size = (n_ranks - 1) * BLOCK // 8
            bits = np.frombuffer(data, np.uint8, size, at)
            at += size
            ranks = np.frombuffer(data, np.uint32, n_ranks, at)
            at += 4 * n_ranks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id: a chunk, a bit and a rank per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            head = bits[block * BLOCK // 8 : (i >> 3) + 1].copy()
            head[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(head).sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        value = np.zeros(self.n, np.uint32)
        where: np.ndarray | slice = slice(None)
        for level, (chunks, bits, _) in enumerate(self.levels):
            value[where] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            goes_on = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
            where = np.flatnonzero(goes_on) if isinstance(where, slice) else where[goes_on]
        return value


def _payload(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The documents' directory, then the packed ids."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = struct.pack("<I", len(doc_ids)) + np.array([d or 0 for d in doc_ids], np.int64).tobytes() + known.tobytes() + np.array(lengths, np.uint32).tobytes()
    return head + pack(ids)


def unpack(payload: bytes) -> tuple[list, np.ndarray, Shard]:
    """doc_ids, lengths and ids of a shard."""
    (n,) = struct.unpack_from("<I", payload)
    docs = np.frombuffer(payload, np.int64, n, 4)
    known = np.frombuffer(payload, np.uint8, n, 4 + 8 * n)
    lengths = np.frombuffer(payload, np.uint32, n, 4 + 9 * n)
    return [int(d) if k else None for d, k in zip(docs, known, strict=True)], lengths, Shard(payload[4 + 13 * n :])


def write_ids(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text, append the end id and write shards in ascending doc_id order."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "first_doc": doc_ids[0], "n_docs": len(doc_ids), "n_ids": total, "payload": _payload(doc_ids, np.concatenate(lengths), np.concatenate(parts))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for b in batches:
            ids, n = encode_batch(b["text"], tokenizer_file)
            whole = np.full(len(ids) + len(n), end_id, np.uint32)
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            doc_ids += b["doc_id"].to_pylist()
            lengths.append(n + 1)
            parts.append(whole)
            total += len(whole)
            if total >= SHARD_IDS:
                yield shard()
                seq, doc_ids, lengths, parts, total = seq + 1, [], [], [], 0
        if doc_ids:
            yield shard()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = documents(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    in_order.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, doc_id, local_start, n_tokens, ids_crc32 of each document, from the shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, payload in zip(b["part"].to_pylist(), b["seq"].to_pylist(), b["payload"].to_pylist(), strict=True):
                doc_ids, lengths, packed = unpack(payload)
                raw = memoryview(packed.all().astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "seq", "pos", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    small_batches(spark)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    return shards.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, pos int, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, before: ids in all earlier shards. Sums by part, then a running sum over the few parts."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).select("part", "seq", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("inside", inside).join(parts.withColumn("parts_before", before).select("part", "parts_before"), "part").select("part", "seq", (F.col("inside") + F.col("parts_before")).alias("before"))


def write_and_read(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: write all shards, then read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "dac")
    write_ids(docs, tokenizer_file, path)
    rows = read_ids(spark, path).join(shard_starts(spark, path), ["part", "seq"])
    return rows.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
