"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where no match of the splitting pattern can cross: before white space that follows another
character. Of a run of white space the pattern takes all but the last character as one match, or all at the end of a
text; long runs are encoded as that match, since the pattern's engine gives up on them. Decoding joins the raw bytes
of the ids, so it needs no valid UTF-8 in between.

Defined results: a null or empty text gives no ids; repeated rows are encoded each; further columns are
left out; an empty table gives an empty one. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

#: Characters encoded at once; longer texts are cut at the next safe boundary.
PIECE_CHARS = 1 << 14
#: Fixed: what the pattern's engine takes as white space (the Unicode property).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(rf"(?<=[^{_WHITE}])(?=[{_WHITE}])")
#: Longer runs of white space are encoded as one match.
RUN_CHARS = 1 << 12
_RUN = re.compile(rf"[{_WHITE}]{{{RUN_CHARS},}}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tokenizer, built once per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """The text in order, cut at safe boundaries at least `size` characters apart, and whether a piece is one match."""
    start = 0
    for run in (*_RUN.finditer(text), None):
        end = run.start() if run else len(text)
        while end - start > size:
            cut = _SAFE.search(text, start + size, end)
            if cut is None:
                break
            yield text[start : cut.start()], False
            start = cut.start()
        yield text[start:end], False
        if run:
            start = run.end() - (run.end() < len(text))
            yield text[end:start], True


def encode_text(text: str, rank_file: str, pattern: str) -> list[int]:
    enc = encoding(rank_file, pattern)
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for piece, whole in pieces(text) for i in (enc._encode_single_piece(piece) if whole else enc.encode_ordinary(piece))]


def decode_ids(ids: list[int], rank_file: str, pattern: str) -> bytes:
    return encoding(rank_file, pattern).decode_bytes(ids)


def encode(docs: DataFrame, rank_file: str, pattern: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids array<int>, and the columns in `kept`: the token ids of each whole text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.struct(*kept).alias("kept")) if kept else documents(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode_text(t, rank_file, pattern) for t in b["text"].to_pylist()]
            extra = [b["kept"]] if kept else []
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32())), *extra], ["doc_id", "ids", *["kept"] * bool(kept)])

    schema = "doc_id long, ids array<int>" + (f", kept {rows.schema['kept'].dataType.simpleString()}" if kept else "")
    out = rows.mapInArrow(run, schema)
    return out.select("doc_id", *(F.col(f"kept.`{c}`").alias(c) for c in kept), "ids") if kept else out


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, bytes: what the ids stand for; null ids give no bytes."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [decode_ids(i or [], rank_file, pattern) for i in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode each text in one pass and digest both."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        decimal = [str(i) for i in range(encoding(rank_file, pattern).n_vocab)]
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b["text"].to_pylist():
                ids = encode_text(text, rank_file, pattern)
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(sha(decode_ids(ids, rank_file, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
