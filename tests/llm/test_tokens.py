import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tradewind.llm import bpe, dac

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, part int"


def texts():
    rng = random.Random(5)
    chars = "abcdeÉéßñäİΣ'ſ9²½ \n\t\r\xa0\x85\x7f ́̀中🙂.,!-|"
    odd = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return ["", " ", "\n\n", "plain words, here.", "It's THEIR'S'T don't", "x" * 40_000, "ab \n " * 9_000, "<|endoftext|> a <|startoftext|>", "ab<|endoftext|>cd, <|ENDOFTEXT|><|startoftext|><|endoftext|", "é é", *odd]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)


def test_bpe_equals_library_and_round_trips(spark):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*enumerate(texts()), (500, None), (3, "plain words, here.")]
    got = bpe.round_trip(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    by = {i: t or "" for i, t in rows}
    for r in got:
        ids = enc.encode_ordinary(by[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by[r.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == by


def by_pieces(text, size):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    return [i for p, whole in bpe.pieces(text, size) for i in (enc._encode_single_piece(p) if whole else enc.encode_ordinary(p))]


def test_bpe_cuts_are_safe(monkeypatch):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "_RUN", re.compile(bpe._RUN.pattern.replace("{4096,}", "{3,}")))
    rng = random.Random(9)
    odd = ["".join(rng.choice("ab1!\x1c\x85\u2003\u200b  \n\t'sé") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for text in [*odd, " ".join("word%d\n\n  x" % i for i in range(3000)), "   ", "a    ", "    a", "\n\n\n\na", "   \n   b  \n c"]:
        for size in (2, 50):
            assert "".join(p for p, _ in bpe.pieces(text, size)) == text
            assert by_pieces(text, size) == enc.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 1_000_000 + "x", " \n\t" * 400_000, "a" + " \r\n" * 400_000 + ".b", "x" * 1_000_000, "\u3000" * 300_000 + " y"])
def test_bpe_very_long_runs(text):
    ids = bpe.encode_text(text, RANKS, public_tokenizers.PATTERN)
    assert bpe.decode_ids(ids, RANKS, public_tokenizers.PATTERN).decode() == text
    # A run is one match, but for its last character before other text: so a shorter run of the kind tells the tail.
    n = len(text) - len(text.lstrip()) or len(text)
    short = text[:30] + text[n - 30 :] if n > 60 and text[n:] else None
    if short and text[0] != "x":
        assert ids[-3:] == bpe.encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary(short)[-3:]


def test_ids_equal_library_and_read_back(spark):
    tok = Tokenizer.from_file(WORDS)
    rows = [*enumerate(texts()), (500, None), (3, "plain words, here.")]
    got = sorted(dac.write_and_read(frame(spark, rows), WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    by, start = {i: t or "" for i, t in rows}, 0
    for r in got:
        ids = [*tok.encode(by[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (start, len(ids)), repr(by[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), repr(by[r.doc_id])
        start += len(ids)


def test_kept_words_turn_over(monkeypatch):
    """Words move from one generation to the next and keep their ids."""
    monkeypatch.setattr(dac, "KEPT_WORDS", 30)
    known = dac.Words(WORDS)
    monkeypatch.setattr(dac, "words_of", lambda f: known)
    tok, rng = Tokenizer.from_file(WORDS), random.Random(2)
    for _ in range(60):
        batch = [" ".join(rng.choice(["the", "of", "Words,", "don't", f"n{rng.randrange(99)}", "a\tb", "É.", "<|endoftext|>x"]) for _ in range(rng.randint(0, 20))) for _ in range(5)]
        ids, n = dac.encode_batch(pa.array(["left out", *batch]).slice(1), WORDS)
        want = [tok.encode(t, add_special_tokens=False).ids for t in batch]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_random_access(n):
    rng = np.random.default_rng(n)
    ids = rng.choice(np.array([0, 5, 255, 256, 65535, 65536, 2**31], np.uint32), n)
    shard = dac.Shard(dac.pack(ids))
    assert np.array_equal(shard.all(), ids)
    assert [shard[i] for i in range(n)] == ids.tolist()
    with pytest.raises(IndexError):
        shard[n]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert dac.write_and_read(none, WORDS).count() == 0
