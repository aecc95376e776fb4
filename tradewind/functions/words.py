"""The words of texts, cut a batch of texts at a time: what functions.text.unigrams gives, as arrays."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes of words; in folded text all others separate them, those of other letters too.
WORD = np.zeros(256, bool)
WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_/%.-")] = True


@functools.cache
def _marks() -> str:
    """A pattern of the marks that folding drops: those of functions.text's table."""
    codes = [code for code in range(0x80, 0x10000) if unicodedata.category(chr(code)) == "Mn"]
    firsts = [c for c, before in zip(codes, [0, *codes], strict=False) if c != before + 1]
    lasts = [c for c, after in zip(codes, [*codes[1:], 0], strict=True) if c + 1 != after]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(firsts, lasts, strict=True)) + "]+"


def folded(texts: pa.Array) -> pa.Array:
    """Lower case without accents. Other letters than a to z may come out decomposed; they separate words either way."""
    low = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    return pc.replace_substring(pc.replace_substring_regex(pc.utf8_normalize(low, form="NFD"), _marks(), ""), "đ", "d")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, one text's after the other's, and where each text's begin (one place more than there are texts). A null
    text has none."""
    form = folded(texts)
    _, places, data = form.buffers()
    places = np.frombuffer(places, np.int64)[form.offset : form.offset + len(form) + 1] if len(form) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.empty(0, np.uint8)
    places = places - places[0]
    inside = WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    tops = places[:-1][places[:-1] < places[1:]]
    begins[tops] = inside[tops]
    starts = np.flatnonzero(begins[inside])
    kept = raw[inside]
    offsets = np.append(starts, len(kept)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return found, np.searchsorted(np.flatnonzero(begins), places)
