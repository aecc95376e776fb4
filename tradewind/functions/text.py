"""Text functions as column expressions."""

from __future__ import annotations

import json
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..session import ship_package

def _folding() -> tuple[str, str]:
    """The characters that folding replaces, and by what; those without a counterpart go. By Unicode's own rule: a lower
    case letter whose canonical decomposition is a plain letter and marks is that letter, and marks are nothing. The d with
    a stroke has no decomposition; it counts as d."""
    known, marks = {"đ": "d"}, []
    for code in range(0x80, 0x10000):
        character = chr(code)
        if unicodedata.category(character) == "Mn":
            marks.append(character)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFD", character) if unicodedata.category(c) != "Mn").lower()
        if plain != character and len(plain) == 1 and plain.isascii():
            known[character] = plain
    return "".join(known) + "".join(marks), "".join(known.values())


_FROM, _TO = _folding()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), _FROM, _TO)


@pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """A text in composed form, with plain spaces, quotes and breaks: hard spaces as spaces, curly quotes as straight ones,
    spaces squeezed, at most one blank line in a row. Null is an empty text."""
    ship_package(SparkSession.active())
    # Fixed: the characters that stand for others.
    plain = F.translate(_composed(F.coalesce(text, F.lit(""))), "\u00a0\u201c\u201d\u2019", " \"\"'")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Fixed: what separates the words of a match form.
SEPARATORS = r"[^a-z0-9_/%.-]+"


def match_form(text: Column) -> Column:
    """What questions and texts are matched by: folded letters, digits and _/%.- only."""
    # White space is a separator too, so runs of it are single spaces already.
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def header_form(text: Column) -> Column:
    """Column headers: folded, other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def unigrams(text: Column) -> Column:
    """The words of a text's match form."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def pairs(words: Column) -> Column:
    """Neighbouring words joined by an underscore."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b))


def with_bigrams(text: Column) -> Column:
    """The words of a text's match form, n of them, and the n - 1 pairs of neighbours, joined by an underscore."""
    words = unigrams(text)
    return F.concat(words, pairs(words))


def clean_text(text: Column) -> Column:
    """No NULs or carriage returns, spaces squeezed in each line, at most one blank line in a row."""
    t = F.regexp_replace(F.regexp_replace(text, "\x00", ""), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t ]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


#: Fixed: what stands for an element's end in plain text. Every other tag is a space.
BREAKS = {"\n\n": ("p", "h1", "h2", "h3", "h4", "h5", "h6"), "\n": ("div",)}
#: The named characters of HTML that end in a semicolon, from Python's own table of the standard.
NAMED = {name.removesuffix(";"): character for name, character in html5.items() if name.endswith(";")}
# And the numbers that mean another character than their own: those of windows-1252.
NAMED |= {f"#{n}": c for n in range(128, 160) if (c := bytes([n]).decode("windows-1252", "ignore"))}


def unescaped(text: Column) -> Column:
    """Character references by name or number as their characters; others stay. Each is read once: what it gives is no
    reference again. Numbers from 128 to 159 mean what they do in windows-1252; those of no character, U+FFFD."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.regexp_replace(name, "^#[xX]?", "")
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(name.startswith("#"), digits).try_cast("int")
        wide = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        by_number = F.when(known, F.coalesce(F.try_element_at(names, F.concat(F.lit("#"), code.cast("string"))), wide(code))).when(code.isNotNull(), "\ufffd")
        character = F.coalesce(by_number, F.try_element_at(names, name))
        return F.when((name != "") & character.isNotNull(), F.concat(character, F.substring(part, F.length(name) + 2, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&", -1)
    rest = F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), read), "")
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(parts, F.lit(0)), rest)).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text of a page: comments, scripts and styles go, elements' ends break lines, tags go, references are read."""
    hidden = "<!--.*?-->|" + "|".join(f"<{e}\\b.*?</{e}\\s*>" for e in ("script", "style"))
    text = F.regexp_replace(html, f"(?is){hidden}", " ")
    for line, elements in BREAKS.items():
        ends = f"</(?:{'|'.join(elements)})\\s*>" + (r"|<br\s*/?>" if line == "\n" else "")
        text = F.regexp_replace(text, f"(?i){ends}", line)
    text = unescaped(F.regexp_replace(text, "<[^>]+>", " "))
    return clean_text(text)


def token_set(text: Column) -> Column:
    """Distinct words of three letters or more that aren't numbers."""
    return F.array_distinct(F.filter(unigrams(text), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$")))


#: Fixed: what people type to try a box out.
NOISE = (
    "haha", "hahaha", "hahahaha", "hehe", "hehehe", "hihi", "hihihi", "abc", "abcd", "abcxyz", "test", "testing", "alo", "ok", "oke", "kkkk", "lol", "sadsadsadsa",
    "asdf", "asdfgh", "qwerty", "qwertyuiop",
)


def gibberish(text: Column) -> Column:
    """No letters or digits, digits alone, known noise, laughter, one letter repeated, or a long run with at most one vowel."""
    t = F.regexp_replace(match_form(text), "[^a-z0-9]+", "")
    vowels = F.length(t) - F.length(F.regexp_replace(t, "[aeiouy]", ""))
    repeated = t.rlike(r"^(?:(?:ha){2,}|(?:he){2,}|(?:hi){2,}|(?:sad){2,}[a-z]*|([a-z])\1{3,})$")
    return (t == "") | t.rlike("^[0-9]+$") | t.isin(*NOISE) | repeated | ((F.length(t) >= 7) & (vowels <= 1))


def one_edit_apart(a: Column, b: Column) -> Column:
    """One letter more or less, or two neighbours swapped; a replaced letter doesn't count."""
    n, m = F.length(a), F.length(b)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first = F.get(differ, F.lit(0))
    swapped = (F.size(differ) == 2) & (F.get(differ, F.lit(1)) == first + 1) & (F.substring(a, first, F.lit(1)) == F.substring(b, first + 1, F.lit(1))) & (F.substring(a, first + 1, F.lit(1)) == F.substring(b, first, F.lit(1)))
    return F.when(a == b, F.lit(False)).when(n == m, F.coalesce(swapped, F.lit(False))).otherwise((F.abs(n - m) == 1) & (F.levenshtein(a, b) == 1))
