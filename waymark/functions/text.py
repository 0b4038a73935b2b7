"""Strings: folding, trigrams, Jaro-Winkler, plain text, perishable claims, identifiers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What loses its truth soon: hours, clock times, prices and fees (fixed values).
PERISHABLE = (
    r"\b(open|opens|opening|closed|closes|closing)\b.{0,25}\b(at|from|until|till|monday|tuesday|wednesday|thursday|friday|saturday|sunday|daily|weekday|weekend)s?\b",
    r"\b\d{1,2}(:\d{2})?\s?(am|pm)\b",
    r"\b\d{1,2}[:.]\d{2}\b",
    r"(€|£|\$)\s?\d",
    r"\b\d+\s?(euros?|pounds?|dollars?|kronor|sek|eur)\b",
    r"\b(free entry|free admission|no admission|admission is|entry is|costs?|priced?|ticket price)\b",
    r"\b(admission|entrance|entry|ticket)s?\b.{0,20}\b(fee|fees|price|prices|charged?|free)\b",
)
LEAST_CLAIM = 15


#: Letters that Unicode neither decomposes nor names after a plain letter, and what they are written with (fixed values).
SPELLED = {"ß": "ss", "ẞ": "ss", "þ": "th", "Þ": "th", "ð": "d", "Ð": "d", "ı": "i", "ĸ": "k", "ŋ": "n", "Ŋ": "n", "ſ": "s", "ŉ": "n"}
#: Code points that are looked through for letters: Latin-1 to Latin Extended-B, Latin Extended Additional, C and D, ligatures.
_LETTERS = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800), *range(0xFB00, 0xFB07)]
_MARKS = "".join(chr(c) for r in (range(0x300, 0x370), range(0x1AB0, 0x1B00), range(0x1DC0, 0x1E00), range(0x20D0, 0x2100)) for c in r if unicodedata.combining(chr(c)))
_NAMED = re.compile(r"LATIN (?:CAPITAL|SMALL) (?:LETTER|LIGATURE) ([A-Z]{1,2})(?: WITH .*)?$")


@lru_cache(maxsize=1)
def letters() -> dict[str, str]:
    """Each letter beyond ASCII and the plain lower-case letters that stand for it: by SPELLED, else by its decomposition,
    else by its Unicode name (O WITH STROKE is an o, AE is ae)."""
    out = {}
    for c in map(chr, _LETTERS):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        named = _NAMED.match(unicodedata.name(c, ""))
        if c in SPELLED:
            out[c] = SPELLED[c]
        elif plain.isascii() and plain.isalpha():
            out[c] = plain.lower()
        elif named:
            out[c] = named[1].lower()
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Letters of one plain letter, those letters, and the letters of several."""
    one = {k: v for k, v in letters().items() if len(v) == 1}
    return "".join(one), "".join(one.values()), tuple((k, v) for k, v in letters().items() if len(v) > 1)


def fold(x: Column) -> Column:
    """Lower case in plain letters: accents and combining marks go, ligatures and special letters are spelled out.

    One pass of translate does all but the letters that become several, which few strings have and only these are searched for.
    """
    marked, plain, several = _tables()
    once = F.lower(F.translate(x, marked + _MARKS, plain))
    spelled = once
    for letter, by in several:
        spelled = F.replace(spelled, F.lit(letter), F.lit(by))
    return F.when(once.rlike("[" + "".join(k for k, _ in several) + "]"), spelled).otherwise(once)


@lru_cache(maxsize=1)
def _fold_map() -> dict[int, str]:
    return str.maketrans(letters() | {m: "" for m in _MARKS})


def fold_of(x: str) -> str:
    """fold of a plain string, for folds."""
    return x.translate(_fold_map()).lower()


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def _grams(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substr(x, i, F.lit(3)))


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def gram_set(x: Column) -> Column:
    """Distinct trigrams of a folded string, padded as a whole by two blanks and one."""
    return F.array_distinct(_grams(F.concat(F.lit("  "), fold(x), F.lit(" "))))


def trigram(a: Column, b: Column) -> Column:
    """Jaccard similarity of the trigrams of two folded strings."""
    return _jaccard(gram_set(a), gram_set(b))


def trigram_of(a: str, b: str) -> float:
    """trigram of plain strings, for folds."""
    x, y = ({p[i : i + 3] for i in range(len(p) - 2)} for p in (f"  {fold_of(a)} ", f"  {fold_of(b)} "))
    return len(x & y) / len(x | y)


def word_trigrams(x: Column) -> Column:
    """Distinct trigrams of the words of a lower-cased string, each word padded by two blanks and one."""
    words = F.filter(F.split(F.lower(x), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: _grams(F.concat(F.lit("  "), w, F.lit(" "))))))


def word_similarity(a: Column, b: Column) -> Column:
    """The search similarity: Jaccard over word-wise trigrams."""
    return _jaccard(word_trigrams(a), word_trigrams(b))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str, scale: float = 0.1) -> float:
    """The prefix of up to four code points always raises the score, however low it is."""
    j, k = jaro(a, b), 0
    while k < min(4, len(a), len(b)) and a[k] == b[k]:
        k += 1
    return j + k * scale * (1 - j)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def plain_text(x: Column) -> Column:
    """Text without wiki links (their label stays), templates, quotes of markup, tags, the common entities and citations; null if empty."""
    steps = (
        (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"\{\{[^}]*\}\}", ""), (r"'{2,}", ""), (r"<[^>]*>", " "), (r"&nbsp;", " "), (r"&quot;", "\""), (r"&#39;|&apos;", "'"),
        (r"&lt;", "<"), (r"&gt;", ">"), (r"&amp;", "&"), (r"\[\d+\]", ""), (r"\s+", " "), (r" ([.,;:!?])", "$1"),
    )
    for pattern, by in steps:
        x = F.regexp_replace(x, pattern, by)
    x = F.trim(x)
    return F.when(x != "", x)


def has_markup(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\[\[|\{\{|'{2,}|<[a-zA-Z/]|&[a-z]+;"), F.lit(False))


def is_perishable(x: Column) -> Column:
    return F.coalesce(x.rlike("(?i)" + "|".join(f"(?:{p})" for p in PERISHABLE)), F.lit(False))


def sentences(x: Column) -> Column:
    return F.filter(F.split(x, "(?<=[.!?])\\s+"), lambda s: s != "")


def trim_perishable(x: Column) -> Column:
    """The claim without its perishable sentences, or empty if what the cut leaves is shorter than LEAST_CLAIM characters.

    A claim without any is not cut, and so however short it is it stays.
    """
    claim = F.trim(x)
    kept = F.trim(F.array_join(F.filter(sentences(claim), lambda s: ~is_perishable(s)), " "))
    return F.when(~is_perishable(claim), claim).when(F.length(kept) >= LEAST_CLAIM, kept).otherwise(F.lit(""))


def first_kind(x: Column, lexicon: dict[str, list[str]]) -> Column:
    """The first kind, in their order, one of whose words the lower-cased text contains."""
    cases = [F.when(_any(F.lower(x), words), F.lit(kind)) for kind, words in lexicon.items()]
    return F.coalesce(*cases, F.lit(None).cast("string"))


def _any(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def content_id(*parts: Column) -> Column:
    """32 hex digits of the SHA-256 of the parts as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32)


#: How an encyclopedia article is named, by its address or by a tag (fixed values).
ARTICLE_URL, ARTICLE_TAG = r"(?i)^https?://([a-z\-]+)\.(?:m\.)?wikipedia\.org/wiki/([^?#]+)", r"(?i)^(?!https?:)([a-z\-]+):(.+)$"


def sitelink(x: Column) -> Column:
    """lang:Title_With_Underscores of an encyclopedia URL or of a lang:Title tag; null for any other text."""

    def key(pattern: str, title: Column) -> Column:
        return F.concat(F.lower(F.regexp_extract(x, pattern, 1)), F.lit(":"), F.replace(F.trim(title), F.lit(" "), F.lit("_")))

    address = F.regexp_extract(x, ARTICLE_URL, 2)
    title = F.coalesce(F.try_url_decode(F.replace(address, F.lit("+"), F.lit("%2B"))), address)  # a plus sign is no blank here
    return F.when(x.rlike(ARTICLE_URL), key(ARTICLE_URL, title)).when(x.rlike(ARTICLE_TAG), key(ARTICLE_TAG, F.regexp_extract(x, ARTICLE_TAG, 2)))


def sitelink_of(x: str | None) -> str | None:
    """sitelink of a plain string, for folds."""
    url, tag = re.match(ARTICLE_URL, x or ""), re.match(ARTICLE_TAG, x or "")
    if url:
        return f"{url[1].lower()}:{unquote(url[2]).strip().replace(' ', '_')}"
    return f"{tag[1].lower()}:{tag[2].strip().replace(' ', '_')}" if tag else None


def settlement(x: Column) -> Column:
    """A place name without what an administration puts before or after it."""
    x = F.regexp_replace(x, r"(?i)^(?:city of|municipality of|commune de|ville de|gemeinde|stadt)\s+", "")
    x = F.regexp_replace(x, r"(?i)\s+(?:kommun|municipality|kommune|district|county|city)$", "")
    return F.when(F.trim(x) != "", F.trim(x))
