"""Text expressions: validation, preview, normalisation and word tokens.

Tokens follow the vectoriser configuration of the text model: lower-case,
accents stripped, runs of >= 2 letters/digits/underscore, 1- and 2-grams.
Spark has no Unicode decomposition function; accent stripping translates every
character of the basic plane whose decomposition leaves one letter and drops
combining marks.  Ligatures and syllables that decompose into several letters
are kept as they are.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _accents() -> tuple[str, str]:
    """Characters and what stripping accents leaves of them, by rule: the
    compatibility decomposition without combining marks, where that is one
    character; then the combining marks themselves, which leave nothing
    (``translate`` deletes what has no counterpart)."""
    one, marks = {}, []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
        elif not 0xD800 <= code < 0xE000:
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c:
                one[c] = base
    return "".join(one) + "".join(marks), "".join(one.values())


ACCENTED, UNACCENTED = _accents()

# Word-token pattern (>= 2 characters of letters, digits, underscore).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Any-length word pattern used by the lexicon scorer.
WORD_PATTERN = r"[\p{L}\p{N}_]+"


# All Unicode white space: trimmed from both ends in O(edges).
WHITESPACE = " \t\n\r\f\u000b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def is_blank(text: Column) -> Column:
    """NULL, empty or whitespace-only text (the scorer refuses these)."""
    return text.isNull() | (F.length(F.trim(text, F.lit(WHITESPACE))) == 0)


def preview(text: Column, n: int = 100) -> Column:
    """First ``n`` characters; NULL or empty text gives NULL."""
    return F.when(text.isNotNull() & (text != F.lit("")), F.substring(text, 1, n))


def normalise(text: Column) -> Column:
    """Lower-case and strip accents (text of one byte a character has none)."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(low, ACCENTED, UNACCENTED))


def word_tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """``array<string>`` of word tokens of the normalised text, in order."""
    return F.regexp_extract_all(normalise(text), F.lit(pattern), 0)


def word_bigrams_joined(tokens: Column) -> Column:
    """Adjacent token pairs, from the tokens joined by single spaces (tokens
    hold no whitespace): one linear regex pass instead of a lambda per pair."""
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(r"(?:^| )(?=(\S+ \S+))"), 1)
