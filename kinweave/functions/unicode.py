"""Unicode normal forms and romanisation: what the JVM functions can't express, over Arrow batches."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinweave.functions import text

_GAP = regex.compile(r"[^\p{L}\p{N}_ऀ-෿‌‍]+")
INDIC = range(0x0900, 0x0E00)
# What the name of an Indic character says of its kind and sound, the first that fits; \1 is lower-cased.
_NAMES = (
    (r"SIGN VOCALIC|VOCALIC .*SIGN", "sign", "r"), (r"VOCALIC", "sound", "r"), (r"LETTER.* (?=(?:AA?|II?|UU?|EE?|OO?|AI|AU)$)(\w)", "sound", r"\1"), (r"LETTER.* (\S+)$", "consonant", r"\1"),
    (r"VOWEL.*SIGN.* (\S+)$", "sign", r"\1"), (r"VIRAMA", "sign", ""), (r"SIGN (?:ANUSVARA|CANDRABINDU)$", "sound", "n"), (r"SIGN VISARGA$", "sound", "h"),
)
#: Signs of the private area, between the steps of a romanisation: an inherent vowel may follow, it doesn't, a silent sign.
_OPEN, _SHUT, _JOINT = "\ue000", "\ue001", "\ue002"


@functools.cache
def _marks() -> regex.Pattern:
    """Combining marks behind an ASCII letter."""
    marks = "".join(chr(c) for c in range(0x300, 0x110000) if unicodedata.combining(chr(c)))
    return regex.compile(f"(?<=[A-Za-z])[{marks}]+")


def strip_accents(s: str) -> str:
    """Compatibility decomposition without the marks that follow an ASCII letter; those of other scripts stay."""
    return _marks().sub("", unicodedata.normalize("NFKD", s))


def normalize_text(s: str | None) -> str:
    if not s:
        return ""
    if not s.isascii():
        s = strip_accents(unicodedata.normalize("NFKC", s))
    return _GAP.sub(" ", s.lower()).strip(" ")


@functools.cache
def _sounds() -> dict[int, str]:
    """The letters of each Indic character, with the signs above."""
    table = {0x200C: _JOINT, 0x200D: _JOINT}
    for c in INDIC:
        name, out = unicodedata.name(chr(c), ""), ""
        if (digit := unicodedata.digit(chr(c), None)) is not None:
            out = str(digit)
        else:
            for pattern, kind, letters in _NAMES:
                if m := regex.search(pattern, name):
                    out = m.expand(letters).lower()
                    out = _SHUT + out if kind == "sign" else (out.rstrip("a") or out) + _OPEN if kind == "consonant" else out
                    break
        table[c] = out or _JOINT
    return table


def romanize(token: str) -> str:
    """Rough Latin letters of an Indic token: a consonant sounds with `a` unless a vowel sign or the virama follows."""
    out = token.translate(_sounds()).replace(_OPEN + _SHUT, "").replace(_OPEN, "a")
    return out.replace(_SHUT, "").replace(_JOINT, "")


@F.pandas_udf(StringType())
def normalize_any(s: pd.Series) -> pd.Series:
    return s.map(normalize_text)


@F.pandas_udf(StringType())
def romanize_any(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t if t.isascii() else romanize(t))


def with_normalized(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the normalised column: Latin rows in the JVM, only the rest through Python.

    Two branches and a union, as Spark would call a UDF inside `when` for every row.
    """
    latin = text.is_latin_text(F.col(column))
    return df.where(latin).withColumn(out, text.normalize(F.col(column))).unionByName(df.where(~latin).withColumn(out, normalize_any(F.col(column))))


def romanized_tokens(tokens: DataFrame, column: str = "token") -> DataFrame:
    """token and roman for the distinct tokens of a table; Python sees each non-ASCII token once."""
    own = tokens.select(F.col(column).alias("token")).distinct()
    ascii_ = F.col("token").rlike(r"^[\x00-\x7F]*$")
    return own.where(ascii_).withColumn("roman", F.col("token")).unionByName(own.where(~ascii_).withColumn("roman", romanize_any("token")))
