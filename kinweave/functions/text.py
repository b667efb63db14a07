"""Normalisation and tokens of record texts, as Column expressions that stay in the JVM.

Letters outside the Latin blocks need Unicode normal forms, which Spark's functions lack; `functions.unicode` has those.
"""

from __future__ import annotations

import unicodedata
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of a name that carry next to no identity.
LEGAL_SUFFIXES = (
    "inc", "incorporated", "llc", "l l c", "llp", "ltd", "limited", "limitee", "limitada", "private", "pvt", "pte", "corp", "corporation", "co",
    "company", "companies", "group", "holdings", "holding", "enterprises", "enterprise", "services", "service", "solutions", "society", "centre",
    "center", "trust", "associates", "assoc", "partners", "sarl", "sas", "sa", "eurl", "snc", "the", "and", "of", "for",
)
# Placeholders for a missing text.
NULL_TOKENS = ("null", "nan", "na", "none", "nil", "unknown", "n")
# What joins two names of one business, and what ends a web name.
ALIAS_MARKERS = ("dba", "d/b/a", "aka", "a/k/a", "formerly known as", "formerly", "now known as", "nee")
TLDS = ("com", "net", "org", "in", "co", "io", "fr")
# Digits that stand for letters; consonants that transliteration blurs (the last two go).
LEET = ("013458", "oleasb")
SKELETON = ("cqgjdbfvwzxyh", "kkkktppppss")

#: A token is a run of these: letters, numbers, the underscore, the Indic blocks with their vowel signs, both joiners.
TOKEN_CLASS = r"\p{L}\p{N}_ऀ-෿‌‍"
_WORD = r"[\p{L}\p{N}_]"


def _latin_folds() -> tuple[str, str]:
    """Accented letters of the Latin blocks and the ASCII letters that they decompose to."""
    pairs = [(chr(c), base) for c in range(0xC0, 0x250) if (base := unicodedata.normalize("NFKD", chr(c))[0]).isascii() and base.isalpha() and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", chr(c))[1:])]
    return "".join(a for a, _ in pairs), "".join(b.lower() for _, b in pairs)


_FOLD_FROM, _FOLD_TO = _latin_folds()


def is_latin_text(c: Column) -> Column:
    """Whether fold_latin() is all that normalisation needs."""
    return F.coalesce(c, F.lit("")).rlike("^[\\x00-\\u024F]*$")


def fold_latin(c: Column) -> Column:
    """Lower case without accents, for texts of the Latin blocks."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), _FOLD_FROM, _FOLD_TO)


def normalize(c: Column) -> Column:
    """Lower case, no accents, one space between tokens; null and empty give the empty text."""
    return F.trim(F.regexp_replace(fold_latin(c), f"[^{TOKEN_CLASS}]+", " "))


def split_tokens(normal: Column) -> Column:
    """Tokens of a normalised text without placeholders, in order, repeats kept."""
    return F.filter(F.split(normal, " "), lambda t: (t != "") & ~t.isin(*NULL_TOKENS))


def tokens(c: Column) -> Column:
    return split_tokens(normalize(c))


def unleet(token: Column) -> Column:
    """Digits as the letters that they stand for, in tokens that mix both."""
    return F.when(token.rlike(r"\p{L}") & token.rlike(r"\p{N}"), F.translate(token, *LEET)).otherwise(token)


def without_markers(c: Column) -> Column:
    """Alias markers, web endings and at-signs as spaces; the words on both sides stay."""
    marker = f"(?i)(?<!{_WORD})(?:{'|'.join(ALIAS_MARKERS)})(?!{_WORD})[:\\s]*"
    tld = f"(?i)\\.(?:{'|'.join(TLDS)})(?!{_WORD})"
    return F.translate(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), marker, " "), tld, " "), "@", " ")


def name_tokens(name: Column) -> Column:
    return F.transform(tokens(without_markers(name)), unleet)


def core_tokens(name_toks: Column) -> Column:
    """Tokens without legal suffixes, order and repeats kept."""
    return F.filter(name_toks, lambda t: ~t.isin(*LEGAL_SUFFIXES))


def _stripped(digits: Column) -> Column:
    s = F.ltrim(digits, F.lit("0"))
    return F.when(s == "", F.lit("0")).otherwise(s)


def tolerant(digits: Column) -> Column:
    """A number without leading zeros and, if it has over three digits, also without its first digit."""
    return F.array_distinct(F.when(F.length(digits) > 3, F.array(_stripped(digits), _stripped(F.substring(digits, 2, 1 << 20)))).otherwise(F.array(_stripped(digits))))


def numeric_tokens(toks: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.filter(toks, lambda t: t.rlike(r"^\p{N}+$")), tolerant)))


def script_of(c: Column) -> Column:
    """latin, indic or none, by which has more letters; latin wins a tie."""
    s = F.coalesce(c, F.lit(""))
    latin, indic = F.length(F.regexp_replace(s, "[^A-Za-z]", "")), F.length(F.regexp_replace(s, "[^\\u0900-\\u0DFF]", ""))
    return F.when((latin == 0) & (indic == 0), "none").when(latin >= indic, "latin").otherwise("indic")


def skeleton(token: Column) -> Column:
    """Consonant classes of a romanised token without vowels and without repeats."""
    return F.regexp_replace(F.regexp_replace(F.translate(token, *SKELETON), "[aeiou]+", ""), r"(.)\1+", "$1")


def skeletons(toks: Column) -> Column:
    """Distinct skeletons of two letters at least."""
    return F.array_distinct(F.filter(F.transform(toks, skeleton), lambda s: F.length(s) >= 2))


def canonical(toks: Column, aliases: Column | None = None) -> Column:
    """Each token's canonical form by a map column, in one pass; itself where the map has none."""
    return toks if aliases is None else F.transform(toks, lambda t: F.coalesce(F.try_element_at(aliases, t), t))


def name_keys(toks: Column) -> Column:
    """Keys of the name channel: tokens; '#' and runs or orders of tokens without spaces; '~' and skeletons."""
    n, first = F.size(toks), F.element_at(toks, 1)
    single = F.array_compact(F.array(F.concat(F.lit("#"), first), F.when(first.endswith("com") & (F.length(first) > 6), F.concat(F.lit("#"), F.regexp_replace(first, "com$", "")))))
    runs = F.transform(F.sequence(F.lit(2), F.least(n, F.lit(6))), lambda k: F.concat(F.lit("#"), F.array_join(F.slice(toks, 1, k), "")))
    core = core_tokens(toks)

    def orders(size: int) -> Column:
        return F.array(*[F.concat(F.lit("#"), *[F.element_at(core, i + 1) for i in p]) for p in permutations(range(size))])

    none = F.array().cast("array<string>")
    orders_ = F.when(F.size(core) == 2, orders(2)).when(F.size(core) == 3, orders(3)).otherwise(none)
    joined = F.when(n == 0, none).when(n == 1, single).otherwise(F.concat(runs, orders_))
    return F.array_distinct(F.concat(toks, joined, F.transform(skeletons(toks), lambda s: F.concat(F.lit("~"), s))))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams of the normalised text without spaces; a shorter text is its own, the empty one has none."""
    s = F.replace(normalize(c), F.lit(" "), F.lit(""))
    # n passes over pieces of n letters, one letter further each time: linear in the text
    passes = F.concat(*[F.regexp_extract_all(F.substring(s, i + 1, 1 << 30), F.lit(f".{{{n}}}"), F.lit(0)) for i in range(n)])
    return F.when(s == "", F.array().cast("array<string>")).when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(passes))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared elements as a share of the smaller set; both sets distinct."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def initials(core: Column) -> Column:
    """Sorted first letters of a set of tokens."""
    return F.array_join(F.array_sort(F.transform(core, lambda t: F.substring(t, 1, 1))), "")


def sorted_set(toks: Column, sep: str = " ") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(toks)), sep)


#: Ids are `S<source>-<number>`; the code is source * CODE + number, and back without loss.
CODE = 1_000_000_000


def encode_id(entity_id: Column) -> Column:
    return F.substring(entity_id, 2, 1).cast("long") * CODE + F.substring(entity_id, 4, 20).cast("long")


def decode_id(code: Column) -> Column:
    return F.concat(F.lit("S"), F.floor(code / CODE).cast("string"), F.lit("-"), (code % CODE).cast("string"))


def source_of(code: Column) -> Column:
    return F.floor(code / CODE).cast("int")


def pair_key(s1: Column, cand: Column) -> Column:
    """One number for a pair: the entity's number above, the candidate's code below."""
    return F.shiftleft(s1 % CODE, 32).bitwiseOR(cand)
