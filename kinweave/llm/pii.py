"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, points between digits, neighbouring digits, schemes and identifier
cues in one pass over the text (with digits as one sign and letters in lower case); local parsers expand each anchor to
both sides and validate what they find. Four base kinds have fixed grammars, leftmost and without overlap within a kind:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)        parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                         14 to 19 digits that pass the Luhn test
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                    10 to 15 digits

Three more kinds come from cues: `secret` (a quoted or bare token of any length after a cue such as `token =` or `"token":`), `account` (an IBAN that
passes its check, or digits after a cue such as `account`) and `login` (user information in an address with a scheme).
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import id_text, map_arrow, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account", "login")

#: The cues of each kind, in lower case.
CUES = {
    "secret": ["token", "password", "passwd", "api_key", "apikey", "api-key", "secret"],
    "account": ["iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport"],
    "login": ["://"],
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A maximal run of digits can't match from within, so nothing is retried there; the language of each pattern is as above.
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"[\"']?[ \t]{0,4}[:=][ \t]{0,4}(?:\"([^\"\s]{8,}+)\"|'([^'\s]{8,}+)'|([A-Za-z0-9_\-./+]{16,}+))")
_ACCOUNT = re.compile(r"[\"']?[ \t:=#.]{1,8}[\"']?(?:(?:no|nr|number|num)\b[ \t:=#.]{0,8})?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])|[0-9](?:[ -]?[0-9]){5,33}(?![A-Za-z0-9]))", re.IGNORECASE)
_LOGIN = re.compile(r"([^\s/?#@:\"'<>]++:[^\s/?#@\"'<>]++)@[A-Za-z0-9-]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Keeps offsets, as each letter stays one code point.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
#: What every address and every card number has, with each digit as 0.
DIGIT_ANCHORS = {"ip": ["0.0"], "card": ["00", "0 0", "0-0"]}


def automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, with each digit as 0, for texts that are folded in the same way."""
    a = ahocorasick.Automaton()
    for word, kind in [("@", "email"), ("+", "phone"), *((w, k) for d in (DIGIT_ANCHORS, CUES) for k, words in d.items() for w in words)]:
        a.add_word(word, kind)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        x = 2 * int(d)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str, at_signs: list[int]) -> list[tuple[int, int]]:
    out, free = [], 0  # free: what no earlier match has taken
    for at in at_signs:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
    return out


def _phones(text: str, plus_signs: list[int]) -> list[tuple[int, int]]:
    out, free = [], 0
    for at in plus_signs:
        if at >= free and (m := _PHONE.match(text, at)):
            free = m.end()
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(m.span())
    return out


def _ips(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    """anchors: the digits behind a point with a digit before it."""
    out, free = [], 0
    for at in anchors:
        start = at - 1
        while start > free and text[start - 1] in _DIGITS:
            start -= 1
        if at - 2 >= free and (m := _IP.match(text, start)):
            free = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(m.span())
    return out


def _cards(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    """anchors: digits with a digit right before them or before one space or hyphen, the first of a number first."""
    out, free = [], 0
    for at in anchors:
        start = at - 1 if text[at - 1] in _DIGITS else at - 2
        if start >= free and (m := _CARD.match(text, start)):
            free = m.end()
            if m.end() - start >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(m.span())
    return out


def _account(text: str, at: int) -> tuple[int, int] | None:
    if (m := _ACCOUNT.match(text, at)) is None:
        return None
    if m[1][0].isdigit():
        return m.span(1)
    s, e = m.span(1)  # an IBAN may run on into the next words in capitals: its longest part that passes
    while e - s >= 15:
        if text[e - 1] != " " and iban(text[s:e]):
            return s, e
        e -= 1
    return None


def scan(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in a whole text, each kind in order."""
    if not text:
        return {k: [] for k in KINDS}
    at: dict[str, list[int]] = {k: [] for k in KINDS}
    for last, kind in anchors.iter(text.translate(_LOWER)):
        at[kind].append(last)
    found = {
        "email": _emails(text, at["email"]),
        "ip": _ips(text, at["ip"]),
        "card": _cards(text, at["card"]),
        "phone": _phones(text, at["phone"]),
    }
    for kind in ("secret", "account", "login"):
        spans, free = [], 0
        for last in at[kind]:
            if kind == "account":
                span = _account(text, last + 1)
            else:
                m = (_SECRET if kind == "secret" else _LOGIN).match(text, last + 1)
                span = m and m.span(m.lastindex)
            if span and span[0] >= free:
                spans.append(span)
                free = span[1]
        found[kind] = spans
    return found


def masked(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap the first stands for all."""
    spans = sorted((s, -e, KINDS.index(k)) for k, v in found.items() for s, e in v)
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, KINDS.index(k), e) for k in kinds for s, e in found[k]))


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_masked: bool = False) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_account, n_login and, if with_masked, the masked
    text of every whole text.

    Null and empty texts have no spans. One row in, one row out; no row depends on another.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def make():
        anchors = automaton()

        def step(batch):
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                found = [scan(t, anchors) for t in texts]
                cols = [part.column(0), *(pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE)]
                cols += [pa.array([hashlib.sha256(_joined(f, BASE).encode()).hexdigest() for f in found]), pa.array([_joined(f, KINDS) for f in found])]
                cols += [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS[len(BASE) :]]
                names = ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[len(BASE) :])]
                if with_masked:
                    cols, names = [*cols, pa.array([masked(t, f) for t, f in zip(texts, found, strict=True)])], [*names, "masked"]
                yield pa.RecordBatch.from_arrays(cols, names)

        return step

    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_account long, n_login long" + ", masked string" * with_masked
    return map_arrow(id_text(documents, id_col, text_col), make, schema).withColumnRenamed("id", id_col)


def mask(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with every span of their texts masked; all rows and columns stay, null texts too."""

    def make():
        anchors = automaton()

        def step(batch):
            i = batch.schema.names.index("t")
            for part in slices(batch, i):
                new = pa.array([None if t is None else masked(t, scan(t, anchors)) for t in part.column(i).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([new if j == i else c for j, c in enumerate(part.columns)], part.schema.names)

        return step

    # fixed names, as Arrow batches are read by position
    renamed = documents.select(*[F.col(f"`{c}`").alias("t" if c == text_col else f"c{i}") for i, c in enumerate(documents.columns)])
    return map_arrow(renamed, make, renamed.schema).toDF(*documents.columns)
