"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, obfuscated at-signs, and the words that
announce an identifier or an address. From each anchor a deterministic parser expands to the left and right, validates what
it has, and gives a span. Numbers that need no announcement (IP addresses, payment cards, phone numbers) are
parsed at their digits. All offsets are code points, ends exclusive.

Base kinds, always kept: email, ip, card, phone. Added kinds, which never overlap each other (the earlier start wins, then the longer
span, then the order of KINDS) and never lie inside one base span; they may reach over the ends of base spans, and `redact` covers the union:
  email_text  name [at] host [dot] tld, with brackets or parentheses
  login       the user:password part of an URL, up to the last at-sign before a slash, question mark, number sign or white space
  account     IBANs that pass mod 97, and identifiers after a cue such as `account no.` or `passport`; 5 letters
              and digits or more, with 4 digits or more
  secret      quoted or assigned values after token, secret, password, api_key; 8 characters or more of any kind, up to white space,
              or, where a quotation mark opens the value, up to its closing mark in the line
  address     a house number with a street name of one to three capitalised words

Defined cases: null is an empty text; empty texts have no spans and the hash of the empty string; a null doc_id is carried; offsets
in repeated rows are each row's own; an empty table gives no rows; extra columns are ignored (or passed on by `redact`, which
leaves null texts null); a long text is gone over whole, in time that grows with its length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_text, id_and_text, longs, slices, small_batches, tidied

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_text", "login", "account", "secret", "address")
Span = tuple[str, int, int]

#: What announces each kind, sought in any case.
CUES = {
    "email": ("@",),
    "email_text": ("[at]", "(at)"),
    "login": ("://",),
    "account": ("iban", "account", "acct", "passport", "ssn", "social security", "tax id", "customer id", "konto", "cuenta", "compte"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey"),
    "address": ("street", "avenue", "road", "lane", "boulevard", "straße", "strasse", "platz", "rue", "calle", "avenida"),
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the same matches as without possessive groups and look-behind, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TEXT_RIGHT = re.compile(r"\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(](?i:dot)[\])]\x20?|\.)[A-Za-z0-9-]++)++")
# a login may be of any length: possessive groups read each character once
_LOGIN = re.compile(r"[^\s/@:?#]++:[^\s/?#]+(?=@)")
_IBAN = re.compile(r"\W{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?i:\x20?(?:number|num|no|nr|id)?\b\.?)[\x20\t]*[:#=]?[\x20\t\"']*([A-Z0-9](?:[-./]?[A-Z0-9]){4,})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']?[\x20\t]*[:=][\x20\t]*([\"']?)|[\x20\t]+([\"'])")
_VALUE = re.compile(r"\S{8,}")
_QUOTED = {mark: re.compile(rf"(?:[^{mark}\\\n]|\\.)*+(?={mark})") for mark in "\"'"}
_NUMBER_LEFT = re.compile(r"(?<!\w)[0-9]{1,5}[A-Za-z]?\x20(?:[A-ZÄÖÜÉ][\w'-]{1,30}\x20){1,3}$")
_NAME_RIGHT = re.compile(r"(?:\x20(?:de|la|le|du|des|del|los|las))*(?:\x20[A-ZÄÖÜÉÁÍÓÚÑ][\w'-]{1,30}){1,3},?\x20[0-9]{1,5}(?!\w)")
_STREET_NUMBER = re.compile(r"\x20[0-9]{1,4}[a-z]?(?!\w)")
_CAPITALISED_LEFT = re.compile(r"(?<!\w)[A-ZÄÖÜ]\w{1,30}$")


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """Lower case at the same offsets: U+0130 alone would become two characters."""
    return text.replace("\u0130", "i").lower()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str, signs: list[int]) -> Iterator[Span]:
    """Each at-sign expands to the left as far as local characters go and to the right over a dotted domain."""
    free = 0
    for at in signs:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield "email", start, free


def numbers(text: str) -> Iterator[Span]:
    if not _DIGITS.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield "phone", *m.span()


def _word(text: str, start: int, end: int) -> bool:
    return not (start and (text[start - 1].isalnum() or text[start - 1] == "_")) and not (end < len(text) and text[end].isalnum())


def _email_text(text: str, start: int, end: int) -> tuple[int, int] | None:
    local = begin = start - (start > 0 and text[start - 1] == " ")
    while begin and text[begin - 1] in _LOCAL:
        begin -= 1
    right = _TEXT_RIGHT.match(text, end)
    return (begin, right.end()) if begin < local and right else None


def _login(text: str, start: int, end: int) -> tuple[int, int] | None:
    m = _LOGIN.match(text, end)
    return m.span() if m else None


def _account(text: str, start: int, end: int) -> tuple[int, int] | None:
    if not _word(text, start, end):
        return None
    if (m := _IBAN.match(text, end)) and iban(m[1]):
        return m.span(1)
    if (m := _ACCOUNT.match(text, end)) and sum("0" <= c <= "9" for c in m[1]) >= 4:
        return m.span(1)
    return None


def _secret(text: str, end: int, known: int) -> tuple[int, int] | None:
    """known: where the last value ended; a cue inside that value says nothing new."""
    m = _SECRET.match(text, end)
    if not m or m.end() < known:
        return None
    mark = m[1] or m[2]
    if mark and (inside := _QUOTED[mark].match(text, m.end())):
        return inside.span() if inside.end() - inside.start() >= 8 else None
    value = _VALUE.match(text, m.end())
    return value.span() if value else None


def _address(text: str, start: int, end: int) -> tuple[int, int] | None:
    if left := _NUMBER_LEFT.search(text[max(0, start - 120) : start]):
        if _word(text, start, end):
            return start - len(left[0]), end
    if text[start:end].lower() in ("straße", "strasse", "platz"):
        left = _CAPITALISED_LEFT.search(text[max(0, start - 32) : start])
        right = _STREET_NUMBER.match(text, end)
        return (start - len(left[0]) if left else start, right.end()) if right and (left or _word(text, start, end)) else None
    if _word(text, start, end) and text[start:end].lower() in ("rue", "calle", "avenida") and (right := _NAME_RIGHT.match(text, end)):
        return start, right.end()
    return None


_PARSERS = {"email_text": _email_text, "login": _login, "account": _account, "address": _address}


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each by kind and start."""
    signs, anchors = [], []
    for last, (kind, size) in automaton().iter(lowered(text)):
        if kind == "email":
            signs.append(last)
        else:
            anchors.append((kind, last + 1 - size, last + 1))
    base = [*emails(text, signs), *numbers(text)]
    added, known = [], 0
    for kind, start, end in anchors:
        span = _secret(text, end, known) if kind == "secret" else _PARSERS[kind](text, start, end)
        if span:
            known = span[1] if kind == "secret" else known
            added.append((span[0], -span[1], KINDS.index(kind)))
    if added:
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        furthest = [0, *accumulate((b for _, b in taken), max)]  # the furthest end of the first spans
        kept, free = [], 0
        for start, minus_end, kind in sorted(set(added)):
            if start >= free and furthest[bisect_right(starts, start)] < -minus_end:
                kept.append((kind, start, -minus_end))
                free = -minus_end
        added = [(KINDS[k], a, b) for k, a, b in sorted(kept)]
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: base counts, the digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, digests, spans = [], [], []
            for text in column_text(batch):
                base, added = find(text)
                kinds = [k for k, _, _ in base]
                counts.append([kinds.count(k) for k in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([longs(batch), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return id_and_text(docs).mapInArrow(tidied(run), SCHEMA)


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    if not text:
        return text
    base, added = find(text)
    if not base and not added:
        return text
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in base + added):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with personal data replaced in `text`; `n_chars`, where there is one, follows the text."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    place = [f.name for f in schema].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([redact_text(t) for t in texts], c.type) if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(tidied(run), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
