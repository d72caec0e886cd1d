"""Personal data in texts (operator 4).

Regular expressions propose spans; validators confirm them (octets of an address, Luhn for cards, mod 97 for
account numbers, digit counts for telephone numbers, the address parser for version 6, entropy for keys and tokens);
words near a span adjust its score. Spans of the four base kinds that pass their validator always stay, whatever their
score; the further kinds, which look more like other numbers, stay from THRESHOLD on, and only where no base span is.

Each text is scanned whole; base spans are kept sorted, so further spans find those near them by bisection. Offsets are code points, ends exclusive. Defined results:
null and empty texts have no spans; repeated rows repeat their results; other columns are ignored by find() and
kept by redact().
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _texts
from .common import map_arrow, text_input

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card", "local_phone", "social_security", "ip6", "secret")
THRESHOLD = 0.5
#: Code points before and after a span in which context words count.
NEAR_BEFORE, NEAR_AFTER = 60, 30
#: Score of a confirmed span before its context is seen; a context word adds BONUS, a denying one takes MALUS.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "short_card": 0.3, "local_phone": 0.3, "social_security": 0.3, "ip6": 0.3, "secret": 0.3}
BONUS, MALUS = 0.3, 0.3
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "mastercard", "payment"),
    "short_card": ("card", "credit", "amex", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "social_security": ("ssn", "social", "security"),
    "ip6": ("ip", "ipv", "address", "host", "server"),
    "secret": ("token", "secret", "key", "apikey", "api-key", "password", "passwd", "bearer", "authorization"),
}
DENIED = ("version", "order", "invoice", "isbn", "serial", "example")

_local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_digit = re.compile("[0-9]").search
#: A match can't begin inside a run of digits, so starts there are skipped: linear time on long runs.
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])").finditer
_local_phone = re.compile(r"(?<![+0-9.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])").finditer
_social = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])").finditer
_ip6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])").finditer
#: Keys that tell what they are, and any long mixture of letters and digits, which needs entropy and context.
_known_secret = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+)(?![A-Za-z0-9_])").finditer
_long_token = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}").finditer
TOKEN_BITS = 2.8
_letter = re.compile("[A-Za-z]").search
_word = re.compile(r"[a-z]+(?:-[a-z]+)?").findall
_doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Luhn's check over decimal digits."""
    values = [ord(c) - 48 for c in digits]
    return (sum(values[-1::-2]) + sum(_doubled[v] for v in values[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 mod 97-10 over an account number, its first four characters moved to the end."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def bits(token: str) -> float:
    """Shannon entropy of the token's characters, in bits a character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _address6(text: str) -> bool:
    """A full address of version 6, or a shortened one with two groups at least."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(map(bool, text.split(":"))) >= 2


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.label, found from the at signs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, before context is weighed."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not _digit(text):
        return
    if "." in text:
        for m in _ip(text):
            if all(map(_octet, m[0].split("."))):
                yield "ip", *m.span()
    for m in _card(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
            elif 13 <= len(digits) <= 15 and luhn(digits):
                yield "short_card", *m.span()
    if "+" in text:
        for m in _phone(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", *m.span()
    for m in _iban(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", *m.span()
    for m in _local_phone(text):
        yield "local_phone", *m.span()
    if "-" in text:
        for m in _social(text):
            yield "social_security", *m.span()
    if ":" in text:
        for m in _ip6(text):
            if _address6(m[0]):
                yield "ip6", *m.span()
    for m in _known_secret(text):
        yield "secret", *m.span()
    for m in _long_token(text):
        if _digit(m[0]) and _letter(m[0]) and bits(m[0]) >= TOKEN_BITS:
            yield "secret", *m.span()


class _Taken:
    """Sorted spans without overlaps, for the question whether any of them meets another."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a


def scored(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans that stay, by kind as in KINDS, then by start."""
    if not text:
        return []
    found = list(dict.fromkeys(proposals(text)))
    if not found:
        return []
    taken = _Taken([(a, b) for kind, a, b in found if kind in BASE_KINDS])
    out = []
    for kind, a, b in found:
        if kind not in BASE_KINDS and taken.meets(a, b):
            continue  # a base span holds it already
        near = set(_word(text[max(0, a - NEAR_BEFORE) : a].lower())) | set(_word(text[b : b + NEAR_AFTER].lower()))
        score = SCORES[kind] + BONUS * (not near.isdisjoint(CONTEXT[kind])) - MALUS * (not near.isdisjoint(DENIED))
        if kind == "secret" and next(_known_secret(text[a:b]), None):
            score += BONUS
        if kind == "ip6" and text.count(":", a, b) == 7:
            score += BONUS
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((kind, a, b, round(min(1.0, max(0.0, score)), 3)))
    out.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return out


def listed(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find(documents: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, score) of every whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": x, "end": y, "score": s} for k, x, y, s in scored(t)] for t in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(spans, _ARROW_SPANS)], ["doc_id", "spans"])

    return map_arrow(text_input(documents), run, SPANS)


def digests(found: DataFrame) -> DataFrame:
    """The counts, hash and list of spans that find() returned, and their scores, in built-in functions."""
    s = F.col("spans")
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: lambda x: x["kind"] == kind
    base = F.filter(s, lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(F.filter(s, of(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(s, text), ",").alias("spans"),
        F.size(s).cast("long").alias("n_spans"),
        F.size(F.filter(s, of("secret"))).cast("long").alias("n_secret"),
        F.array_join(F.transform(s, lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def redacted(text: str | None) -> str | None:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b, _ in sorted(scored(text), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, column: str = "text") -> DataFrame:
    """documents with the spans in the text column replaced; all columns stay, in order. No shuffle."""
    names = documents.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([redacted(t) for t in _texts(b.column(at))], b.schema.field(at).type))

    return map_arrow(documents, run, documents.schema)
