"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are taken left to right without overlap per kind; a proposal that
fails its check is dropped and not tried again from a later place. They score 1 and always stay. The further kinds
start from a prior, gain when their checksum holds or a telling word stands within ``CONTEXT`` characters, and stay from
``threshold`` on:

* ``iban``: letters and digits in the usual grouping; needs mod-97;
* ``phone_local``: 7 to 15 digits with separators and no plus; needs a word such as "phone";
* ``ssn``: three, two and four digits; needs valid parts and a telling word;
* ``secret``: access keys and long hexadecimal values; needs its fixed prefix or a word such as "token".

A further span that overlaps a base span is dropped. Patterns start at the edge of a run of their characters, so the
time is linear in the length of a text, also in one long run of digits or letters. Offsets are code points, the end
exclusive. Null and empty texts have no spans. Rows are independent: repeated rows, ties, empty tables and extra columns
make no difference.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import unused

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "phone_local", "ssn", "secret")
KINDS = BASE + MORE

#: Characters before and after a span in which words count.
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![A-Za-z0-9+.-])(?:\([0-9]{2,5}\)\x20?|[0-9])(?:[\x20./-]?[0-9]){6,14}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{32,128})(?![A-Za-z0-9])")

_WORDS = {
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    "phone_local": re.compile(r"(?i)\b(?:phone|tel|telephone|telefon|téléphone|teléfono|mobile|fax|call)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security)\b"),
    "secret": re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_ -]?key|key)\b"),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at sign with its local part to the left, not reaching into the address before, and a domain to the right."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out = [Span("email", a, b, 1.0) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(Span("ip", *m.span(), 1.0))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 14:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", *m.span(), 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdecimal, m[0])) <= 15:
                out.append(Span("phone", *m.span(), 1.0))
    return out


def _told(kind: str, text: str, start: int, end: int) -> bool:
    word = _WORDS[kind]
    return bool(word.search(text, max(0, start - CONTEXT), start) or word.search(text, end, end + CONTEXT))


def more_spans(text: str, threshold: float = 0.6) -> Iterator[Span]:
    """The further kinds, scored."""
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield Span("iban", *m.span(), 0.9 + 0.1 * _told("iban", text, *m.span()))
    for m in _LOCAL_PHONE.finditer(text):
        score = 0.2 + 0.5 * _told("phone_local", text, *m.span())
        if score >= threshold:
            yield Span("phone_local", *m.span(), score)
    for m in _SSN.finditer(text):
        valid = m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
        score = 0.3 * valid + 0.5 * _told("ssn", text, *m.span())
        if score >= threshold:
            yield Span("ssn", *m.span(), score)
    for m in _KEY.finditer(text):
        fixed = m[0][:4] in ("AKIA", "ASIA") or m[0].startswith("gh")
        score = (0.7 if fixed else 0.3) + 0.3 * _told("secret", text, *m.span())
        if score >= threshold:
            yield Span("secret", *m.span(), score)


def find_spans(text: str, threshold: float = 0.6) -> list[Span]:
    """All spans by start, then by the order of kinds."""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS)}
    if more := list(more_spans(text, threshold)):
        ends = sorted((s.start, s.end) for s in base)
        starts = [a for a, _ in ends]
        reach, most = [], 0
        for _, b in ends:
            most = max(most, b)
            reach.append(most)
        for s in more:
            before = bisect_right(starts, s.end - 1)
            if not before or reach[before - 1] <= s.start:
                base.append(s)
    return sorted(base, key=lambda s: (s.start, order[s.kind], s.end))


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, done = [], 0
    for i, s in enumerate(spans):
        if s.start >= done or not i:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def spans_column(text: Column, threshold: float = 0.6) -> Column:
    """The spans of each text, as an array of structs."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[s._asdict() for s in find_spans(t.as_py(), threshold)] if t.is_valid else [] for t in batch], kind)

    return spans(text)


def masked_column(text: Column, threshold: float = 0.6) -> Column:
    """Each text with its spans masked; null stays null."""

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array([t if t is None else mask(t, find_spans(t, threshold)) for t in texts], pa.string())

    return masked(text)


def find_pii(docs: DataFrame, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and its spans."""
    return docs.select(F.col(id_col), spans_column(F.col(text_col), threshold).alias("spans"))


def mask_pii(docs: DataFrame, threshold: float = 0.6, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with masked texts; a text without personal data stays as it is. The length column follows, if there."""
    name = unused(docs, "masked")
    out = docs.withColumn(name, masked_column(F.col(text_col), threshold))
    changed = ~F.col(text_col).eqNullSafe(F.col(name))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(changed, F.length(name).cast(kind)).otherwise(F.col(chars_col)))
    return out.withColumn(text_col, F.col(name)).drop(name)


def counts_and_hashes(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What :func:`find_pii` returns, as counts per base kind, a hash of the base spans and a string of all."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def shown(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(F.col(id_col), *map(count, BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
