"""Personal data by anchor expansion (operator 2).

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, scheme separators and identifier cues.  From each anchor a small
deterministic parser expands to the left or right, decides the boundaries
and validates the value.

Base kinds (always found, whatever the cues say), leftmost and without
overlap inside a kind, a match that fails its check is consumed and dropped:
``email``, ``ip`` (four parts, each at most 255), ``card`` (13 to 19 digits,
Luhn), ``phone`` (9 to 15 digits after a plus sign).

Kinds that the cues add: ``uri`` (scheme with user information before the
host), ``iban`` (cue, then a value whose check digits hold), ``account``
(account cue, then 6 to 17 digits), ``secret`` (token, key or password cue,
an equals sign or colon, then a value of 8 characters or more that holds a
digit).

Defined results: a null or empty text has no span; offsets are code points,
end exclusive; repeated rows are scanned alike; other columns of the input,
whatever their names, are not read.  Rows are independent, so no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, single_user_column, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
CUE_KINDS = ("uri", "iban", "account", "secret")
KINDS = BASE_KINDS + CUE_KINDS
CHUNK_BYTES = 8 << 20

# Cue words; each is searched in lower, upper and title case.
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account no", "account number", "account #", "acct", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "api_key", "api key", "apikey", "secret", "password", "passwd", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"://[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_IBAN = re.compile(r"[\s:#]{0,4}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:[\s.:#]|number|no|num){0,6}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_SECRET = re.compile(r"[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9_+/=.-]{8,})")


def _cases(words: Iterable[str]) -> set[str]:
    return {v for w in words for v in (w, w.upper(), w.title(), w.capitalize())}


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for d in "0123456789":
        auto.add_word(d, (0, 1))
    auto.add_word("@", (1, 1))
    auto.add_word("+", (2, 1))
    auto.add_word("://", (3, 3))
    for code, cues in ((4, IBAN_CUES), (5, ACCOUNT_CUES), (6, SECRET_CUES)):
        for cue in _cases(cues):
            auto.add_word(cue, (code, len(cue)))
    auto.make_automaton()
    return auto


_AUTO: ahocorasick.Automaton | None = None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    moved = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of one text, by kind in the order of ``KINDS``, then by start."""
    global _AUTO
    if not text:
        return []
    if _AUTO is None:
        _AUTO = _automaton()
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    for last, (code, width) in _AUTO.iter(text):
        at = last - width + 1
        if code == 0:
            if at >= after["ip"]:
                _dotted(text, at, found["ip"], after)
            if at >= after["card"]:
                m = _GROUPED.match(text, at)
                after["card"] = m.end()
                if m.end() - at >= 13:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, m.end()))
        elif code == 1:
            if at < after["email"]:
                continue
            start = at
            while start > after["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                after["email"] = m.end()
        elif code == 2:
            if at >= after["phone"] and (m := _DIAL.match(text, at)):
                after["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found["phone"].append((at, m.end()))
        elif code == 3:
            if at >= after["uri"] and (m := _USERINFO.match(text, at)):
                start = at
                while start > after["uri"] and text[start - 1] in _SCHEME:
                    start -= 1
                if start < at:
                    found["uri"].append((start, m.end()))
                    after["uri"] = m.end()
        else:
            kind, rule = (("iban", _IBAN), ("account", _ACCOUNT), ("secret", _SECRET))[code - 4]
            if at < after[kind] or (at and text[at - 1].isalnum()):
                continue
            m = rule.match(text, last + 1)
            if not m:
                continue
            start, end = m.span(1)
            if kind == "iban":
                end = _iban_end(text, start, end)
                if end < 0:
                    continue
            elif kind == "secret" and not any(c.isdigit() for c in m.group(1)):
                continue
            found[kind].append((start, end))
            after[kind] = end
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def _dotted(text: str, at: int, out: list[tuple[int, int]], after: dict[str, int]) -> None:
    """Groups of four numbers joined by dots; a rest of fewer is no match."""
    m = _DOTTED.match(text, at)
    after["ip"] = m.end()
    if m.end() - at < 7:
        return
    parts, start = m.group().split("."), at
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        end = start + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            out.append((start, end))
        start = end + 1


def _iban_end(text: str, start: int, end: int) -> int:
    """Longest end at which the check digits hold, or -1."""
    for stop in range(end, start + 14, -1):
        if text[stop - 1] != " " and iban_valid(text[start:stop]):
            return stop
    return -1


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span (overlapping ones joined) replaced by its kind."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"<{k.upper()}>"]
        at = e
    return "".join(out) + text[at:]


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, the base counts and digest, all spans."""
    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK_BYTES):
                counts, digests, joined = {k: [] for k in BASE_KINDS}, [], []
                for text in texts_of(batch.column("text")):
                    spans = find_spans(text)
                    base = [s for s in spans if s[0] in BASE_KINDS]
                    for k in BASE_KINDS:
                        counts[k].append(sum(s[0] == k for s in base))
                    digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                    joined.append(spans_text(spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS),
                     pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                    ["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return pairs.mapInArrow(run, f"id {kind}, {counts}, base_sha256 string, spans string") \
        .withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The input with every span of ``text_col`` replaced by ``<KIND>``; null stays null.

    ``size_col`` (if given) becomes the new number of code points.
    """
    def run(column):
        import pandas as pd

        return pd.Series([None if t is None else redact_text(t, find_spans(t)) for t in column], dtype="object")

    new = single_user_column(docs, "redacted")
    udf = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)
    redacted = docs.withColumn(new, udf(docs[text_col]))
    out = {text_col: F.col(new)} | ({size_col: F.length(new).cast(docs.schema[size_col].dataType)} if size_col else {})
    return redacted.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns))
