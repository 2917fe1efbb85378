"""Personal data, also in disguise: offset-preserving deobfuscation.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers
in the text as it is.  Then transducers rewrite the text: look-alike characters to
ASCII, spelled digits to digits, "at" and "dot" in their disguises to marks.  Each
rewritten character keeps the source characters it came from, so what the same
patterns find in the rewritten text maps back to spans of the source.  Spans that
only the rewriting shows are reported under kinds of their own.

What counts as a spoken address is fixed: a name of one to four parts, a host of two
to six labels, "at" and "dot" in the words and brackets listed below, any ending
after a spelled dot and one of `_TOP` after a real one.  Space may be of any length.
Every search takes time in proportion to the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shipping

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, *(f"hidden_{k}" for k in BASE_KINDS))

Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """From each ``@`` back over the local part and on over the domain: linear, where a search from every start isn't."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[Span]:
    def fits(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and int(part or 0) <= 255

    return [m.span() for m in _IP.finditer(text) if all(map(fits, m[0].split(".")))]


def passes_luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and passes_luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]


FINDERS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

#: Letters and marks that look like ASCII ones (fixed values), beside full-width,
#: mathematical and other compatibility forms, which Unicode itself decomposes.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "ε": "e",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "·": ".", "•": ".", "․": ".", "。": ".", "⋅": ".", "∙": ".",
}

#: Characters that aren't seen (fixed values).
_UNSEEN = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")

_FOREIGN = re.compile(r"[^\x00-\x7fÀ-ÿ]")

_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
#: Space inside a disguise may be of any length; runs are taken whole and never from their middle, which keeps every search linear.
_GAP, _MAYBE_GAP = r"[ \t]++", r"[ \t]*+"
_UNIT = rf"(?:(?<!\w)(?:{_WORD})(?!\w)|(?<![0-9])[0-9]++)"
_GLUE = rf"(?:[ \t]?[.,-]?[ \t]?|{_MAYBE_GAP}(?<!\w)(?:dot|point|punkt|punto|dash)(?!\w){_MAYBE_GAP})"
#: A row of digits, spelled or not.
_SPELLED = re.compile(rf"(?:(?:(?<!\w)plus{_GAP})|\+[ \t]?)?{_UNIT}(?:{_GLUE}{_UNIT})+", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?<!\w)(plus|dot|point|punkt|punto|dash|{_WORD})(?!\w)", re.IGNORECASE)
#: A spelled digit, or a spelled mark between digits.
_HAS_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)|(?<=[0-9]){_GAP}(?:dot|point|punkt|punto|dash){_GAP}(?=[0-9])", re.IGNORECASE)

_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_AT = r"(?:at|arroba|chez|ät|@)"
_DOT = r"(?:dot|punkt|punto|point|\.)"
#: "(at)" in any brackets, " @ " with space around; "(dot)" likewise.
_INSIDE, _BEFORE = r"\s*+", r"(?:(?<!\s)\s++)?+"
_BRACKETED_AT = re.compile(rf"{_BEFORE}{_OPEN}{_INSIDE}{_AT}{_INSIDE}{_CLOSE}{_INSIDE}", re.IGNORECASE)
_BRACKETED_DOT = re.compile(rf"{_BEFORE}{_OPEN}{_INSIDE}{_DOT}{_INSIDE}{_CLOSE}{_INSIDE}", re.IGNORECASE)
_MARKED = re.compile(rf"{_OPEN}{_INSIDE}(?:{_AT}|{_DOT}){_INSIDE}{_CLOSE}|[\s_-](?:dot|punkt|punto|point)[\s_-]|\sat\s|\s@|@\s|arroba|_at_|-at-", re.IGNORECASE)
_NAME = r"[A-Za-z0-9][A-Za-z0-9._%+-]*"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_WORD_DOT = rf"(?:{_GAP}(?:dot|punkt|punto|point){_GAP}|\.)"
_TOP = r"(?:com|org|net|edu|gov|info|biz|io|co|dev|app|eu|de|fr|es|uk|us|ca|ch|at|it|nl|mx|ar|br|ru|jp|cn|in|au|invalid|test|example)"
#: Any ending after a spelled dot; but "at this point we" is prose, so "point" after a bare "at" asks for a common one.
_ENDING = rf"(?:{_WORD_DOT}{_TOP}|(?(bare){_GAP}(?:dot|punkt|punto){_GAP}|{_GAP}(?:dot|punkt|punto|point){_GAP})[A-Za-z]{{2,}})"
#: Before "dot" and no common ending these name a dot, not a host: "pointed at the dot on the map" (fixed values).
_NO_HOST = frozenset("a an any each every her his its my no one our some that the their this your".split())
#: "name at host dot pl", with "dot" spelled or a common ending after a real dot.
_SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])({_NAME}(?:{_GAP}(?:dot|punkt|punto|point){_GAP}{_NAME}){{0,3}})(?:{_GAP}(?:(?P<bare>at)|arroba){_GAP}|{_MAYBE_GAP}@{_MAYBE_GAP}|_at_|-at-)"
    rf"(?P<host>{_LABEL}(?:{_WORD_DOT}{_LABEL}){{0,4}}{_ENDING})(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
_SPOKEN_PART = re.compile(rf"(?<![ \t]){_GAP}(dot|punkt|punto|point|at|arroba){_GAP}|(?:(?<![ \t]){_GAP})?+(@){_MAYBE_GAP}|(_at_|-at-)", re.IGNORECASE)


@lru_cache(maxsize=4096)
def look_alike(c: str) -> str:
    """What a character looks like in ASCII; itself if it doesn't."""
    if c in _UNSEEN:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    digit = unicodedata.digit(c, None)
    if digit is not None and unicodedata.category(c) == "Nd":
        return str(digit)
    if unicodedata.category(c) == "Zs":
        return " "
    form = unicodedata.normalize("NFKC", c)
    return form if form.isascii() else c


class Rewritten:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | range = range(len(text))
        self.ends: list[int] | range = range(1, len(text) + 1)

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put new characters for stretches, in order and apart; each new character stands for its whole stretch."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new and b > a:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]


def deobfuscate(text: str) -> Rewritten | None:
    """The text rewritten by the transducers, or None if none of them has anything to do."""
    out = Rewritten(text)
    if _FOREIGN.search(text):
        out.replace([(m.start(), m.end(), new) for m in _FOREIGN.finditer(text) if (new := look_alike(m[0])) != m[0]])
    if _MARKED.search(out.text):
        for pattern, mark in ((_BRACKETED_AT, "@"), (_BRACKETED_DOT, ".")):
            out.replace([(m.start(), m.end(), mark) for m in pattern.finditer(out.text)])
        edits = []
        for m in _SPOKEN.finditer(out.text):
            spoken = "".join(x[0] for x in _SPOKEN_PART.finditer(m[0])).lower()
            if not re.search(r"dot|punkt|punto|point|arroba|@|_at_|-at-", spoken) and not m["host"].lower().endswith((".com", ".org", ".net", ".edu", ".gov", ".info")):
                continue  # a bare "at" before a dotted word needs a common ending
            if m["bare"] and m["host"].split()[0].lower() in _NO_HOST and not re.search(rf"[ \t.]{_TOP}\Z", m["host"], re.IGNORECASE):
                continue
            edits += [
                (m.start() + p.start(), m.start() + p.end(), "." if p[1] and p[1].lower() not in ("at", "arroba") else "@")
                for p in _SPOKEN_PART.finditer(m[0])
            ]
        out.replace(edits)
    if _HAS_SPELLED.search(out.text):
        edits = []
        for m in _SPELLED.finditer(out.text):
            if not _HAS_SPELLED.search(m[0]):
                continue
            for p in _SPELLED_PART.finditer(m[0]):
                word, a, b = p[1].lower(), m.start() + p.start(), m.start() + p.end()
                new = _DIGIT_WORDS.get(word) or {"plus": "+", "dash": "-"}.get(word, ".")
                if new in "+-.":  # the space around a spoken mark goes with it
                    while b < m.end() and out.text[b] in " \t":
                        b += 1
                    while new != "+" and a > m.start() and out.text[a - 1] in " \t":
                        a -= 1
                edits.append((a, b, new))
        out.replace([e for k, e in enumerate(edits) if k == 0 or e[0] >= edits[k - 1][1]])
    return None if out.text == text else out


def find_personal_data(text: str | None) -> tuple[dict[str, list[Span]], list[tuple[int, int, int]]]:
    """Base spans by kind, and all spans as ``(start, rank of the kind, end)`` in order."""
    text = text or ""
    base = {kind: find(text) for kind, find in FINDERS.items()}
    every = [(a, k, b) for k, kind in enumerate(BASE_KINDS) for a, b in base[kind]]
    if (plain := deobfuscate(text)) is not None:
        for k, (kind, find) in enumerate(FINDERS.items()):
            # A kind's spans are in order and apart, so of those that start before `b` the last ends last.
            starts = [a for a, _ in base[kind]]
            for span in find(plain.text):
                a, b = plain.source(span)
                before = bisect_left(starts, b)
                if before == 0 or base[kind][before - 1][1] <= a:
                    every.append((a, len(BASE_KINDS) + k, b))
    return base, sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_hidden, base_sha256, spans`` for every row of ``docs``.

    Spans are code points of the source text, end exclusive.  ``spans`` joins all as
    ``kind:start:end`` by start, then kind in the order of `KINDS`; ``base_sha256`` is
    the digest of the same text for the fixed patterns alone.  A null or empty text
    has no spans.  Null ids and repeated rows are rows like any other, other columns
    are ignored, an empty table gives an empty result.
    """

    shipping.ship(docs.sparkSession)

    @F.pandas_udf("struct<n_email: long, n_ip: long, n_card: long, n_phone: long, n_hidden: long, base: string, spans: string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, every = find_personal_data(t)
                rows.append((*(len(base[k]) for k in BASE_KINDS), sum(k >= len(BASE_KINDS) for _, k, _ in every), joined([s for s in every if s[1] < len(BASE_KINDS)]), joined(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_hidden", "base", "spans"])

    found = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("s"))
    return found.select(
        "doc_id", "s.n_email", "s.n_ip", "s.n_card", "s.n_phone", "s.n_hidden", F.sha2(F.col("s.base").cast("binary"), 256).alias("base_sha256"), "s.spans"
    )
