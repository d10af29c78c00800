"""Personal data, also in disguise, with offsets into the source text.

Base detectors find e-mail addresses, IPv4 addresses, card and phone numbers
as they stand.  For texts that show signs of a disguise, transducers rewrite

1. characters: look-alikes of other scripts, full-width forms and digits of
   other scripts become ASCII, invisible characters go;
2. spelled digits: three or more in a row become digits, ``plus`` before them
   a plus sign;
3. ``at`` and ``dot``, in brackets or as words between names, become signs.

Every rewritten character knows the source characters that it stands for.
The detectors run over the rewritten text, and what they find there is mapped
back.  All steps are linear in the text, whatever it holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import renamed, small_batches, with_fields

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only match from its first one, so nothing is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap, in order of start and kind."""
    found: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    if not _ANY_DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


#: Letters of other scripts and the Latin letters that they look like.
_LOOKS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "。": ".", "．": ".", "․": ".", "‐": "-", "‑": "-", "–": "-",
    "\xa0": " ",
}
#: Characters that do not show.
_HIDDEN = "\xad​‌‍⁠﻿"


def _character_table() -> dict[int, str]:
    table = {ord(k): v for k, v in _LOOKS.items()} | {ord(c): "" for c in _HIDDEN}
    table |= {c: chr(c - 0xFF01 + 0x21) for c in range(0xFF01, 0xFF5F)}
    for c in [*range(0x660, 0x3000), *range(0xA620, 0xABFA), *range(0x1D7CE, 0x1D800)]:
        if unicodedata.category(chr(c)) == "Nd":
            table[c] = str(unicodedata.digit(chr(c)))
    return table


_TABLE = _character_table()
_STRANGE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_TABLE)) + "]")

#: Digits as words in English, German, French and Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_DIGIT = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_GAP = r"(?:[\x20\t\n]{1,2}|[\x20]?-[\x20]?|,[\x20]?)"
# "dot" and digits may stand among them, so that addresses and numbers half in digits are met.
_RUN = re.compile(rf"(?i)\b(?:plus{_GAP})?{_DIGIT}(?:{_GAP}(?:{_DIGIT}|dot|[0-9]))+\b")
_PART = re.compile(rf"(?i)\b(?:(plus){_GAP})?({_DIGIT})\b|\bdot\b")
#: Ends of domain names that tell a disguised address in plain words from prose.
_ENDS = "com|org|net|edu|gov|info|biz|io|co|ai|app|dev|eu|de|fr|es|it|nl|at|ch|uk|us|ca|au|jp|cn|ru|br|in|mx|se|no|pl"
_AT = re.compile(
    r"(?i)[\x20]{0,2}[\[({<][\x20]{0,2}(?:at|@)[\x20]{0,2}[\])}>][\x20]{0,2}"
    r"|(?<=[a-z0-9])[\x20]{1,2}@[\x20]{1,2}(?=[a-z0-9])"
    r"|(?<=[a-z0-9])[\x20]{1,2}at[\x20]{1,2}"
    r"(?=[a-z0-9-]{1,63}(?:(?:[\x20]{1,2}dot[\x20]{1,2}|[\x20]{0,2}[\[({<][\x20]{0,2}(?:dot|\.)[\x20]{0,2}[\])}>][\x20]{0,2}|\.)[a-z0-9-]{1,63}){0,4}"
    rf"(?:[\x20]{{1,2}}dot[\x20]{{1,2}}|[\x20]{{0,2}}[\[({{<][\x20]{{0,2}}(?:dot|\.)[\x20]{{0,2}}[\])}}>][\x20]{{0,2}})(?:{_ENDS})\b)"
)
_DOT = re.compile(
    r"(?i)[\x20]{0,2}[\[({<][\x20]{0,2}(?:dot|\.)[\x20]{0,2}[\])}>][\x20]{0,2}"
    r"|(?<=[a-z0-9])[\x20]{1,2}dot[\x20]{1,2}(?=[a-z0-9])"
    rf"|(?<=[a-z0-9])[\x20]{{1,2}}\.[\x20]{{1,2}}(?=(?:{_ENDS})\b)"
)
# Plain "at" before a domain with plain dots: an address unless the word before it is one of prose.
_AT_PLAIN = re.compile(
    rf"(?i)(?<=[a-z0-9])[\x20]{{1,2}}at[\x20]{{1,2}}(?=[a-z0-9-]{{1,63}}(?:\.[a-z0-9-]{{1,63}}){{0,4}}\.(?:{_ENDS})\b(?!\.?[a-z0-9-]))"
)
_WORD_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+$")
#: Words that stand before "at" and a site's name in prose.
_PROSE = frozenset(
    "a accessible all am and any are article articles at available be been blog book books buy by can check code contact data date "
    "demo details discussion do docs documentation download email everything example examples find for found free from further get "
    "go guide he help her here him hosted i info information is it it's join just learn like listed live login look me more news not "
    "now offer offered on one online only or order out page pages participate people post posted posts price published read report "
    "reports resources review reviews sale see seen shop shown sign site sold someone something start stories story support team that "
    "the them there these they this those tickets today tutorial up us version video videos view visit was watch we website week were "
    "what work worked working works you".split()
)
_SIGNS = re.compile(r"[\[({<][\x20]{0,2}(?:at|@|dot|\.)[\x20]{0,2}[\])}>]")
_ANY_DIGIT = re.compile("[0-9]")


def _suspect(text: str) -> bool:
    """Whether a text may hold spelled digits or a disguised sign, by cheap looks."""
    low = text.lower()
    if "dot" in low or " @ " in low or _SIGNS.search(low):
        return True
    if " at " in low.replace("  ", " ") and _AT_PLAIN.search(low):
        return True
    return sum(map(_SPELLED.__contains__, low.replace("-", " ").replace(",", " ").split())) >= 3


class Mapped:
    """A rewritten text whose character ``k`` stands for ``source[start[k] : end[k]]``."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ``text[a:b]`` by ``new`` for each edit; edits are in order and apart."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            changed += [self.changed[at:a], np.ones(len(new), bool)]
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start = np.concatenate([*start, self.start[at:]])
        self.end = np.concatenate([*end, self.end[at:]])
        self.changed = np.concatenate([*changed, self.changed[at:]])


def _names(text: str, at: int) -> bool:
    """Whether the word that ends at ``at`` may be the name in an address."""
    word = _WORD_BEFORE.search(text, max(0, at - 64), at)
    return word is not None and word[0].lower() not in _PROSE


def undisguise(text: str) -> Mapped | None:
    """The rewritten text, or None if it has no sign of a disguise."""
    strange = None if text.isascii() else _STRANGE.search(text)
    if not strange and not _suspect(text):
        return None
    out = Mapped(text)
    if strange:
        out.rewrite([(m.start(), m.end(), _TABLE[ord(m[0])]) for m in _STRANGE.finditer(text)])
    edits = []
    for run in _RUN.finditer(out.text):
        parts = list(_PART.finditer(out.text, run.start(), run.end()))
        if sum(p[2] is not None for p in parts) < 3:
            continue
        at = None
        for p in parts:
            # What stands between two digits of a run goes with the second.
            a = p.start() if at is None else at
            if p[2] is None:
                new = "."
            else:
                new = "+" * bool(p[1]) + _SPELLED[p[2].lower()]
            gap = out.text[a : p.start()]
            if re.search(r"[0-9]", gap):  # plain digits in the run stay where they are
                a = p.start()
            edits.append((a, p.end(), new))
            at = p.end()
    out.rewrite(edits)
    out.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(out.text)])
    out.rewrite([(m.start(), m.end(), "@") for m in _AT_PLAIN.finditer(out.text) if _names(out.text, m.start())])
    out.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(out.text)])
    return out if out.changed.any() or len(out.text) < len(text) else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that only the rewritten text shows; none of these overlaps a base span of its kind."""
    base = detect(text)
    seen = undisguise(text)
    if seen is None:
        return base, []
    taken = {k: [(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))}
    added = []
    for s, kind, e in detect(seen.text):
        a, b = int(seen.start[s]), int(seen.end[e - 1])
        if seen.changed[s:e].any() or b - a != e - s:
            own = taken[kind]
            at = np.searchsorted([x[1] for x in own], a, side="right")
            if at == len(own) or own[at][0] >= b:
                added.append((a, kind, b))
    return base, added


def scan(df: DataFrame, *, text: str = "text", into: str = "pii") -> DataFrame:
    """Add ``into``: an array of ``kind, start, end, disguised`` (code points, end exclusive) in order, to every row.

    Edge cases: a null text is empty and has none; whole texts are read, of
    any length; repeated rows have equal results; other columns are kept as
    they are, one named ``into`` is replaced; no rows give no rows.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != into]
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                base, added = find(value.as_py() or "")
                spans = sorted([(*x, False) for x in base] + [(*x, True) for x in added])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "disguised": d} for s, k, e, d in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(item))], [*keep, into])

    schema = with_fields(df, keep, **{into: "array<struct<kind: string, start: int, end: int, disguised: boolean>>"})
    return df.select(*renamed(keep), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with ``[KIND]`` in place of each span ``start, end, kind``; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def op4(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("pii", lambda x: ~x["disguised"])
    count = lambda kind: F.size(F.filter("pii", lambda x: ~x["disguised"] & (x["kind"] == kind))).cast("long")
    return scan(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.encode(told(base), "UTF-8"), 256).alias("base_sha256"),
        told(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda x: x["disguised"])).cast("long").alias("n_disguised"),
    )
