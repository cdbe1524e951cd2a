"""Personal data in texts, also where it is written so as not to be found.

``find_plain`` finds e-mail addresses, IP addresses, card and telephone numbers
as they stand. ``transduce`` rewrites a disguised text (look-alike characters,
spelled digits, "at" and "dot" in words or brackets) and keeps, for each
character written, the source characters it came from; what is found in the
rewritten text is mapped back to the source. Both go through a text in one
pass, so a very long text costs time in proportion.

Spans are (kind, start, end) in code points, end exclusive. Nulls count as
empty and have none. Repeated rows are searched each on its own. An empty table
gives an empty result.
"""

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ so that long words cost one look."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def find_plain(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by kind and start; what fails a check is passed over whole."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append(("phone", *m.span()))
    return out


# Letters that look like Latin ones (Cyrillic, then Greek), and what they look like.
LOOKALIKES = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhABEKMHOPCTYXIJS")) | dict(
    zip("αορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aopviktABEZHIKMNOPTYX")
)
# Characters that are not seen.
UNSEEN = frozenset("­​‌‍⁠﻿")
# Digits in words.
DIGIT_WORDS = {word: str(n) for n, word in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
#: Digit words in a row that are read as a number; fewer are ordinary words, except between the dots of an address.
DIGIT_ROW = 3

_WORD = "|".join(DIGIT_WORDS)
_DIGIT_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:{_WORD})(?:[ -](?:{_WORD}))+(?![A-Za-z0-9])", re.I)
_DIGIT_WORD = re.compile(_WORD, re.I)
_PART = rf"(?:{_WORD})(?:[ -](?:{_WORD})){{0,2}}"
_IP_SPELLED = re.compile(rf"(?<![A-Za-z0-9]){_PART}(?: (?:dot|point) {_PART}){{3}}(?![A-Za-z0-9])", re.I)
_IP_PIECE = re.compile(rf"[ -]?(?P<digit>{_WORD})| (?:dot|point) ", re.I)
_PLUS = re.compile(r"(?<![A-Za-z])plus (?=[0-9])", re.I)
_BRACKET = re.compile(r" {0,2}[(\[{<] {0,2}(at|dot|arroba|punto|point|punkt) {0,2}[)\]}>] {0,2}", re.I)
# The word at counts only together with a dot that is disguised too: name AT host DOT ending.
_PLAIN_AT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}( at )[A-Za-z0-9-]{1,63}((?:(?: dot |\.)[A-Za-z0-9-]{1,63})+)(?![A-Za-z0-9-])", re.I
)
_AT_HOST = re.compile(r"(?<=[A-Za-z0-9._%+-])@[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+", re.I)
_DOT = re.compile(r" dot |\.", re.I)
_DOT_WORD = re.compile(r" dot ", re.I)
_IP_WORDS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: dot |\.)[0-9]{1,3}){3}(?![0-9])", re.I)
_AT_WORDS = {"at": "@", "arroba": "@"}
# Whatever a rule below rewrites has one of these.
_HINT = re.compile(
    rf"[(\[{{<] {{0,2}}(?:at|dot|arroba|punto|point|punkt)|[A-Za-z0-9-] dot [A-Za-z0-9-]|(?:(?<![A-Za-z])(?:{_WORD})[ -]){{{DIGIT_ROW - 1}}}"
    rf"|(?:{_WORD}) (?:dot|point) (?:{_WORD})|(?<![A-Za-z])plus [0-9]", re.I
)


class Rewritten:
    """A text and, for each of its characters, the source characters [start, end) it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def replace(self, edits: list[tuple[int, int, str]]) -> "Rewritten":
        """Ordered, non-overlapping edits; each new character stands for the whole of what it replaces."""
        if not edits:
            return self
        text, start, end, done = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[done:a], new]
            start += self.start[done:a] + [self.start[a]] * len(new)
            end += self.end[done:a] + [self.end[b - 1]] * len(new)
            done = b
        text.append(self.text[done:])
        return Rewritten("".join(text), start + self.start[done:], end + self.end[done:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _plain_character(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in UNSEEN:
        return ""
    same = unicodedata.normalize("NFKC", c)
    return same if len(same) == 1 and same.isascii() and not same.isspace() else c


def transduce(text: str) -> Rewritten | None:
    """The text without disguises, or None if it has none."""
    new = {} if text.isascii() else {c: p for c in set(text) if not c.isascii() and (p := _plain_character(c)) != c}
    if not new and not _HINT.search(text):
        return None
    out = Rewritten(text)
    if new:
        pattern = re.compile("[" + "".join(map(re.escape, new)) + "]")
        out = out.replace([(m.start(), m.end(), new[m[0]]) for m in pattern.finditer(text)])
    if _HINT.search(out.text):
        edits = []
        for m in _IP_SPELLED.finditer(out.text):
            pieces = list(_IP_PIECE.finditer(out.text, m.start(), m.end()))
            # A dot's own blanks are not those before the digit word that follows.
            edits += [(*p.span(), DIGIT_WORDS[p["digit"].lower()] if p["digit"] else ".") for p in pieces]
        out = out.replace(edits)
        edits = []
        for m in _DIGIT_RUN.finditer(out.text):
            words = [w for w in _DIGIT_WORD.finditer(out.text, m.start(), m.end())]
            if len(words) >= DIGIT_ROW:
                edits += [(a.start(), b.start() if b else a.end(), DIGIT_WORDS[a[0].lower()]) for a, b in zip(words, [*words[1:], None])]
        out = out.replace(edits)
        out = out.replace([(m.start(), m.end(), _AT_WORDS.get(m[1].lower(), ".")) for m in _BRACKET.finditer(out.text)])
        edits, at = [], 0
        while m := _PLAIN_AT.search(out.text, at):
            dots = [d.span() for d in _DOT.finditer(out.text, *m.span(2))]
            # A dot read from brackets or a word stands for more than one character.
            if any(out.end[b - 1] - out.start[a] > 1 for a, b in dots):
                edits += [(*m.span(1), "@"), *((a, b, ".") for a, b in dots if b - a > 1)]
                at = m.end()
            else:
                at = m.end(1)
        out = out.replace(edits)
        out = out.replace([(*d.span(), ".") for m in _AT_HOST.finditer(out.text) for d in _DOT_WORD.finditer(out.text, *m.span())])
        out = out.replace([(*d.span(), ".") for m in _IP_WORDS.finditer(out.text) for d in _DOT_WORD.finditer(out.text, *m.span())])
        out = out.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])
    return None if out.text == text else out


def find_hidden(text: str, plain: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows: none of them lies within a plain span of its kind."""
    rewritten = transduce(text)
    if rewritten is None:
        return []
    found = {(kind, *rewritten.source(a, b)) for kind, a, b in find_plain(rewritten.text)}
    out = []
    for kind in KINDS:
        inside = sorted((a, b) for k, a, b in plain if k == kind)
        i = 0
        for _, a, b in sorted(s for s in found if s[0] == kind):
            while i < len(inside) and inside[i][1] < b:
                i += 1
            if not (i < len(inside) and inside[i][0] <= a and b <= inside[i][1]):
                out.append((kind, a, b))
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, plain, hidden): the spans of each text, by kind and start, in Arrow batches; no shuffle."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        fields = ("kind", "start", "end")
        for batch in batches:
            plain, hidden = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = find_plain(text)
                plain.append([dict(zip(fields, s)) for s in spans])
                hidden.append([dict(zip(fields, s)) for s in find_hidden(text, spans)])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "plain": pa.array(plain, kind), "hidden": pa.array(hidden, kind)}
            )

    key = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {key}, plain {SPANS}, hidden {SPANS}").withColumnRenamed("doc_id", id_column)
