"""Secrets in texts, among them weak ones that only their company gives away.

Strong candidates are reported by themselves: assignments to a name such as
``password``, access identifiers, long hexadecimal words. Weak candidates (an
account name, a word that looks random, a host) are parts of a credential; an
identifier, a secret and an endpoint that lie within one scope are linked, and
weak parts are reported only if at least an identifier and a secret, or a
secret and an endpoint, occur together. Parts may be of any length; a random
word of 8 to 15 characters is a part only beside an identifier or endpoint. A scope is a paragraph, and within it
parts link that are at most ``reach`` characters apart.

Linking is an interval join within a text: places of the parts in order, looked
up by bisection, so no pair of parts is ever formed. Spans are (kind, start,
end) in code points, end exclusive. Nulls count as empty and have none. Repeated
rows are searched each on its own. An empty table gives an empty result.
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRONG = ("assign", "access", "hex")
WEAK = ("identifier", "material", "endpoint")

_NAME = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_VALUE = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|tenant)["']?\x20{0,2}[:=]\x20{0,2}["']?([A-Za-z0-9@+/_.-]{3,})""", re.I)
_ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:@/-]{4,}|(?<![A-Za-z0-9])(?:host|endpoint|server|url)["']?\x20{0,2}[:=]\x20{0,2}["']?([A-Za-z0-9._:/-]{4,}))""", re.I | re.A)
_MATERIAL = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}={0,2}(?![A-Za-z0-9+/_=-])")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

REACH = 200
#: Bits per character from which a word of letters and digits looks random, from so many characters on.
RANDOM_BITS, RANDOM_LENGTH = 3.2, 16
#: How near an identifier or endpoint has to be for a shorter word to count.
BESIDE = 40

Span = tuple[str, int, int]


def _assignments(text: str) -> Iterator[Span]:
    """Leftmost matches of name, separator and value; a value that is too short is passed over whole."""
    at = 0
    while name := _NAME.search(text, at):
        value = _VALUE.match(text, name.end())
        if value and len(value[1]) >= 6:
            yield "assign", name.start(), value.end()
        at = value.end() if value else name.start() + 1


def find_strong(text: str) -> list[Span]:
    """By start, then kind."""
    out = list(_assignments(text))
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    rank = {kind: k for k, kind in enumerate(STRONG + WEAK)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def _looks_random(word: str) -> bool:
    if not (any(map(str.isdigit, word)) and any(map(str.isalpha, word))):
        return False
    counts = [word.count(c) for c in set(word)]
    bits = -sum(n / len(word) * log2(n / len(word)) for n in counts)
    if len(word) >= RANDOM_LENGTH:
        return bits >= RANDOM_BITS
    # Fewer characters hold fewer bits; a plain word with a number behind it changes once.
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in word if c.isalnum()]
    return bits >= RANDOM_BITS * log2(len(word)) / log2(RANDOM_LENGTH) and sum(x != y for x, y in zip(kinds, kinds[1:])) > 1


def _near(starts: list[int], ends: list[int], low: int, high: int) -> bool:
    """Whether a part ends after low and begins before high."""
    return bisect_left(starts, high) > bisect_right(ends, low)


def find_linked(text: str, strong: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts whose complement is near. Strong spans count as secrets, and access identifiers as identifiers."""
    identifiers = [("identifier", *m.span(1)) for m in _IDENTIFIER.finditer(text)]
    endpoints = [("endpoint", m.start(1) if m[1] else m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    access = [s for s in strong if s[0] == "access"]
    if not (identifiers or endpoints or access):
        return []
    taken = sorted((a, b) for _, a, b in strong + identifiers + endpoints)
    begins, tops, top = [a for a, _ in taken], [], 0
    for _, b in taken:
        tops.append(top := max(top, b))
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)]

    def places(parts: list[Span]) -> tuple[list[int], list[int]]:
        return sorted(a for _, a, _ in parts), sorted(b for _, _, b in parts)

    def around(a: int, b: int, most: int) -> tuple[int, int]:
        """What lies within a part's paragraph and at most so far from it."""
        k = bisect_right(breaks, a)
        return max(a - most, breaks[k - 1] if k else 0), min(b + most, breaks[k] if k < len(breaks) else len(text))

    company, material = places(identifiers + access + endpoints), []
    for m in _MATERIAL.finditer(text):
        k = bisect_left(begins, m.end())
        if k and tops[k - 1] > m.start():
            continue
        if (m.end() - m.start() >= RANDOM_LENGTH or _near(*company, *around(*m.span(), BESIDE))) and _looks_random(m[0]):
            material.append(("material", *m.span()))
    has = {
        "identifier": places(identifiers + access),
        "material": places(material + [s for s in strong if s[0] != "access"]),
        "endpoint": places(endpoints),
    }
    needs = {"identifier": ("material",), "material": ("identifier", "endpoint"), "endpoint": ("material",)}
    out = []
    for kind, a, b in identifiers + material + endpoints:
        if any(_near(*has[other], *around(a, b, reach)) for other in needs[kind]):
            out.append((kind, a, b))
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH) -> DataFrame:
    """(id, strong, linked): spans of each text by start, in Arrow batches; no shuffle."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        fields = ("kind", "start", "end")
        for batch in batches:
            strong, linked = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = find_strong(text)
                strong.append([dict(zip(fields, s)) for s in spans])
                linked.append([dict(zip(fields, s)) for s in ordered(find_linked(text, spans, reach))])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "strong": pa.array(strong, kind), "linked": pa.array(linked, kind)}
            )

    key = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {key}, strong {SPANS}, linked {SPANS}").withColumnRenamed("doc_id", id_column)
