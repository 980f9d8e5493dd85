"""Statute HTML read from left to right, one document at a time, in Arrow tasks.

The tokens, elements and references are those of ``functions/markup``: the pattern tiles the source, ``br`` and
``p`` mark breaks and never nest, an end tag closes all up to its element and does nothing where none is open. A stack
over the tokens is a loop that no column expression runs cheaply: a fold copies its state for each token, and lambdas are
interpreted. Here a token is met once for its place and once more in each provision that holds it. References are
decoded, once, where a text or an attribute is read.

The functions are pickled by value, so executors need no copy of the package on their path.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from html.entities import html5
from itertools import chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from normtext.functions.markup import CLOSE, MARK, MARKS, NOTHING, OPEN, TEXT
from normtext.functions.text import WHITESPACE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARAGRAPH, TRANSITIONAL_PROVISION, REJECT = "paragraph", "transitional_provision", "reject"
ANCHOR, CHAPTER, HEADING, TRANSITIONAL = "anchor", "chapter", "heading", "transitional"

FIELDS = [
    StructField("provision_suffix", StringType()),
    StructField("kind", StringType()),
    StructField("source_anchor", StringType()),
    StructField("source_anchor_occurrence", IntegerType()),
    StructField("label", StringType()),
    StructField("chapter", StringType()),
    StructField("heading", StringType()),
    StructField("order", IntegerType()),
    StructField("text", StringType()),
    StructField("subsection_anchors", ArrayType(StringType())),
    StructField("amendment_notes", ArrayType(StringType())),
]
ARROW_FIELDS = [
    *[(f.name, pa.int32() if isinstance(f.dataType, IntegerType) else pa.string()) for f in FIELDS[:-2]],
    *[(f.name, pa.list_(pa.string())) for f in FIELDS[-2:]],
]
BATCH_ROWS, BATCH_CHARS = 10_000, 4 << 20  # a batch of results ends after so many rows or characters
KEPT, KEPT_CHARS = 50_000, 500  # tags and references that a worker keeps what it has read of, and how long they may be

# Java's classes, which the column helpers match with: white space and digits are ASCII, a word boundary is not.
_S = r"[ \t\n\x0b\f\r]"
_NOT_S = r"[^ \t\n\x0b\f\r]"
_END = r"(?:\r\n|[\n\r\x85\u2028\u2029])?\Z"  # Java's $: also before a last line end


def _raw(name: str) -> str:
    """``name`` in either case, of ASCII letters alone."""
    return "".join(f"[{c}{c.upper()}]" for c in name)


_INSIDE = rf"""(?:[^>=]++|={_S}*+"[^"]*+"|={_S}*+'[^']*+'|=)*+>"""
TOKEN = re.compile(
    r"(?s)<!--.*?-->"
    + "".join(rf"|<{_raw(raw)}\b{_INSIDE}.*?(?:</{_raw(raw)}{_S}*+>|\Z)" for raw in ("script", "style"))
    + rf"|<[!?][^>]*+>|</?[A-Za-z]{_INSIDE}|[^<]++|<"
)
_NAME = re.compile(rf"<(?!(?:{_raw('script')}|{_raw('style')})\b)/?([A-Za-z][^ \t\n\x0b\f\r/>]*)")
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"']*)"""


def _attribute_patterns(name: str) -> tuple[re.Pattern, re.Pattern]:
    """As ``markup.attribute`` has them."""
    other = rf"[\s/]+(?!{name}[\s=/>])[^\s/>=]+(?:\s*=\s*{_VALUE})?"
    found = rf"(?ais)^<[a-z][^\s/>]*(?:{other})*[\s/]+({name}(?=[\s=/>])(?:\s*=\s*{_VALUE})?)"
    return re.compile(found), re.compile(rf"(?ais)^{name}\s*(?:=\s*[\"']?)?(.*?)[\"']?\Z")


_ATTRIBUTES = {name: _attribute_patterns(name) for name in ("name", "class")}
_REFERENCE = re.compile(r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);?)")
_NAMED = {name.rstrip(";"): character for name, character in html5.items()}
_CHAPTER_NAME = re.compile(rf"^K[0-9]+{_END}")
_SUBSECTION = re.compile(rf"^P{_NOT_S}+S[0-9]+{_END}")
_MARKER = r"[0-9]{4}:[0-9]+(?=[\n\x85\u2028\u2029]|\Z)"  # a line of its own; tidied text holds no \r
_PIECE = re.compile(rf"(?:\A|(?<=[\n\x85\u2028\u2029]))(?={_MARKER})")
_NUMBER = re.compile(rf"({_MARKER})")


def _character(reference: str) -> str:
    told = reference[1:].rstrip(";")
    if told[0] != "#":
        return _NAMED.get(told, reference)
    number = int(told[2:], 16) if told[1] in "xX" else int(told[1:])
    if number == 0 or 0xD800 <= number <= 0xDFFF or number > 0x10FFFF:
        return "\ufffd"
    if number == 0xFEFF:  # ``markup.decode_references`` reads UTF-32, where this is the mark of the byte order
        return ""
    if 128 <= number <= 159:  # as Windows-1252 has them, which is what pages mean
        meant = bytes([number]).decode("cp1252", errors="replace")
        return chr(number) if meant == "\ufffd" else meant
    return chr(number)


class _Kept(dict):
    """What a function made of each short string, made again once many are held."""

    def __init__(self, make: Callable[[str], object]) -> None:
        self.make = make

    def __missing__(self, key: str) -> object:
        made = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[key] = made
        return made


_characters = _Kept(_character)


def decoded(text: str) -> str:
    """Every character reference decoded, in one pass from left to right."""
    if "&" not in text:
        return text
    parts = _REFERENCE.split(text)
    parts[1::2] = map(_characters.__getitem__, parts[1::2])
    return "".join(parts)


def attribute(tag: str, name: str) -> str | None:
    """The value of an attribute of a start tag, references decoded; None if the tag has none of that name."""
    found, value = _ATTRIBUTES[name]
    whole = found.match(tag)
    return decoded(value.match(whole[1])[1]) if whole else None


def _tag(token: str) -> tuple[int, str, str | None, str | None]:
    """Kind, name, the ``name`` attribute of an anchor or chapter, and role of a token that begins with ``<``."""
    found = _NAME.match(token)
    if not found:
        return NOTHING, "", None, None
    name = found[1].lower()
    if token.startswith("</"):
        return (NOTHING if name in MARKS else CLOSE), name, None, None
    if name in MARKS or token.endswith("/>"):
        return MARK, name, None, None
    if name == "h4":
        return OPEN, name, None, HEADING
    if name not in ("a", "h3"):
        return OPEN, name, None, None
    label, role = attribute(token, "name"), None
    if label is not None and name == "h3":
        role = CHAPTER if _CHAPTER_NAME.search(label) else TRANSITIONAL if label == "overgang" else None
    elif label is not None and "paragraf" in re.split(_S, attribute(token, "class") or ""):
        role = ANCHOR
    return OPEN, name, label, role


def tidy(text: str) -> str:
    """White space as provisions have it, as ``markup.tidy``."""
    text = text.strip(WHITESPACE)
    for space in "\xa0\t\r\f\x0b":
        if space in text:
            text = text.replace(space, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    if "\n" in text:
        text = text.replace(" \n", "\n").replace("\n ", "\n")
        while "\n\n\n" in text:
            text = text.replace("\n\n\n", "\n\n")
    return text


class Statute:
    """The events of one source: a text is a ``str``, as it stands, any other token what ``_tag`` says of it.

    ``depths`` has the number of elements around each event (its own not counted), ``ends`` for each that opens an
    element the place of the one that ends it, or the number of events if none does. ``told`` holds ``(depth, at,
    parent, role, chapter, heading)`` of each anchor and heading, where the last three of the places are -1 if there is none.
    """

    def __init__(self, source: str, tags: _Kept) -> None:
        self.events = events = TOKEN.findall(source)
        self.size = len(events)
        self.depths, self.ends, self.told, self.closing = [], {}, [], None
        stack, standing = [], {}  # names and places of the open elements, and how many there are of a name
        depth, chapter, heading = 0, -1, -1
        deep = self.depths.append
        for at, token in enumerate(events):
            if token[0] != "<" or token == "<":
                deep(depth)
                continue
            events[at] = tag = tags[token]
            kind, name, _, role = tag
            if kind == CLOSE:
                if standing.get(name):
                    last = None
                    while last != name:
                        last, opened = stack.pop()
                        standing[last] -= 1
                        self.ends[opened] = at
                    depth = len(stack)
                deep(depth)
                continue
            deep(depth)
            if kind == OPEN:
                if role is not None or name == "h3":
                    self.told.append((depth, at, stack[-1][1] if stack else -1, role, chapter, heading))
                    if role == CHAPTER:
                        chapter = at
                    elif role == HEADING:
                        heading = at
                    elif role == TRANSITIONAL and self.closing is None:
                        self.closing = at
                stack.append((name, at))
                standing[name] = standing.get(name, 0) + 1
                depth += 1
        for _, opened in stack:
            self.ends[opened] = self.size

    def joined(self, start: int, stop: int) -> str:
        """The texts from one place to another, each without outer white space, joined by a space."""
        texts = [decoded(event).strip(WHITESPACE) for event in self.events[start:stop] if type(event) is str]
        return " ".join([t for t in texts if t])

    def inside(self, at: int) -> str:
        """The joined texts of the element that the event at this place opens; none for -1."""
        return self.joined(at + 1, self.ends[at]) if at >= 0 else ""

    def siblings(self, start: int, stop: int, depth: int) -> str:
        """Text of neighbouring nodes that stand ``depth`` deep, as it is, with breaks; inside one node texts are parted by a space."""
        out, inside = [], False
        for event, deep in zip(self.events[start:stop], self.depths[start:stop]):
            if type(event) is str:
                if inside and deep > depth:
                    out.append(" ")
                inside = deep != depth
                out.append(decoded(event) if "&" in event else event)
            elif deep == depth:
                inside = False
                if event[0] == MARK:
                    out.append("\n" if event[1] == "br" else "\n\n" if event[1] == "p" else "")
        return tidy("".join(out))

    def provisions(self) -> Iterator[tuple]:
        """One row of ``FIELDS`` for each paragraph anchor, in order.

        Its contents are the anchor's following siblings: they end at the next heading or anchor as
        deep as it, or with the element around them.
        """
        ordered, found = sorted(self.told, key=lambda x: x[:2]), []
        for i, (depth, at, parent, role, chapter, heading) in enumerate(ordered):
            if role == ANCHOR:
                stop = self.size if parent < 0 else self.ends[parent]
                if i + 1 < len(ordered) and ordered[i + 1][0] == depth:
                    stop = min(stop, ordered[i + 1][1])
                found.append((at, stop, depth, chapter, heading))
        seen, texts = {}, {-1: ""}
        for order, (at, stop, depth, chapter, heading) in enumerate(sorted(found), 1):
            for place in (chapter, heading):
                if place not in texts:
                    texts[place] = self.inside(place)
            name, first = self.events[at][2], self.ends[at] + 1
            nth = seen[name] = seen.get(name, 0) + 1
            anchors, notes = [], []
            for k, event in enumerate(self.events[first:stop], first):
                if event[0] == OPEN:  # of a text this is a letter
                    _, tag, label, _ = event
                    if tag == "i":
                        notes.append(self.joined(k + 1, min(self.ends[k], stop)))
                    elif tag == "a" and label is not None and _SUBSECTION.search(label):
                        anchors.append(label)
            yield (
                name if nth == 1 else f"{name}:occurrence:{nth}", PARAGRAPH, name, nth, self.inside(at), texts[chapter], texts[heading], order,
                self.siblings(first, stop, depth), anchors, notes,
            )

    def transitional(self) -> Iterator[tuple]:
        """One row of ``FIELDS`` for each piece of the transitional section, cut at lines that are only ``YYYY:N``; a section without any gives a reject."""
        if self.closing is None:
            return
        first, depth = self.ends[self.closing] + 1, self.depths[self.closing]
        stop = next((k for k in range(first, self.size) if self.depths[k] < depth), self.size)
        order = sum(x[3] == ANCHOR for x in self.told)
        pieces = [p for p in _PIECE.split(self.siblings(first, stop, depth)) if _NUMBER.match(p)]
        for order, piece in enumerate(pieces, order + 1):
            number = _NUMBER.match(piece)[1]
            yield (
                f"overgang:{number.replace(':', '-')}", TRANSITIONAL_PROVISION, "overgang", 1, f"SFS {number}", "", "Övergångsbestämmelser", order,
                piece.strip(WHITESPACE), [], [],
            )
        if not pieces:
            yield ("", REJECT, "", 1, "", "", "", order, "", [], [])


def _batch(source: pa.RecordBatch, keep: list[str], places: list[int], rows: list[tuple]) -> pa.RecordBatch:
    kept = [source.column(i).take(pa.array(places, pa.int32())) for i in range(len(keep))]
    read = [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), ARROW_FIELDS)]
    return pa.record_batch([*kept, *read], [*keep, *[name for name, _ in ARROW_FIELDS]])


def _read(batches: Iterator[pa.RecordBatch], keep: list[str], kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    tags = _Kept(_tag)
    for batch in batches:
        places, rows, chars = [], [], 0
        for place, source in enumerate(batch.column(len(keep)).to_pylist()):
            if source is None:
                continue
            statute = Statute(source.decode("utf-8", errors="replace"), tags)
            readings = [statute.provisions()] if PARAGRAPH in kinds else []
            if TRANSITIONAL_PROVISION in kinds or REJECT in kinds:
                readings.append(statute.transitional())
            for row in chain(*readings):
                if row[1] in kinds:
                    places.append(place)
                    rows.append(row)
                    chars += len(row[4]) + len(row[5]) + len(row[6]) + len(row[8]) + sum(map(len, row[10]))
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield _batch(batch, keep, places, rows)
                        places, rows, chars = [], [], 0
        if rows:
            yield _batch(batch, keep, places, rows)


def read_statutes(documents: DataFrame, keep: Sequence[str], kinds: tuple[str, ...]) -> DataFrame:
    """``keep`` columns with ``FIELDS``: the rows of these kinds from one reading of each ``html``."""
    kept = documents.select(*keep)
    names, schema = kept.columns, StructType([*kept.schema.fields, *FIELDS])
    html = F.col("html").cast("string").cast("binary").alias("_html")
    return documents.select(*keep, html).mapInArrow(lambda batches: _read(batches, names, kinds), schema)
