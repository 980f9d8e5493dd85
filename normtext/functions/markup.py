"""HTML read from left to right inside the row: tokens, references and plain text as column helpers.

One pattern with ordered alternatives cuts the source into tokens that tile it: comments, script
and style with their raw contents, declarations, tags whose quoted attribute values may hold
``>``, text, and a ``<`` that opens nothing. ``br`` and ``p`` mark breaks and never nest. Character references are decoded
once, in text and attribute values alone: numeric ones and all named ones, with or without
their semicolon; unknown names stay as they are. ``sources/html_reader`` has the same tokens and keeps the stack of open elements.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from normtext.functions.text import sql_literal, strip

TEXT, OPEN, CLOSE, MARK, NOTHING = range(5)

_INSIDE = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""
TOKEN = (
    r"(?s)<!--.*?-->"
    + "".join(rf"|<(?i:{raw})\b{_INSIDE}.*?(?:</(?i:{raw})\s*+>|\z)" for raw in ("script", "style"))
    + rf"|<[!?][^>]*+>|</?[A-Za-z]{_INSIDE}|[^<]++|<"
)
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"']*)"""

# Elements that have no contents, and the paragraph, which here is a break.
MARKS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "p", "param", "source", "track", "wbr",
)


def _by_first_letter() -> str:
    """Names and characters as one map for each first letter from A to z: a map is searched entry by entry."""
    letters: dict[str, dict[str, str]] = {chr(c): {} for c in range(ord("A"), ord("z") + 1)}
    for name, character in html5.items():
        name = name.rstrip(";")
        letters[name[0]][name] = character
    maps = (
        f"str_to_map({sql_literal(chr(1).join(n + chr(2) + c for n, c in names.items()))}, '\\u0001', '\\u0002')" if names else "map('', '')"
        for names in letters.values()
    )
    return "array(" + ", ".join(maps) + ")"


def _control_codes() -> str:
    """The code points 128 to 159 as Windows-1252 has them, which is what pages mean by them."""
    return "array(" + ", ".join(f"'{ord(bytes([c]).decode('cp1252', errors='replace')):X}'" for c in range(128, 160)) + ")"


def decode_references(text: Column) -> Column:
    """Every character reference decoded, in one pass from left to right: ``&amp;lt;`` is ``&lt;``.

    A name is as long as its letters and digits go on, and must be known as a whole.
    """
    names = F.expr(_by_first_letter())
    controls = F.expr(_control_codes())

    # Each step is a pass of its own: what a lambda names is computed again wherever it stands.
    def read(part: Column) -> Column:
        return F.struct(part.alias("part"), F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);?", 1).alias("told"))

    def counted(r: Column) -> Column:
        digits = F.when(F.lower(F.substring(r["told"], 2, 1)) == "x", F.conv(F.substring(r["told"], 3, 6), 16, 10)).otherwise(F.substring(r["told"], 2, 7))
        number = F.when(F.startswith(r["told"], F.lit("#")), digits.cast("int"))
        return F.struct(
            r["part"].alias("part"), r["told"].alias("told"), number.alias("number"),
            F.when(r["told"] != "", F.substr(r["part"], F.length(r["told"]) + 1)).alias("rest"),
        )

    def decoded(r: Column) -> Column:
        number = r["number"]
        safe = F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("FFFD")).when(
            number.between(128, 159) & (F.get(controls, number - 128) != "FFFD"), F.get(controls, number - 128)
        ).otherwise(F.hex(number))
        character = F.when(number.isNotNull(), F.decode(F.unhex(F.lpad(safe, 8, "0")), "UTF-32")).otherwise(
            F.try_element_at(F.get(names, F.ascii(r["told"]) - ord("A")), r["told"])
        )
        after = F.when(F.startswith(r["rest"], F.lit(";")), F.substr(r["rest"], F.lit(2))).otherwise(r["rest"])
        return F.coalesce(F.when(r["told"] != "", F.concat(character, after)), F.concat(F.lit("&"), r["part"]))

    parts = F.split(text, "&", -1)
    found = F.transform(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), read), counted)
    return F.when(
        F.contains(text, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(found, decoded), ""))
    ).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, references decoded; null if the tag has none of that name."""
    other = rf"[\s/]+(?!{name}[\s=/>])[^\s/>=]+(?:\s*=\s*{_VALUE})?"
    found = rf"(?is)^<[a-z][^\s/>]*(?:{other})*[\s/]+({name}(?=[\s=/>])(?:\s*=\s*{_VALUE})?)"
    # Name and value as they stand come from one search, the value from those few letters.
    value = rf"(?is)^{name}\s*(?:=\s*[\"']?)?(.*?)[\"']?\z"
    told = F.transform(
        F.array(F.regexp_extract(tag, found, 1)), lambda whole: F.when(whole != "", F.regexp_extract(whole, value, 1))
    )
    return F.get(F.transform(told, decode_references), F.lit(0))


def tokens(html: Column) -> Column:
    """array<struct<kind, name, token>> of the whole source; text is decoded, names are in lower case."""
    cut = F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))
    named = F.transform(cut, lambda t: F.struct(
        F.when(F.startswith(t, F.lit("<")), F.lower(F.regexp_extract(t, r"^<(?!(?i:script|style)\b)/?([A-Za-z][^\s/>]*)", 1)))
        .otherwise("").alias("name"), t.alias("token"),
    ))
    marks = F.array(*map(F.lit, MARKS))

    def told(t: Column) -> Column:
        tag = F.when(F.startswith(t["token"], F.lit("</")), F.when(F.array_contains(marks, t["name"]), NOTHING).otherwise(CLOSE)).when(
            F.array_contains(marks, t["name"]) | F.endswith(t["token"], F.lit("/>")), MARK
        ).otherwise(OPEN)
        text = (t["name"] == "") & (~F.startswith(t["token"], F.lit("<")) | (t["token"] == "<"))
        kind = F.when(t["name"] != "", tag).when(text, TEXT).otherwise(NOTHING)
        return F.struct(kind.alias("kind"), t["name"].alias("name"), F.when(text, decode_references(t["token"])).otherwise(t["token"]).alias("token"))

    return F.transform(named, told)


def tidy(text: Column) -> Column:
    """White space as provisions have it: plain spaces, no spaces around line ends, at most one blank line."""
    text = F.translate(text, " ", " ")
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize_text(fragment: Column) -> Column:
    """Plain text of an HTML fragment: br is a line end, p a blank line, other tags vanish."""
    pieces = F.transform(tokens(fragment), lambda t: F.when(t["kind"] == TEXT, t["token"]).when(
        t["kind"] == MARK, F.when(t["name"] == "br", "\n").when(t["name"] == "p", "\n\n").otherwise("")
    ).otherwise(""))
    return tidy(F.array_join(pieces, ""))
