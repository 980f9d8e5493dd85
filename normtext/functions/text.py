"""Column helpers over text. Offsets and lengths are Unicode code points, 0-based."""

from __future__ import annotations

import re
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_CASE = "(?iuU)"  # Unicode-aware case folding, \w and \b
UNICODE = "(?uU)"
MATCH_TYPE = "array<struct<span:string,start:int,end:int,ahead:string>>"
BLOCK = 64
WHITESPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # UNICODE \s
MARKS, STAND_INS = "\ufdd0\ufdd1\ufdd2", "\ufdd3\ufdd4\ufdd5"  # no characters: texts may hold them, but hardly do


def leading_letters(pattern: str) -> str:
    """The ASCII letters of which every match of ``pattern`` begins with one, sorted; empty if that can't be told."""

    def of(parts) -> set[str]:
        for kind, value in parts:
            if kind is kinds.AT:
                continue
            if kind is kinds.LITERAL and chr(value).isascii() and chr(value).isalpha():
                return {chr(value)}
            if kind is kinds.SUBPATTERN:
                return of(value[3])
            if kind is kinds.BRANCH:
                branches = [of(b) for b in value[1]]
                return set().union(*branches) if all(branches) else set()
            if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
                return of(value[2])
            break
        return set()

    try:
        return "".join(sorted(of(parser.parse(pattern))))
    except re.error:  # a pattern of another dialect
        return ""


def quick(flags: str, pattern: str) -> str:
    """``pattern`` under ``flags``, with the same matches: a place whose letter can't begin one is left before its word boundary,
    by far the dearer test, is looked at. The letters obey the same flags as the pattern."""
    letters = leading_letters(pattern)
    one = re.match(r"\\b([A-Za-z])(?![?*+{])([^|]*)$", pattern)
    if letters and one:  # the letter itself goes first and looks back at its boundary
        return f"{flags}[{one[1]}](?<=\\b[{one[1]}]){one[2]}"
    return f"{flags}(?=[{letters}])(?:{pattern})" if letters else flags + pattern


def sql_literal(value: str) -> str:
    """A Spark SQL string literal for any text, patterns included."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def marked_sql(text: str) -> str:
    """SQL for array<struct<clean, text>> of one item: the text without the three characters that mark matches, and whether it had none."""
    clean = " AND ".join(f"NOT contains({text}, '{m}')" for m in MARKS)
    return (
        f"transform(array(octet_length({text}) = length({text}) OR {clean}), c -> named_struct('clean', c,"
        f" 'text', if(c, {text}, translate({text}, '{''.join(MARKS)}', '{STAND_INS}'))))"
    )


def matches_sql(text: str, pattern: str, ahead: str | None = None, computed: bool = False) -> str:
    """SQL for every match of ``pattern`` in the SQL expression ``text``.

    array<struct<span, start, end, ahead>> in text order. ``ahead`` is a pattern for text to
    read after each match without consuming it. The pattern must not match the empty string. With
    ``computed`` the pattern is itself an SQL expression, one pattern per row.
    """
    if computed:
        return marked_matches_sql(text, pattern, f"'{MARKS[0]}$0{MARKS[1]}{MARKS[2]}'")
    return marked_matches_sql(text, *map(sql_literal, search(pattern, ahead)))


def search(pattern: str, ahead: str | None = None) -> tuple[str, str]:
    """The pattern to search for and what it is replaced by, so that matches stand between marks with the text ahead."""
    if ahead is None:
        return pattern, f"{MARKS[0]}$0{MARKS[1]}{MARKS[2]}"
    flags = next((f for f in (IGNORE_CASE, UNICODE) if pattern.startswith(f)), "")
    body = pattern[len(flags) :]
    return f"{flags}(?:{body})(?=({ahead}))", f"{MARKS[0]}$0{MARKS[1]}${re.compile(body).groups + 1}{MARKS[2]}"


def marked_matches_sql(text: str, regex: str, replacement: str) -> str:
    """``matches_sql`` from SQL expressions for the text, the pattern and the replacement of ``search``."""
    return f"flatten(transform({marked_sql(text)}, v -> {found_sql(text, regex, replacement)}))"


def found_sql(text: str, regex: str, replacement: str) -> str:
    """The matches in ``v``, an item of ``marked_sql(text)``: many patterns over a text look for the marks in it once.

    One pass of the pattern puts marks around every match; the rest is cutting at the marks and adding up
    lengths. A fold copies its whole state for each item, so matches are folded in short chunks and
    moved to the result chunk by chunk: a text with many matches stays far from quadratic. It is
    written as SQL text because the same expression built call by call costs a thousand round trips to the JVM.

    A text that holds a mark itself is searched with stand-ins of the same length, and its spans are cut from the original.
    """
    begin, middle, end = MARKS
    stop = "s.at + length(p.span)"
    heads = f"transform(c, p -> named_struct('head', substring_index(p, '{end}', 1), 'chars', length(p)))"  # a head is short, what follows it need not be
    matched = (
        f"transform({heads}, h -> named_struct('span', substring_index(h.head, '{middle}', 1),"
        f" 'ahead', substring_index(h.head, '{middle}', -1), 'after', h.chars - length(h.head) - 1))"
    )

    def cut(value: str, start: str) -> str:
        return f"if(v.clean, {value}, substring({text}, {start} + 1, length({value})))"

    item = (
        f"named_struct('span', {cut('p.span', 's.at')}, 'start', s.at, 'end', {stop}, 'ahead', {cut('p.ahead', stop)})"
    )
    inner = (
        f"aggregate({matched}, named_struct('at', w.at, 'block', cast(array() AS {MATCH_TYPE})),"
        f" (s, p) -> named_struct('at', {stop} + p.after, 'block', concat(s.block, array({item}))))"
    )
    outer = f"aggregate(array({inner}), w, (w, r) -> named_struct('at', r.at, 'done', concat(w.done, array(r.block))))"
    folded = (
        f"aggregate(transform(sequence(0, greatest(size(q) - 2, 0) DIV {BLOCK}), b -> slice(q, cast(b * {BLOCK} + 2 AS int), {BLOCK})),"
        f" named_struct('at', length(q[0]), 'done', cast(array() AS array<{MATCH_TYPE}>)), (w, c) -> {outer}, w -> flatten(w.done))"
    )
    parts = f"split(regexp_replace(v.text, {regex}, {replacement}), '{begin}', -1)"
    return f"flatten(transform(array({parts}), q -> if(size(q) = 1, cast(array() AS {MATCH_TYPE}), {folded})))"


def matches(text: str, pattern: str, ahead: str | None = None) -> Column:
    """``matches_sql`` as a column; ``text`` is a column name or SQL expression."""
    return F.expr(matches_sql(text, pattern, ahead))


# Letters that match another letter without regard to case, though their lower case differs from its (the long s, the dotted I).
_VARIANTS = {
    c: c.upper().lower()
    for c in map(chr, range(0x80, 0x10000))
    if len(c.upper()) == len(c.upper().lower()) == 1 and c.lower() != c.upper().lower()
} | {"İ": "i"}


def folded(text: str) -> str:
    """SQL for the text with every letter as its case-insensitive matches have it, for ``contains``."""
    return (
        f"if(octet_length({text}) = length({text}), lower({text}),"
        f" lower(translate({text}, {sql_literal(''.join(_VARIANTS))}, {sql_literal(''.join(_VARIANTS.values()))})))"
    )


def distinct_lower(text: Column, pattern: str) -> Column:
    """The distinct lower-cased matches, sorted."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def one_line(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    more_than_one_space = r"\s(?:(?<! )\s*|\s+)"  # a single space stays as it is, so it is no match
    return F.trim(F.regexp_replace(text, UNICODE + more_than_one_space, " "))


def strip(text: Column) -> Column:
    """Without the whitespace at both ends; only the ends are looked at."""
    return F.trim(text, F.lit(WHITESPACE))


def sentence_at(text: Column, start: Column, fallback: int) -> Column:
    """The sentence around a 0-based position: after the last period before it, up
    to and including the next one, or ``fallback`` characters on if there is none."""
    before = F.substring(text, F.lit(1), start)
    after = F.substring(text, start + 1, F.length(text))
    head = F.substring_index(before, ".", -1)
    stop = F.instr(after, ".")
    tail = F.when(stop > 0, F.substring(after, F.lit(1), stop)).otherwise(
        F.substring(after, F.lit(1), F.lit(fallback))
    )
    return squeeze(F.concat(head, tail))


def around(text: Column, start: Column, end: Column, width: int) -> Column:
    """``width`` characters either side of [start, end), on one line."""
    low = F.greatest(start - width, F.lit(0))
    return one_line(F.substring(text, low + 1, end + width - low))


def occurrences(text: Column, quote: Column) -> Column:
    """How often a non-empty quote occurs in a text, without overlaps."""
    shorter = F.length(F.replace(text, quote, F.lit("")))
    return ((F.length(text) - shorter) / F.length(quote)).cast("int")


def spaced_pattern(quote: Column) -> Column:
    """A pattern for the quote's words with any whitespace between them."""
    words = F.split(squeeze(quote), " ")
    safe = F.transform(words, lambda w: F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")))
    quoted = F.transform(safe, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E")))
    return F.concat(F.lit(UNICODE), F.array_join(quoted, r"\s+"))
