"""Licence scan: ordered signature rules over words, gated by keywords, overlaps resolved by priority.

A text becomes its lower-cased words, each between two spaces, so that a rule's pattern matches whole words and
punctuation plays no part. The rules (``license_rules``) whose keywords all occur among the words are tried, in order; a text
without any keyword is done after one look-up of its words. A detection that lies inside one of the same or a higher
priority goes, and of equal stretches the one of the earlier rule stays. The base phrases are found the same way, but
neither drop others nor are dropped. DataFrame functions only.

The score is 1 less the product of (1 - weight) over the labels, each with the weight of its strongest detection.

Defined cases: a null or empty text has no words, no labels and score 0; detections stand in the order of their first
words, longer ones first; matches of one rule don't overlap each other; repeated rows each get their result; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.functions.text import BLOCK, sql_literal
from normtext.llm.license_rules import BASE_PHRASES, RULES, Rule

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = 0  # the priority of base phrases

_FOUND = "array<struct<first:int,less:int,priority:int,rule:int>>"  # ``less`` is the negative end, so that longer sorts first


def spaced(pattern: str) -> str:
    """The pattern over words that each stand between two spaces."""
    return " (?:" + pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + ") "


def all_rules(rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The base phrases, then the rules."""
    return [Rule(BASE, label, weight, tuple(phrase.split()), phrase) for label, weight, phrase in BASE_PHRASES] + list(rules)


def _strings(values: Sequence[str]) -> str:
    return "array(" + ", ".join(map(sql_literal, values)) + ")"


def _rules_sql(rules: Sequence[Rule]) -> str:
    return "array(" + ", ".join(
        f"named_struct('rule', {i}, 'priority', {r.priority}, 'keywords', {_strings(r.keywords)}, 'pattern', {sql_literal(spaced(r.pattern))})"
        for i, r in enumerate(rules)
    ) + ")"


def _words_in(part: str) -> str:
    return f"(length({part}) - length(replace({part}, ' ', ''))) DIV 2"


def _places_sql() -> str:
    """Every match of rule ``r`` in ``line``: what stands between matches and the matches tile it, so word counts give the places."""
    first = f"s.at + cast({_words_in('p.`0`')} AS int)"
    end = f"{first} + cast({_words_in('p.`1`')} AS int)"
    found = f"named_struct('first', {first}, 'less', -({end}), 'priority', r.priority, 'rule', r.rule)"
    full = f"size(s.block) >= {BLOCK}"
    return (
        "aggregate(filter(arrays_zip(split(line, r.pattern, -1), regexp_extract_all(line, r.pattern, 0)), p -> p.`1` IS NOT NULL),"
        f" named_struct('at', 0, 'block', cast(array() AS {_FOUND}), 'done', cast(array() AS array<{_FOUND}>)),"
        f" (s, p) -> named_struct('at', {end}, 'block', if({full}, array({found}), concat(s.block, array({found}))),"
        f" 'done', if({full}, concat(s.done, array(s.block)), s.done)),"
        " s -> flatten(concat(s.done, array(s.block))))"
    )


def _kept_sql(priorities: Sequence[int]) -> str:
    """``found`` in order, less those inside a detection of the same or a higher priority: one sweep with the furthest end of each."""
    ends = [f"s.end{p}" for p in priorities]
    inside = "CASE " + " ".join(
        f"WHEN d.priority = {p} THEN greatest(0, {', '.join(ends[: i + 1])}) >= -d.less" for i, p in enumerate(priorities)
    ) + " END"
    further = ", ".join(f"'end{p}', if(d.priority = {p}, greatest(s.end{p}, -d.less), s.end{p})" for p in priorities)
    block = f"if({inside}, s.block, concat(s.block, array(d)))"
    full = f"size(s.block) >= {BLOCK}"
    return (
        f"aggregate(array_sort(found), named_struct({', '.join(f'{chr(39)}end{p}{chr(39)}, 0' for p in priorities)},"
        f" 'block', cast(array() AS {_FOUND}), 'done', cast(array() AS array<{_FOUND}>)),"
        f" (s, d) -> named_struct({further}, 'block', if({full}, if({inside}, cast(array() AS {_FOUND}), array(d)), {block}),"
        f" 'done', if({full}, concat(s.done, array(s.block)), s.done)),"
        " s -> flatten(concat(s.done, array(s.block))))"
    )


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id, n_words, base, detections, score`` per row of ``docs`` (``doc_id, text``).

    ``base`` and ``detections`` are structs ``first, end, label, weight``: words counted from 0, ends exclusive.
    ``base`` holds every place of a base phrase; ``detections`` those of the rules that no other one covers.
    """
    told = all_rules(rules)
    keywords = sorted({k for r in told for k in r.keywords})
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    worded = docs.select("doc_id", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    seen = worded.withColumn("seen", F.expr(f"array_intersect(words, {_strings(keywords)})"))
    able = F.expr(f"filter({_rules_sql(told)}, r -> size(array_except(r.keywords, seen)) = 0)")
    gated = seen.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(F.size("seen") > 0, able).alias("able"), F.when(F.size("seen") > 0, F.expr("concat(' ', array_join(words, '  '), ' ')")).alias("line"),
    )
    matched = gated.select(
        "doc_id", "n_words",
        F.when(F.size("able") > 0, F.expr(f"flatten(transform(able, r -> {_places_sql()}))"))
        .otherwise(F.expr(f"cast(array() AS {_FOUND})")).alias("all_found"),
    )
    parted = matched.select(
        "doc_id", "n_words", F.array_sort(F.filter("all_found", lambda d: d["priority"] == BASE)).alias("base"),
        F.filter("all_found", lambda d: d["priority"] != BASE).alias("found"),
    )
    kept = parted.select("doc_id", "n_words", "base", F.expr(_kept_sql(sorted({r.priority for r in rules}))).alias("kept"))
    labels, weights = _strings([r.label for r in told]), "array(" + ", ".join(f"{r.weight}D" for r in told) + ")"

    def named(column: str) -> str:
        return f"transform({column}, d -> named_struct('first', d.first, 'end', -d.less, 'label', {labels}[d.rule], 'weight', {weights}[d.rule]))"

    spans = kept.select("doc_id", "n_words", F.expr(named("base")).alias("base"), F.expr(named("kept")).alias("detections"))
    strongest = F.expr(
        "transform(array_sort(array_distinct(transform(concat(base, detections), d -> d.label))),"
        " l -> array_max(transform(filter(concat(base, detections), d -> d.label = l), d -> d.weight)))"
    )
    return spans.withColumn("strongest", strongest).select(
        "doc_id", "n_words", "base", "detections", F.expr("1D - aggregate(strongest, 1D, (p, w) -> p * (1D - w))").alias("score")
    )


def labels_of(*columns: str):
    """The distinct labels of the detections in ``columns``, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat(*columns), lambda d: d["label"]))), ",")
