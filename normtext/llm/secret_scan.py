"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Base spans come from three patterns over the whole text. The method adds spans of kind
``random`` inside runs of key characters (at least ``LEAST_RUN``): transitions likelier under
a model of random strings than under one of ordinary identifiers, by more than the prior
odds against a secret. A run that mixes letters with digits or changes from lower to upper
case, and scores so as a whole, is one span; of any other every stretch is taken that scores so,
up to where the sum has fallen by as much again, so a path or name before a secret doesn't outvote it
and none hides the next one. Both models are counts of character pairs backed by their single characters, learned from
samples: the values that the base patterns label as secrets, and the letter runs of the
same documents outside them. About ``FIT_ROWS`` rows are read for that. Added spans that touch a
base span are dropped. DataFrame functions only.

Offsets are code points, ends exclusive. A match of a base pattern that is too short is
dropped but its characters stay used, so matches are found first and judged afterwards.

Defined cases: a null or empty text has no spans; without samples of a kind its model is
uniform; equal starts stand in the order assign, access, hex, random; repeated rows each
get their result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normtext.functions.text import matches_sql, sql_literal

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 6
# Runs of one class of characters: the shortest length can stand in the pattern, since a
# longest run that is too short holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_RUN = 16
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN
MIXED = r"[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]|[a-z][A-Z]"
WORD = r"[A-Za-z][A-Za-z_]{3,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
FIT_ROWS = 20_000
PRIOR_ODDS = 1e-4
BACK_OFF = 200  # counts that the single characters are worth: a few hundred samples leave most pairs unseen

_SPAN = "named_struct('at', x.start, 'kind', {kind}, 'till', x.end, 'span', x.span)"


def _spans(kind: int, pattern: str, test: str | None = None) -> str:
    found = matches_sql("text", pattern)
    kept = found if test is None else f"filter({found}, x -> {test})"
    return f"transform({kept}, x -> {_SPAN.format(kind=kind)})"


def _base_sql() -> str:
    long_enough = f"length(regexp_extract(x.span, {sql_literal('(?s)' + ASSIGN)}, 1)) >= {LEAST_VALUE}"
    return f"concat({_spans(0, ASSIGN, long_enough)}, {_spans(1, ACCESS)}, {_spans(2, HEX)})"


def with_base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text, base``: the base spans as structs ``at, kind, till, span``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("base", F.expr(_base_sql()))


def _transitions(samples: DataFrame) -> DataFrame:
    """``kind, pair``: the different pairs of neighbouring characters of each ``sample``.

    A pair counts once for a sample, so one long monotonous value doesn't make the model.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring(F.col("sample"), i, F.lit(2)))
    return samples.where(F.length("sample") >= 2).select("kind", F.explode(F.array_distinct(pairs)).alias("pair"))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> list[float]:
    """The log-likelihood ratio (random over ordinary) of every character pair, row by row of the alphabet."""
    share = min(1.0, rows / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    based = with_base_spans(sample)
    secrets = based.select(F.lit("random").alias("kind"), F.explode("base").alias("s")).select(
        "kind", F.when(F.col("s.kind") == 0, F.regexp_extract("s.span", ASSIGN, 1)).otherwise(F.col("s.span")).alias("sample")
    )
    words = based.select(
        F.lit("ordinary").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("sample"), "base"
    ).where(~F.exists("base", lambda s: F.contains(s["span"], F.col("sample")))).select("kind", "sample")
    counted = _transitions(secrets.union(words)).groupBy("kind", "pair").agg(F.count("*").alias("n"))
    known = counted.where(F.rlike("pair", F.lit(r"^[A-Za-z0-9+/_=.-]{2}$")))
    counts = {(r["kind"], r["pair"]): r["n"] for r in known.collect()}  # at most two rows for each pair of the alphabet

    singles = {(kind, b): sum(counts.get((kind, a + b), 0) for a in ALPHABET) for kind in ("random", "ordinary") for b in ALPHABET}
    rows_of = {(kind, a): sum(counts.get((kind, a + b), 0) for b in ALPHABET) for kind in ("random", "ordinary") for a in ALPHABET}
    totals = {kind: sum(singles[kind, b] for b in ALPHABET) for kind in ("random", "ordinary")}

    def log_share(kind: str, a: str, b: str) -> float:
        everywhere = (singles[kind, b] + 0.5) / (totals[kind] + 0.5 * len(ALPHABET))
        return math.log((counts.get((kind, a + b), 0) + BACK_OFF * everywhere) / (rows_of[kind, a] + BACK_OFF))

    return [log_share("random", a, b) - log_share("ordinary", a, b) for a in ALPHABET for b in ALPHABET]


def _stretches_sql(span: str, ratios: list[float], least: str) -> str:
    """``sum`` of a run's log-likelihood ratios, and its scoring stretches: ``found``, their first and last characters.

    A stretch ends at its best sum once the sum has fallen below it by ``least``, or to nothing; what follows is
    judged by itself. So stretches are parted only by transitions that speak against a secret as strongly as a secret
    must speak for itself.
    """
    table = "array(" + ", ".join(f"{r:.6f}D" for r in ratios) + ")"
    letters = sql_literal(ALPHABET)
    place = "(instr({a}, substr({s}, i, 1)) - 1) * {n} + instr({a}, substr({s}, i + 1, 1)) - 1".format(a=letters, s=span, n=len(ALPHABET))
    each = f"transform(sequence(1, length({span}) - 1), i -> coalesce(get({table}, {place}), 0D))"
    nothing = "cast(array() AS array<struct<first:int,last:int>>)"
    start = f"named_struct('i', 1, 'sum', 0D, 'run', 0D, 'from', 1, 'best', 0D, 'first', 1, 'last', 1, 'found', {nothing})"
    run, stretch = "v + greatest(s.run, 0D)", "array(named_struct('first', s.first, 'last', s.last))"
    begun = "if(s.run > 0D, s.from, s.i)"
    over = f"({run} <= 0D OR s.best - ({run}) > {least})"  # the stretch at hand ends here
    better = f"{run} > s.best"
    step = (
        f"if({over}, named_struct('i', s.i + 1, 'sum', s.sum + v, 'run', 0D, 'from', s.i + 1, 'best', 0D, 'first', s.i + 1, 'last', s.i + 1,"
        f" 'found', if(s.best > {least}, concat(s.found, {stretch}), s.found)),"
        f" named_struct('i', s.i + 1, 'sum', s.sum + v, 'run', {run}, 'from', {begun}, 'best', greatest({run}, s.best),"
        f" 'first', if({better}, {begun}, s.first), 'last', if({better}, s.i + 1, s.last), 'found', s.found))"
    )
    end = f"named_struct('sum', s.sum, 'found', if(s.best > {least}, concat(s.found, {stretch}), s.found))"
    return f"aggregate({each}, {start}, (s, v) -> {step}, s -> {end})"


def _candidates_sql(ratios: list[float], prior_odds: float) -> str:
    """Runs that score as a whole, and the scoring stretches of the others."""
    least = f"{-math.log(prior_odds)}D"
    scored = f"transform({matches_sql('text', RUN)}, x -> named_struct('x', x, 'w', {_stretches_sql('x.span', ratios, least)}))"
    whole = f"rlike(c.x.span, {sql_literal(MIXED)}) AND c.w.sum > {least}"
    stretches = (
        "transform(c.w.found, f -> named_struct('at', c.x.start + f.first - 1, 'kind', 3, 'till', c.x.start + f.last,"
        " 'span', substr(c.x.span, f.first, f.last - f.first + 1)))"
    )
    run = "array(named_struct('at', c.x.start, 'kind', 3, 'till', c.x.end, 'span', c.x.span))"
    return f"flatten(transform({scored}, c -> if({whole}, {run}, {stretches})))"


def find_secrets(docs: DataFrame, ratios: list[float], prior_odds: float = PRIOR_ODDS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` per row of ``docs`` (``doc_id, text``)."""
    based = with_base_spans(docs).withColumn("candidates", F.expr(_candidates_sql(ratios, prior_odds)))
    added = F.filter(
        "candidates", lambda c: ~F.exists("base", lambda b: (b["at"] < c["till"]) & (c["at"] < b["till"]))
    )
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        told = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"], s["till"]))
        return F.array_join(told, ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    found = based.select("doc_id", "base", added.alias("added"))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )


def scan(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Learns both models from ``docs`` and finds the spans of every row."""
    return find_secrets(docs, fit(docs.where("text IS NOT NULL"), fit_rows))
