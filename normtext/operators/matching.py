"""Length matching: each target, shortest first, takes the nearest unused control.

Targets and controls stand in (length, id) order and are known by their place in it. Of the
controls of one length the used ones are always the first, and the nearest free ones of a
target are found among the lengths, so the rule is settled on two histograms: a sweep over the
target lengths takes from the nearest length that has free controls, with a union-find over
lengths to step over the empty ones. It holds one counter for each length that occurs, and
says which places take which; rows are then joined to their partners by place.

Where the nearest free lengths below and above are equally far, ids decide: as many targets
as there are take the first by id of both lengths together. How many of those are of the
shorter length depends only on the two lengths and on how many of both are used by then. The
sweep guesses it in proportion, all guessed ones are answered by one job that merges the two
lengths' ids around the place in question, and the sweep runs again until nothing is guessed.
An answer holds for ``WINDOW`` places on either side, so that a chain of such ties is settled
in a few sweeps, not in one for each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normtext.functions.ordered import with_ordinal
from normtext.session import stable

WINDOW = 256
CHUNK = 1 << 16  # places that one row of a range table stands for


@dataclass(frozen=True)
class Tie:
    """Two lengths, as indexes, and how many of both are used once the tie is settled."""

    below: int
    above: int
    used: int


@dataclass
class Merges:
    """How many of the first so many of two lengths, merged by id, are of the shorter one."""

    windows: dict[tuple[int, int], list[tuple[int, int, str]]] = field(default_factory=dict)

    def shorter(self, tie: Tie) -> int | None:
        for low, before, sides in self.windows.get((tie.below, tie.above), ()):
            if low <= tie.used <= low + len(sides):
                return before + sides.count("0", 0, tie.used - low)
        return None

    def learn(self, below: int, above: int, low: int, before: int, sides: str) -> None:
        self.windows.setdefault((below, above), []).append((low, before, sides))


@dataclass
class Settled:
    """Places that take places: runs of equal steps, ties between two lengths, and the ties that were guessed."""

    runs: list[tuple[int, int, int]] = field(default_factory=list)  # first target, first control, how many
    ties: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # first target; first control and how many, twice
    guessed: set[Tie] = field(default_factory=set)


def _root(parent: list[int], i: int) -> int:
    top = i
    while parent[top] != top:
        top = parent[top]
    while parent[i] != top:
        parent[i], i = top, parent[i]
    return top


def sweep(targets: dict[int, int], controls: dict[int, int], merges: Merges) -> Settled:
    """The rule over rows per length."""
    lengths = sorted(controls)
    count = [controls[x] for x in lengths]
    first, total = [], 0
    for n in count:
        first.append(total)
        total += n
    used = [0] * len(lengths)
    after, before = list(range(len(lengths) + 1)), list(range(len(lengths) + 1))  # next length with free ones; last one under it, plus one
    out, target = Settled(), 0

    def take(at: int, n: int) -> int:
        """The first of ``n`` controls of one length, now used."""
        start = first[at] + used[at]
        used[at] += n
        if used[at] == count[at]:
            after[at], before[at + 1] = at + 1, at
        return start

    for length in sorted(targets):
        left, at = targets[length], bisect_left(lengths, length)
        while left:
            up, down = _root(after, at), _root(before, at) - 1
            far_up = lengths[up] - length if up < len(lengths) else None
            far_down = length - lengths[down] if down >= 0 else None
            if far_up is not None and far_up == far_down:
                free_down, free_up = count[down] - used[down], count[up] - used[up]
                n = min(left, free_down + free_up)
                if n == free_down + free_up:
                    short = free_down
                else:
                    tie = Tie(down, up, used[down] + used[up] + n)
                    merged = merges.shorter(tie)
                    if merged is None:
                        out.guessed.add(tie)
                        merged = tie.used * count[down] // (count[down] + count[up])
                    short = min(max(merged - used[down], 0, n - free_up), free_down, n)
                out.ties.append((target, take(down, short), short, take(up, n - short), n - short))
            else:
                nearest = up if far_down is None or (far_up is not None and far_up < far_down) else down
                n = min(left, count[nearest] - used[nearest])
                out.runs.append((target, take(nearest, n), n))
            left -= n
            target += n
    return out


def _places(spark: SparkSession, ranges: Iterable[tuple[int, int, int]]) -> DataFrame:
    """``key, place, step`` for ranges of (key, first place, how many)."""
    chunks = [(key, first, s, min(n, s + CHUNK)) for key, first, n in ranges for s in range(0, n, CHUNK)]
    table = spark.createDataFrame(chunks, "key long, first long, start long, stop long")
    return table.select("key", "first", F.explode(F.expr("sequence(start, stop - 1)")).alias("step")).select(
        "key", (F.col("first") + F.col("step")).alias("place"), "step"
    )


def _merged(spark: SparkSession, numbered: DataFrame, ranges: list[tuple[int, int, int, int]]) -> DataFrame:
    """``key, second, place, rank`` of the controls in ranges of (key, whether of the second length, first place, how many).

    ``rank`` counts a key's controls by id from 0; equal ids stand in the order of their places.
    """
    sizes: dict[int, int] = {}
    for key, _, _, n in ranges:
        sizes[key] = sizes.get(key, 0) + n
    starts, total = [], 0
    for key in sorted(sizes):
        starts.append((key, total))
        total += sizes[key]
    rows = _places(spark, ((2 * key + second, first, n) for key, second, first, n in ranges))
    rows = rows.join(numbered, "place").select(F.shiftright("key", 1).alias("key"), (F.col("key") % 2).alias("second"), "place", "id")
    ranked = with_ordinal(rows, ["key", "id", "place"], "ordinal")
    return ranked.join(spark.createDataFrame(starts, "key long, start long"), "key").select(
        "key", "second", "place", (F.col("ordinal") - 1 - F.col("start")).alias("rank")
    )


def _learn(spark: SparkSession, numbered: DataFrame, controls: dict[int, int], ties: list[Tie], merges: Merges) -> None:
    """Answers the guessed ties: one row for each, with the sides of the places around it."""
    lengths = sorted(controls)
    first, total = [], 0
    for x in lengths:
        first.append(total)
        total += controls[x]
    ranges, windows = [], []
    for key, tie in enumerate(ties):
        n = [controls[lengths[tie.below]], controls[lengths[tie.above]]]
        low, high = max(0, tie.used - WINDOW), min(sum(n), tie.used + WINDOW)
        # What comes before the window whatever the ids, and what comes after it, needs no look.
        skipped = [max(0, low - n[1]), max(0, low - n[0])]
        for second, at in enumerate((tie.below, tie.above)):
            ranges.append((key, second, first[at] + skipped[second], max(0, min(n[second], high) - skipped[second])))
        windows.append((key, low, skipped[0], low - sum(skipped), high - sum(skipped)))
    bounds = spark.createDataFrame([(key, low, high) for key, _, _, low, high in windows], "key long, low long, high long")
    ranked = _merged(spark, numbered, ranges).join(bounds, "key")
    inside = F.when((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), F.struct("rank", "second"))
    answers = ranked.groupBy("key").agg(
        F.count_if((F.col("second") == 0) & (F.col("rank") < F.col("low"))).alias("before"),
        F.array_join(F.transform(F.array_sort(F.collect_list(inside)), lambda x: x["second"].cast("string")), "").alias("sides"),
    )
    found = {r["key"]: r for r in answers.collect()}  # at most one row for each target length, of 2 * WINDOW characters
    for key, low, skipped, _, _ in windows:
        merges.learn(ties[key].below, ties[key].above, low, skipped + found[key]["before"], found[key]["sides"])


def match_lengths(targets: DataFrame, controls: DataFrame) -> DataFrame:
    """Rows of (passage_id, chars) on both sides -> control, matched_to, length_difference.

    Of equally near controls the first by id is taken. Rows without a length take no part;
    equal ids are told apart by length, and rows equal in both are as good as each other.
    """
    spark = targets.sparkSession

    def numbered(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("passage_id").alias("id"), F.col("chars").cast("long").alias("chars")).where("chars IS NOT NULL")
        return with_ordinal(rows, ["chars", "id"], "place").withColumn("place", F.col("place") - 1)

    def histogram(df: DataFrame) -> dict[int, int]:  # one row for each length that occurs
        return {r["chars"]: r["n"] for r in df.groupBy("chars").agg(F.count("*").alias("n")).collect()}

    wanted, pool = numbered(targets), numbered(controls)
    takers, free = histogram(wanted), histogram(pool)
    if sum(free.values()) < sum(takers.values()):
        raise ValueError(f"not enough controls: {sum(free.values())} for {sum(takers.values())} targets")
    merges = Merges()
    while (settled := sweep(takers, free, merges)).guessed:
        _learn(spark, pool, free, sorted(settled.guessed, key=lambda t: (t.below, t.above, t.used)), merges)

    plain = _places(spark, settled.runs).select((F.col("key") + F.col("step")).alias("target"), "place")
    ties = [(at, second, *part) for at, *parts in settled.ties for second, part in enumerate((parts[:2], parts[2:])) if part[1]]
    if ties:  # a tie's key is its first target, and its controls go to the targets from there on by rank
        plain = plain.union(_merged(spark, pool, ties).select((F.col("key") + F.col("rank")).alias("target"), "place"))
    pairs = stable(plain)
    taken = pairs.join(pool.select("place", F.col("id").alias("passage_id"), "chars"), "place")
    return taken.join(wanted.select(F.col("place").alias("target"), F.col("id").alias("matched_to"), F.col("chars").alias("wanted")), "target").select(
        "passage_id", "matched_to", "chars", (F.col("chars") - F.col("wanted")).alias("length_difference")
    )
