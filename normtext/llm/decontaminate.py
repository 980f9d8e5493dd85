"""Benchmark decontamination by template windows and slot consistency, in DataFrame functions only.

Numbers, units after numbers, and names (capitalised words inside a sentence) become typed
placeholders; the rest is lower-cased words. A window is ``WIDTH`` template tokens in a
row. Documents' windows meet the benchmark's windows in a hash join; a document that
holds at least ``CANDIDATE`` of an item's windows is a suspect. Windows with names kept as
plain words are looked up beside the template ones, so a copy in other letter case is
found too, and windows with every capitalised word as a name, since a name at the start of
a sentence, after a quote or with inner capitals can't be told from other words. A suspect's tokens are
then compared one by one along its shifts; a capitalised word agrees with any other.
At least ``COVERAGE`` of the item's windows must agree. An exchanged ordinary word costs
the up to ``WIDTH`` windows that hold it.

Every alignment of a suspect is then judged by itself, with its own coverage: equal values
of the item must stand for equal values in the document (Tom, Tom -> Ann, Ann; 3, 4, 3 ->
8, 9, 8). Where more than a fifth of the item's values break that, the passage only shares
the template. One alignment that is covered and holds is enough, whatever other passages
or shifts of the item against itself say; if some value differs in all that hold, the
question was re-parameterised.

The windows of the corpus are a narrow map over the texts; what is shuffled are hits. The
benchmark's windows are broadcast only after their rows were counted, beyond
``storage.BROADCAST_ROWS`` the join shuffles.

Items without a window of at least ``LITERALS`` plain words (arithmetic, lists of numbers or
names, items of fewer than ``WIDTH`` tokens) are looked up exactly, by windows of words,
numbers and signs as they are, as long as the item where it is shorter than ``WIDTH``. Exchanged
values are not found in these.

Defined cases: null texts and items without a word, number or sign match nothing; an item of
one or two words matches every document that holds them in a row; other item windows with
fewer than ``LITERALS`` plain words are no evidence and don't count; in scripts without
spaces each letter is a token; items with the same text all match; repeated documents each
match; texts that share an ``item_id`` are judged one by one and give one row. Empty tables
give an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normtext.llm.storage import UID, small, with_uid, without, written

WIDTH = 5
COVERAGE = 0.8
CANDIDATE = 0.4  # the share of an item's windows that must be hit before its tokens are compared
LITERALS = 3
BROKEN = 0.2  # the share of an item's values that may break
ITEM = "_item"
ANYWHERE = 2**31 - 1

# Units of measure that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s ms min h hr hrs day days week weeks month months year years"
    " km/h mph m/s mb gb tb kb hz khz mhz ghz w kw mw kwh v a j kj cal kcal pa kpa bar n k c f"
    " dollars dollar euros euro cents pounds percent meters metres kilometers miles feet inches hours minutes seconds grams"
    " kilograms liters litres"
).split()

NUMBER_MARK, UNIT_MARK, NAME_MARK, CAPITAL_MARK, AFTER_MARKS = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_UNIT = r"(?i)(?<=\d)\s?(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r"|[%€$£°])(?![\p{L}\p{N}])"
# Scripts without spaces between words: each letter is a token.
# All of them lie above U+0E00, which is asked first: telling a script is slow.
_UNSPACED = (
    r"[\x{E00}-\x{10FFFF}&&[" + "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")) + r"]]\p{M}*"
)
_NUMBER = r"\d+(?:[.,:/]\d+)*"
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;)] \p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
_EXACT = rf"{_NUMBER}|{_UNSPACED}|(?:(?!{_UNSPACED})[\p{{L}}\p{{M}}])+|[\p{{N}}\p{{Sm}}]|[*/^-](?=\s?[\d(])"
_CAPITAL = "(?=\\p{Lu})(?<![\\p{L}\\p{M}\\p{N}\ue001\ue002])\\p{Lu}[\\p{L}\\p{M}]*"
_SEPARATOR = "(?:[^\\p{L}\\p{M}\\p{N}\ue000-\ue003%€$£°/.,:-]|[/.,:-](?!\\d)|(?<!\ue001)[%€$£°])+"


def cased_tokens(text: Column) -> Column:
    """Tokens of a text in lower case; numbers, units, names and other capitalised words begin with their mark."""
    marked = F.regexp_replace(text, _UNIT, f" {UNIT_MARK}$1 ")
    marked = F.regexp_replace(marked, _NAME, f" {NAME_MARK}$0 ")
    marked = F.regexp_replace(marked, _CAPITAL, f" {CAPITAL_MARK}$0")
    marked = F.regexp_replace(marked, _NUMBER, f" {NUMBER_MARK}$0 ")
    marked = F.regexp_replace(marked, _UNSPACED, " $0 ")
    return F.array_remove(F.split(F.lower(marked), _SEPARATOR), "")


def exact_tokens(text: Column) -> Column:
    """Words, numbers and signs of arithmetic of a text in lower case, as they are."""
    return F.regexp_extract_all(F.lower(text), F.lit(_EXACT), F.lit(0))


def _without_capital(token: Column) -> Column:
    return F.ltrim(token, F.lit(CAPITAL_MARK))


def _without_capitals(tokens: Column) -> Column:
    return F.transform(tokens, _without_capital)


def valued_tokens(text: Column) -> Column:
    """Tokens of a text in lower case; numbers, units and names begin with their mark."""
    return _without_capitals(cased_tokens(text))


def _is_slot(token: Column) -> Column:
    return (token >= NUMBER_MARK) & (token < CAPITAL_MARK)


def _marked(token: Column) -> Column:
    return (token >= NUMBER_MARK) & (token < AFTER_MARKS)


def _plain(token: Column) -> Column:
    return F.ltrim(token, F.lit(NUMBER_MARK + UNIT_MARK + NAME_MARK + CAPITAL_MARK))


def _class(token: Column) -> Column:
    """The mark of a slot or capitalised word, names and capitals alike; null for other words."""
    return F.when(_marked(token), F.when(token >= NAME_MARK, F.lit(NAME_MARK)).otherwise(F.left(token, F.lit(1))))


def _template_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(F.when(_is_slot(x), F.left(x, F.lit(1))).otherwise(_without_capital(x))))


def _plain_name_hashes(tokens: Column) -> Column:
    return F.transform(
        tokens,
        lambda x: F.xxhash64(
            F.when(_marked(x), F.when(x >= NAME_MARK, F.substring(x, 2, 1 << 20)).otherwise(F.left(x, F.lit(1)))).otherwise(x)
        ),
    )


def _capital_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(F.coalesce(_class(x), x)))


def _windows(hashes: Column) -> Column:
    """The hash of every window; none if there are too few tokens."""
    places = F.sequence(F.lit(0), F.size(hashes) - WIDTH)
    found = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]))
    return F.when(F.size(hashes) >= WIDTH, found).otherwise(F.array().cast("array<bigint>"))


def _windows_at(hashes: Column, tokens: Column, mark: str) -> Column:
    """``place, hash`` of the windows that hold a token with ``mark``: in all others the variant is the template."""
    marked = F.filter(F.transform(tokens, lambda x, i: F.when(F.startswith(x, F.lit(mark)), i)), lambda i: i.isNotNull())
    last = F.size(tokens) - WIDTH
    places = F.array_distinct(F.flatten(F.transform(marked, lambda i: F.sequence(F.greatest(i - (WIDTH - 1), F.lit(0)), F.least(i, last)))))
    found = F.transform(
        places, lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]).alias("hash"))
    )
    return F.when((last >= 0) & hashes.isNotNull(), found).otherwise(F.array().cast("array<struct<place:int,hash:bigint>>"))


def window_rows(texts: DataFrame, key: str) -> DataFrame:
    """``key, place, hash`` of all template windows, and where they differ of those with plain names and with all capitalised words as names."""
    tokens = texts.select(key, cased_tokens(F.col("text")).alias("tokens"))
    hashes = tokens.select(
        key, "tokens",
        _template_hashes(F.col("tokens")).alias("template"),
        F.when(F.exists("tokens", lambda x: F.startswith(x, F.lit(NAME_MARK))), _plain_name_hashes(F.col("tokens"))).alias("plain"),
        F.when(F.exists("tokens", lambda x: F.startswith(x, F.lit(CAPITAL_MARK))), _capital_hashes(F.col("tokens"))).alias("capital"),
    )
    template = F.transform(_windows(F.col("template")), lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
    windows = F.concat(
        template, _windows_at(F.col("plain"), F.col("tokens"), NAME_MARK), _windows_at(F.col("capital"), F.col("tokens"), CAPITAL_MARK)
    )
    return hashes.select(key, F.explode(windows).alias("w")).select(key, "w.place", "w.hash")


def _literals(tokens: Column, is_slot) -> Column:
    """The number of plain words in every window."""
    places = F.sequence(F.lit(0), F.size(tokens) - WIDTH)
    found = F.transform(places, lambda i: F.size(F.filter(F.slice(tokens, i + 1, WIDTH), lambda x: ~is_slot(x))))
    return F.when(F.size(tokens) >= WIDTH, found).otherwise(F.array().cast("array<int>"))


def item_places(items: DataFrame) -> DataFrame:
    """``_item, item_place``: the windows of the benchmark with enough plain words."""
    tokens = items.select(ITEM, valued_tokens(F.col("text")).alias("tokens"))
    return (
        tokens.select(ITEM, F.posexplode(_literals(F.col("tokens"), _is_slot)).alias("item_place", "literals"))
        .where(F.col("literals") >= LITERALS).select(ITEM, "item_place")
    )


def item_windows(items: DataFrame) -> DataFrame:
    """``_item, item_place, hash`` of the windows of ``item_places``.

    With capitalised words as names a window is looked up only if it still has enough plain words.
    """
    tokens = items.select(ITEM, cased_tokens(F.col("text")).alias("tokens"))
    capitals = _capital_hashes(F.col("tokens"))
    weak = (
        tokens.select(ITEM, F.posexplode(F.arrays_zip(
            _windows(capitals).alias("hash"), _literals(F.col("tokens"), _marked).alias("literals")
        )).alias("item_place", "w"))
        .where(F.col("w.literals") < LITERALS)
    )
    # A window without capitals has the same hash as its template and is then not weak.
    rows = window_rows(items, ITEM).withColumnRenamed("place", "item_place").join(item_places(items), [ITEM, "item_place"], "left_semi")
    return rows.join(weak.select(ITEM, "item_place", F.col("w.hash").alias("hash")), [ITEM, "item_place", "hash"], "left_anti").distinct()


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, coverage, n_values, n_changed, kind`` per contaminated pair.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``. ``kind`` is ``copy`` or
    ``reparameterised``. ``docs`` is read several times and must give its rows alike each time.
    """
    return contaminated_rows(docs, items, coverage).drop(UID)


def drop_contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with all its columns, less the documents that hold an item of the benchmark."""
    return without(docs, written(contaminated_rows(docs, items, coverage).select(UID).distinct()))


def contaminated_rows(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``contaminated`` with the row number of each row of ``docs``."""
    texts = written(items.select("item_id", "text").distinct().withColumn(ITEM, F.monotonically_increasing_id()))
    wanted = written(item_windows(texts))
    evidence = written(item_places(texts))
    rows = with_uid(docs.select("doc_id", "text"))
    sizes = evidence.groupBy(ITEM).agg(F.count("*").alias("item_windows"))
    probes = window_rows(rows.select(UID, "text"), UID)
    hits = written(probes.join(small(wanted, wanted.count()), "hash").select(UID, ITEM, "item_place", "place"))
    suspects = written(
        hits.groupBy(UID, ITEM).agg(F.size(F.collect_set("item_place")).alias("n_windows"))
        .join(sizes, ITEM)
        .where(F.col("n_windows") / F.col("item_windows") >= F.least(F.lit(coverage), F.lit(CANDIDATE)))
        .select(UID, ITEM, "item_windows")
    )
    of_doc = written(_document_tokens(rows, suspects))
    agreed = written(_agreeing_windows(hits.join(suspects, [UID, ITEM], "left_semi"), of_doc, texts, evidence))
    judged = (
        _judged(of_doc, agreed, suspects, texts)
        .where((F.col("coverage") >= coverage) & (F.col("n_broken") <= BROKEN * F.col("n_values")))
        .join(texts.select(ITEM, "item_id"), ITEM)
    )
    exact = _exact_pairs(rows, texts, evidence, coverage)
    if exact is not None:
        judged = judged.select(exact.columns).unionByName(exact)
    # The alignment with the fewest changes speaks for the pair, a more complete one first among equals.
    best = written(
        judged.groupBy(UID, "item_id")
        .agg(F.min(F.struct("n_changed", (-F.col("coverage")).alias("less"), "n_broken", "n_windows", "item_windows", "n_values")).alias("best"))
    )
    ids = rows.select(UID, "doc_id")
    return ids.join(small(best, best.count()), UID).select(
        UID, "doc_id", "item_id", "best.n_windows", "best.item_windows", (-F.col("best.less")).alias("coverage"),
        "best.n_values", "best.n_changed",
        F.when(F.col("best.n_changed") > 0, "reparameterised").otherwise("copy").alias("kind"),
    )


def _exact_windows(texts: DataFrame, key: str, widths: list[int]) -> DataFrame:
    """``key, width, place, hash`` of the windows of exact tokens of every width."""
    hashes = texts.select(key, F.transform(exact_tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("hashes"))

    def windows(width: int) -> Column:
        found = F.transform(
            F.sequence(F.lit(0), F.size("hashes") - width), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(width)])
        )
        return F.struct(
            F.lit(width).alias("width"), F.when(F.size("hashes") >= width, found).otherwise(F.array().cast("array<bigint>")).alias("hashes")
        )

    each = hashes.select(key, F.explode(F.array(*[windows(w) for w in widths])).alias("w"))
    return each.select(key, "w.width", F.posexplode("w.hashes").alias("place", "hash"))


def _exact_pairs(rows: DataFrame, texts: DataFrame, evidence: DataFrame, coverage: float) -> DataFrame | None:
    """Pairs with an item that has no window in ``evidence``, by windows with all values kept; None without such items."""
    bare = texts.join(evidence.select(ITEM), ITEM, "left_anti").withColumn(
        "width", F.least(F.size(exact_tokens(F.col("text"))), F.lit(WIDTH))
    ).where("width > 0")
    bare = written(bare.withColumn(
        "n_values", F.size(F.array_distinct(F.filter(valued_tokens(F.col("text")), _is_slot))).cast("long")
    ))
    widths = sorted(r["width"] for r in bare.select("width").distinct().collect())  # at most WIDTH numbers
    if not widths:
        return None
    wanted = written(
        _exact_windows(bare, ITEM, widths).join(bare.select(ITEM, "width"), [ITEM, "width"]).withColumnRenamed("place", "item_place")
    )
    sizes = wanted.groupBy(ITEM).agg(F.count("*").alias("item_windows"))
    probes = _exact_windows(rows.select(UID, "text"), UID, widths)
    hits = probes.join(small(wanted, wanted.count()), ["width", "hash"]).select(UID, ITEM, "item_place").distinct()
    found = hits.groupBy(UID, ITEM).agg(F.count("*").alias("n_windows")).join(sizes, ITEM)
    return (
        found.withColumn("coverage", F.col("n_windows") / F.col("item_windows")).where(F.col("coverage") >= coverage)
        .join(bare.select(ITEM, "item_id", "n_values"), ITEM)
        .select(UID, "item_id", "n_windows", "item_windows", "coverage", "n_values",
                F.lit(0).cast("long").alias("n_broken"), F.lit(0).cast("long").alias("n_changed"))
    )


def _document_tokens(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """``_uid, j, token`` of the documents of suspects."""
    wanted = suspects.select(UID).distinct()
    return (
        rows.select(UID, "text").join(small(wanted, suspects.count()), UID)
        .select(UID, F.posexplode(cased_tokens(F.col("text"))).alias("j", "token"))
    )


def _agreeing_windows(hits: DataFrame, of_doc: DataFrame, texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``_uid, _item, shift, item_place``: windows whose tokens agree one by one along a shift.

    Equal words agree, and so do two numbers, two units and two capitalised words.
    """
    shifts = hits.select(UID, ITEM, (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    of_item = texts.select(ITEM, F.posexplode(cased_tokens(F.col("text"))).alias("i", "item_token"))
    same = (_plain(F.col("token")) == _plain(F.col("item_token"))) | (_class(F.col("token")) == _class(F.col("item_token")))
    agreeing = (
        shifts.join(of_item, ITEM).withColumn("j", F.col("i") + F.col("shift")).join(of_doc, [UID, "j"]).where(same)
        .select(UID, ITEM, "shift", F.explode(F.sequence(F.col("i") - (WIDTH - 1), F.col("i"))).alias("item_place"))
    )
    full = agreeing.groupBy(UID, ITEM, "shift", "item_place").agg(F.count("*").alias("n")).where(F.col("n") == WIDTH).drop("n")
    return full.join(evidence, [ITEM, "item_place"], "left_semi")


def _alignments(agreed: DataFrame, suspects: DataFrame, texts: DataFrame) -> DataFrame:
    """``_uid, _item, base, reach, item_place, shift``: every alignment of a pair, one row per window.

    Each shift is an alignment by itself (``reach`` 0). Insertions move the shift inside a
    passage, so each is also completed: a window that it lacks is taken from the nearest
    shift, once within the item's length and once from anywhere.
    """
    grid = agreed.select(UID, ITEM, F.col("shift").alias("base")).distinct().join(
        agreed.select(UID, ITEM, "item_place").distinct(), [UID, ITEM]
    )
    at = grid.join(
        agreed.select(UID, ITEM, F.col("shift").alias("base"), "item_place", "shift"), [UID, ITEM, "base", "item_place"], "left"
    )
    along = Window.partitionBy(UID, ITEM, "item_place").orderBy("base")
    below = F.last("shift", True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("shift", True).over(along.rowsBetween(0, Window.unboundedFollowing))
    nearest = at.withColumn("below", below).withColumn("above", above).withColumn(
        "shift",
        F.when(F.col("above").isNull() | (F.col("base") - F.col("below") <= F.col("above") - F.col("base")), F.col("below"))
        .otherwise(F.col("above")),
    )
    lengths = texts.select(ITEM, F.size(valued_tokens(F.col("text"))).alias("length"))
    return (
        nearest.join(lengths, ITEM)
        .select(UID, ITEM, "base", F.explode(F.array(F.lit(0), "length", F.lit(ANYWHERE))).alias("reach"), "item_place", "shift")
        .where(F.abs(F.col("shift") - F.col("base")) <= F.col("reach"))
    )


def _judged(of_doc: DataFrame, agreed: DataFrame, suspects: DataFrame, texts: DataFrame) -> DataFrame:
    """``_uid, _item, n_windows, item_windows, coverage, n_values, n_broken, n_changed`` of every alignment."""
    windows = written(_alignments(agreed, suspects, texts))
    key = [UID, ITEM, "base", "reach"]
    covered = windows.groupBy(*key).agg(F.count("*").alias("n_windows"))
    # A token in windows of two shifts counts with the one nearer to the alignment's own.
    away = F.abs(F.col("shift") - F.col("base"))
    places = (
        windows.select(*key, "shift", away.alias("away"), "item_place", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("k"))
        .groupBy(*key, (F.col("item_place") + F.col("k")).alias("i"))
        .agg(F.min(F.struct("away", "shift")).alias("nearest"))
        .select(*key, "i", (F.col("i") + F.col("nearest.shift")).alias("j"))
    )
    of_item = (
        texts.select(ITEM, F.posexplode(cased_tokens(F.col("text"))).alias("i", "item_token"))
        .where(_marked(F.col("item_token")))
        .select(ITEM, "i", _class(F.col("item_token")).alias("class"), _plain(F.col("item_token")).alias("item_value"),
                _is_slot(F.col("item_token")).alias("sure"))
    )
    values = places.join(of_item, [ITEM, "i"]).join(of_doc.select(UID, "j", _plain(F.col("token")).alias("value")), [UID, "j"])
    # A capitalised word that is no name inside a sentence, and never differs, is an ordinary first word.
    per_value = values.groupBy(*key, "class", "item_value").agg(
        (F.min("value") != F.max("value")).alias("broken"),
        F.bool_or(F.col("value") != F.col("item_value")).alias("changed"),
        F.bool_or("sure").alias("sure"),
    ).where("sure OR changed")
    slots = per_value.groupBy(*key).agg(
        F.count("*").alias("n_values"), F.count_if("broken").alias("n_broken"), F.count_if("changed").alias("n_changed")
    )
    return (
        covered.join(slots, key, "left").fillna(0, ["n_values", "n_broken", "n_changed"])
        .join(suspects, [UID, ITEM])
        .withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    )
