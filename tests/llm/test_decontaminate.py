import random

import regex
from helpers import ODD_TEXTS, clashing, documents, stored, words
from pyspark.sql import functions as F

from normtext.llm.decontaminate import UNITS, contaminated, drop_contaminated, valued_tokens

QUESTION = "Every morning Tom buys 3 apples and Tom walks 12 km before the market opens, so how many fruits does the boy carry home after 3 days"
LITERAL = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed many jugs of old liquid"
ITEMS = [(1, QUESTION), (2, LITERAL), (3, "too few words"), (4, None), (5, ""), (2, LITERAL)]


def in_noise(text, seed, first=30, last=40):
    rng = random.Random(seed)
    return f"{words(rng, first)} {text} {words(rng, last)}"


CASES = {
    10: (in_noise(QUESTION, 1), {(1, "copy")}),
    11: (in_noise(QUESTION.replace("Tom", "Ann").replace("3", "8").replace("12", "40"), 2), {(1, "reparameterised")}),
    12: (in_noise(QUESTION.replace("buys 3", "buys 5").replace("Tom walks 12 km", "Bob walks 9 miles"), 3), set()),  # inconsistent
    13: (in_noise(LITERAL.upper() + "!", 4), {(2, "copy")}),
    14: (in_noise(LITERAL.replace(" ", "\n") + ", " + QUESTION, 5), {(1, "copy"), (2, "copy")}),
    15: (in_noise(" ".join(LITERAL.split()[:9]), 6), set()),  # less than half of the windows
    16: (in_noise(LITERAL.replace("seven", "nine"), 7), set()),  # 5 of 15 windows are lost
    17: (in_noise(LITERAL, 8) + " " + words(random.Random(9), 20_000), {(2, "copy")}),
    18: (in_noise(QUESTION.lower(), 10), {(1, "copy")}),
}


def rows():
    return [*enumerate(ODD_TEXTS), *((i, t) for i, (t, _) in CASES.items()), (10, CASES[10][0])]


def test_planted_passages(spark, tmp_path):
    docs = stored(clashing(documents(spark, rows())), tmp_path)
    items = stored(spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1)), tmp_path, "items")
    found = contaminated(docs, items).collect()
    for doc_id, (_, want) in CASES.items():
        assert {(r.item_id, r.kind) for r in found if r.doc_id == doc_id} == want, doc_id
    assert {r.doc_id for r in found} <= set(CASES)
    assert sum(r.doc_id == 10 for r in found) == 2  # the repeated row is found too
    changed = next(r for r in found if r.doc_id == 11)
    assert changed.n_changed == 3 and changed.coverage > 0.9
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert left.count() == len(rows()) - sum(bool(CASES[i][1]) for i, _ in rows() if i in CASES)


def test_empty_tables(spark, tmp_path):
    docs = stored(documents(spark, [LITERAL, None]), tmp_path)
    none = stored(spark.createDataFrame([], "item_id long, text string"), tmp_path, "none")
    some = stored(spark.createDataFrame(ITEMS, "item_id long, text string"), tmp_path, "some")
    assert contaminated(docs, none).collect() == []
    assert contaminated(stored(documents(spark, []), tmp_path, "empty"), some).collect() == []


def judged(spark, tmp_path, items, texts):
    """``item_id, kind`` found in each text."""
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path)
    bench = stored(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), tmp_path, "items")
    found = contaminated(docs, bench).collect()
    return [{(r.item_id, r.kind) for r in found if r.doc_id == i} for i in range(len(texts))]


def test_every_alignment_by_itself(spark, tmp_path):
    boxes = "box 3 holds 5 red balls and box 4 holds 3 red balls and box 5 holds 3 red balls so how many red balls are there in all"
    broken = QUESTION.replace("buys 3", "buys 5").replace("Tom walks", "Bob walks")
    dealt = QUESTION.replace("Tom", "Ann").replace("3", "8")
    texts = [
        in_noise(boxes, 20),
        in_noise(QUESTION, 21) + " " + in_noise(broken, 22),
        in_noise(broken, 23) + " " + in_noise(dealt, 24),
        in_noise(broken, 25),
    ]
    long_item = QUESTION + " and what would they have had in all if there had been a second boy who had brought as many again from that other market"
    assert judged(spark, tmp_path, [boxes, QUESTION], texts) == [{(0, "copy")}, {(1, "copy")}, {(1, "reparameterised")}, set()]
    texts = [in_noise(long_item.replace("market opens", "very old market opens").replace("3", "8"), 28) + " " + in_noise(long_item.replace("buys 3", "buys 5").replace("Tom walks", "Bob walks"), 29)]
    assert judged(spark, tmp_path / "long", [long_item], texts) == [{(0, "reparameterised")}]


SHOP = "Tom has 3 apples. Tom buys 5 more apples at the shop. Tom then gives 2 apples to Ann. How many apples does Tom have left now"
FARM = 'Tom has 3 cows. Sam has 4 cows.\nMcCoy has 5 cows. "Ann" has 6 cows (Eve only 2). How many cows do they have'


def test_names_in_every_place(spark, tmp_path):
    farm = FARM
    for old, new in (("Tom", "Bob"), ("Sam", "Lea"), ("McCoy", "EVE-O"), ("Ann", "Ida"), ("Eve", "Max")):
        farm = farm.replace(old, new.replace("EVE-O", "DeWitt"))
    texts = [
        in_noise(SHOP.replace("Tom", "Bob"), 30),
        in_noise(SHOP.replace("Tom", "Bob").replace("Bob buys", "Lea buys").replace("Bob then", "Max then"), 31),  # one value of five breaks: no more than a fifth
        in_noise(farm, 32),
        in_noise(FARM.upper(), 33),
        in_noise(SHOP.replace("apples", "boats"), 34),  # other words
        in_noise(SHOP, 35),
    ]
    want = [{(0, "reparameterised")}, {(0, "reparameterised")}, {(1, "reparameterised")}, {(1, "copy")}, set(), {(0, "copy")}]
    assert judged(spark, tmp_path, [SHOP, FARM], texts) == want


def test_items_of_few_words(spark, tmp_path):
    items = ["12 + 30 = 42", "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9", "Who wrote it?", "Ann Bob Eve Ida Lea Max Tom", "小明每天早上买三个苹果然后走到市场去", "???", "", None, QUESTION, "ﬁrst ﬂags ﬁnd ﬂat ﬁelds ﬂow"]
    texts = [
        in_noise("12 + 30 = 42", 40), in_noise("12 - 30 = 42", 41), in_noise("12 + 30 = 43", 42),
        in_noise(items[1], 43), in_noise(items[1][::-1], 44),
        in_noise("who wrote it", 45), "Who wrote it", in_noise("who wrote this", 46),
        in_noise("Ann, Bob, Eve, Ida, Lea, Max, Tom", 47), in_noise("Ann Bob Eve Max Ida Tom Lea", 48),
        "我们知道小明每天早上买三个苹果然后走到市场去,而且很高兴", "小红晚上走到学校去然后买两个橘子", in_noise("???", 49),
        in_noise(QUESTION.replace("Tom", "Ann"), 50), in_noise(items[9].replace("ﬁnd", "ﬂnd"), 51), in_noise(items[9], 52),
    ]
    found = judged(spark, tmp_path, items, texts)
    one = lambda i: {(i, "copy")}
    assert found == [one(0), set(), set(), one(1), set(), one(2), one(2), set(), one(3), set(), one(4), set(), set(), {(8, "reparameterised")}, set(), one(9)]


def plain_tokens(text):
    """The same canonical form by one scan over words instead of three replacements."""
    out, end, unit_end = [], 0, -1
    for m in regex.finditer(r"\d+(?:[.,:/]\d+)*|[%€$£°]|[\p{L}\p{M}]+(?:/h|/s)?", text):
        token = m[0]
        after_number = bool(out) and out[-1].startswith("") and regex.fullmatch(r"\s?", text[end : m.start()]) is not None
        if token[0].isdigit():
            out.append("" + token)
        elif after_number and token.lower() in UNITS or token in "%€$£°" and after_number:
            out.append("" + token.lower())
            unit_end = m.end()
        elif token in "%€$£°":
            continue
        elif regex.fullmatch(r"\p{Lu}\p{Ll}+", token) and regex.search(r"[\p{L}\p{N},;)] $", text[: m.start()]):
            out.append("" + token.lower())
        else:
            out.append(token.lower())
        end = m.end()
    return out


def test_tokens_match_plain(spark):
    texts = [QUESTION, LITERAL, "He paid 5 USD, then 12.5 kg of Rice at 10:30 (Monday). New line\nStarts here; Paul left", "20% off 3km 4 km walk", "Ünder Ärzten"]
    found = [r.t for r in spark.createDataFrame([(t,) for t in texts], "text string").select(valued_tokens(F.col("text")).alias("t")).collect()]
    assert found == [plain_tokens(t) for t in texts]
