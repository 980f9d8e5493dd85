"""Spelling variants: words one edit apart, by a trie frontier that moves level by level as joins.

Each word is a path in a trie whose nodes are the prefixes where words part or end; the
edges carry the letters between two such nodes. The trie is a table: for every node its
children (label, node), at most one for each first letter. A state is a word, the spelling
that it would have after its edit, how much of that is matched, the node reached, and the
number of edits. States without an edit stand on the word's own nodes. There each child
with another letter gives a state with one edit, the letter replaced or put in; from then on
every level joins the frontier with the children and keeps the states whose letters go on
as the spelling does. A state whose spelling is used up is a neighbour. Leaving a letter
out is putting it in, seen from the shorter word, so links are found from one end and used
from both.

An edit near the beginning of a word would meet the root's many children, so it is looked
for in a second trie, of the words read backwards, where it stands near the end: a pair that
differs by one edit has half of the shorter word in front of the edit or behind it. So only
nodes at half of a word's depth or more are stored.

Nodes are told by a hash of their prefix. Two prefixes that share one only add states,
since a spelling counts only if it equals a word of the table.

Defined cases: a null or empty text has no words; repeated rows count each time; of near
words with equal counts the first in code-point order is the form; words with no near word
are their own root; an empty table gives an empty table. ``words`` must hold each word once
and no null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtext.llm.buffers import mix, pieces, span_hashes, text_bytes
from normtext.llm.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[a-zÀ-ÿ]+"
LEAST_LETTERS = 6
LEAST_TIMES = 5
FORM_TIMES = 5  # a word is a variant of a near word that is at least so many times as frequent
DAMAGE = 199  # one run of letters in so many loses a letter

_END = -1  # instead of a letter, where a word ends


def letter_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run`` for every run of letters of every text, A-Z lower-cased."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))


def damaged(runs: DataFrame) -> DataFrame:
    """``word`` for every run; one in ``DAMAGE`` by the crc32 of ``<doc_id>:<run>`` loses a letter. Without an id none does."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select("run", h.alias("h")).select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))


def frequent_words(words: DataFrame, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """``word, n`` of the words with so many letters and occurrences."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and next letter of the prefixes of each spelling from half of its length on."""
    for batch in batches:
        for piece in pieces(batch, "spelled"):
            data, offsets = text_bytes(piece.column("spelled"))
            sizes = pc.utf8_length(piece.column("spelled")).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(sizes + 1)))
            ends = first[1:] - 1  # one place for each letter and one for the end
            inner = np.ones(first[-1], bool)
            inner[ends] = False
            at = np.empty(first[-1], np.int64)
            at[inner] = np.flatnonzero((data & 0xC0) != 0x80)
            at[ends] = offsets[1:]
            letter = np.full(first[-1], _END, np.int32)
            letter[inner] = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.int32)
            row = np.repeat(np.arange(len(sizes)), sizes + 1)
            depth = np.arange(first[-1]) - first[row]
            deep = depth >= (sizes[row] - 1) // 2
            row, depth = row[deep], depth[deep]
            side = piece.column("backwards").to_numpy(zero_copy_only=False).astype(np.uint64)
            nodes = mix(span_hashes(data, offsets[row], at[deep]) + side[row])
            yield pa.record_batch({
                "spelled": piece.column("spelled").take(pa.array(row)),
                "backwards": piece.column("backwards").take(pa.array(row)),
                "n": piece.column("n").take(pa.array(row)),
                "depth": pa.array(depth.astype(np.int32)),
                "node": pa.array(nodes.view(np.int64)),
                "letter": pa.array(letter[deep]),
            })


def trie_paths(words: DataFrame) -> DataFrame:
    """``spelled, backwards, n, path``: each word's own nodes in both tries, as structs ``depth, node``."""
    both = words.select(F.col("word").alias("spelled"), F.lit(False).alias("backwards"), "n").union(
        words.select(F.reverse("word"), F.lit(True), "n")
    )
    places = written(both.mapInArrow(_prefixes, "spelled string, backwards boolean, n long, depth int, node long, letter int"))
    parting = places.groupBy("node").agg(F.min("letter").alias("least"), F.max("letter").alias("most"))
    nodes = parting.where((F.col("least") < F.col("most")) | (F.col("least") == _END)).select("node")
    return written(
        places.join(nodes, "node", "left_semi")
        .groupBy("spelled", "backwards", "n")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("path"))
    )


def trie_edges(paths: DataFrame) -> DataFrame:
    """``node, children`` (structs ``label, child``): the edge table of both tries."""
    steps = F.expr(
        "transform(slice(path, 2, greatest(size(path) - 1, 0)), (x, i) -> named_struct('node', path[i].node,"
        " 'label', substr(spelled, path[i].depth + 1, x.depth - path[i].depth), 'child', x.node))"
    )
    edges = paths.select(F.explode(steps).alias("e")).select("e.node", "e.label", "e.child").distinct()
    return written(edges.groupBy("node").agg(F.collect_list(F.struct("label", "child")).alias("children")))


def _goes_on(spelling: Column, at: Column, label: Column) -> Column:
    return F.substring(spelling, at + 1, F.length(label)) == label


def _with_edit(at_nodes: DataFrame) -> DataFrame:
    """The states with one edit at the node itself: another letter than the word's own comes next."""
    word, depth = F.col("spelled"), F.col("depth")
    own, head = F.substring(word, depth + 1, F.lit(1)), F.substring(word, F.lit(1), depth)

    def edited(child: Column) -> Column:
        letter = F.substring(child["label"], F.lit(1), F.lit(1))
        put_in = F.concat(head, letter, F.substring(word, depth + 1, F.length(word)))
        replaced = F.concat(head, letter, F.substring(word, depth + 2, F.length(word)))
        # A replaced letter is found from the word with the smaller one only; at the word's end there is none.
        spellings = F.when((own != "") & (own < letter), F.array(put_in, replaced)).when(own != letter, F.array(put_in))
        states = F.transform(
            spellings, lambda s: F.struct(s.alias("spelling"), (depth + F.length(child["label"])).alias("matched"), child["child"].alias("node"))
        )
        return F.coalesce(F.filter(states, lambda s: _goes_on(s["spelling"], depth, child["label"])), F.array())

    found = at_nodes.select("spelled", "backwards", "n", F.explode(F.flatten(F.transform("children", edited))).alias("s"))
    return found.select("spelled", "backwards", "n", "s.*")


def _further(at_nodes: DataFrame) -> DataFrame:
    """The states whose spelling goes on along an edge."""
    on = F.filter("children", lambda c: _goes_on(F.col("spelling"), F.col("matched"), c["label"]))
    found = at_nodes.select("spelled", "backwards", "n", "spelling", "matched", F.explode(on).alias("c"))
    return found.select(
        "spelled", "backwards", "n", "spelling", (F.col("matched") + F.length("c.label")).alias("matched"), F.col("c.child").alias("node")
    )


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, other_n`` for all words of ``words`` (``word, n``) that one edit parts, both ways round."""
    paths = trie_paths(words)
    edges = trie_edges(paths)
    own = paths.select("spelled", "backwards", "n", F.explode("path").alias("p")).select("spelled", "backwards", "n", "p.*")
    own = own.where(F.col("depth") >= F.floor(F.length("spelled") / 2))
    frontier = written(_with_edit(own.join(edges, "node")))
    ended = []
    while True:
        ended.append(frontier.where(F.col("matched") == F.length("spelling")))
        open_states = frontier.where(F.col("matched") < F.length("spelling"))
        frontier = written(_further(open_states.join(edges, "node")))
        if frontier.isEmpty():
            break

    def read(column: str) -> Column:
        return F.when(F.col("backwards"), F.reverse(column)).otherwise(F.col(column))

    pairs = reduce(DataFrame.union, ended).select(read("spelled").alias("word"), "n", read("spelling").alias("other")).distinct()
    told = written(pairs.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other"))
    return told.select("word", "other", "other_n").union(told.select("other", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form: forms followed to the last, twice as far each round."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        roots = moved.select("word", "root")
        if moved.where("further IS NOT NULL").isEmpty():
            return roots


def spelling_variants(words: DataFrame, form_times: int = FORM_TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (``word, n``).

    A word's form is its most frequent near word, if that is ``form_times`` times as frequent.
    """
    words = written(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= form_times * F.col("n"), F.struct(F.col("best.form").alias("form"), form_n.alias("form_n"))).alias("f"),
    ).select("word", "n", "n_near", "f.form", "f.form_n")
    formed = written(formed)
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
