import math
import random
import re
import re._constants as kinds
import re._parser as parser

from helpers import ODD_TEXTS, clashing, documents, prose

from normtext.llm.license_rules import BASE_PHRASES, RULES
from normtext.llm.license_scan import scan_licenses
from normtext.llm.queries import registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def an_example(pattern, rng):
    """A text that the pattern matches."""

    def of(parts):
        out = ""
        for kind, value in parts:
            if kind is kinds.LITERAL:
                out += chr(value)
            elif kind is kinds.IN:
                out += rng.choice([c for k, v in value for c in ([chr(v)] if k is kinds.LITERAL else map(chr, range(v[0], v[1] + 1)))])
            elif kind is kinds.SUBPATTERN:
                out += of(value[3])
            elif kind is kinds.BRANCH:
                out += of(rng.choice(value[1]))
            else:
                least, most, part = value
                out += "".join(of(part) for _ in range(rng.randint(least, min(int(most), least + 2))))
        return out

    return of(parser.parse(pattern))


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(text):
    """All rules on the words joined by one space, without gate; then every pair of detections compared."""
    words = words_of(text)
    line = "".join(" " + w for w in words) + " "
    at = {}
    for w, m in enumerate(re.finditer(" (?=.)", line)):
        at[m.start()] = w
    at[len(line) - 1] = len(words)

    def places(pattern):
        # Neighbouring matches share the space between them: look ahead for it.
        return [(at[m.start()], at[m.end()]) for m in re.finditer(f" (?:{pattern})(?= )", line)]

    base = sorted((a, label, w) for label, w, phrase in BASE_PHRASES for a, _ in places(phrase))
    found = [(a, b, r.priority, i) for i, r in enumerate(RULES) for a, b in places(r.pattern)]
    kept = [
        d for d in found
        if not any(o != d and o[2] <= d[2] and o[0] <= d[0] and o[1] >= d[1] and (o[:2] != d[:2] or o[2:] < d[2:]) for o in found)
    ]
    weights = {}
    for label, weight in [(l, w) for _, l, w in base] + [(RULES[d[3]].label, RULES[d[3]].weight) for d in kept]:
        weights[label] = max(weight, weights.get(label, 0))
    return {
        "n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None, "base_labels": ",".join(sorted({l for _, l, _ in base})),
        "labels": ",".join(sorted(weights)), "score": 1 - math.prod(1 - weights[l] for l in sorted(weights)),
        "spans": sorted((d[0], d[1], RULES[d[3]].label) for d in kept),
    }


def cases():
    rng = random.Random(21)
    texts = list(ODD_TEXTS)
    texts += [
        "CC-BY cc by, CC BY! the GNU General Public License; ALL RIGHTS RESERVED. cc by cc by",
        "Licensed under the Apache License, Version 2.0 (the License)", "(c) Copyright 2019; © 2020 Somebody", "no words: ... --- §",
        "mit der Lizenz von heute", "by all means, general and public rights", "Tous droits réservés. Alle Rechte vorbehalten",
    ]
    texts += [an_example(r.pattern, rng) for r in RULES]
    for _ in range(200):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            parts.append(prose(rng, rng.randrange(6)) if rng.random() < 0.4 else an_example(rng.choice(RULES).pattern, rng))
            if rng.random() < 0.3:
                parts.append(rng.choice(["cc by", "general public license", "all rights reserved", "gnu", "license", "public", "apache"]))
        text = rng.choice([" ", ", ", ".\n"]).join(parts)
        texts.append(text.title() if rng.random() < 0.3 else text)
    texts.append(" ".join(an_example(rng.choice(RULES).pattern, rng) for _ in range(400)))
    return texts


def test_scan_matches_plain(spark, tmp_path):
    texts = cases()
    docs = clashing(documents(spark, [*enumerate(texts), (None, texts[9]), (9, texts[9])]))
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    rows = registry.queries["op12_license_scan"](spark, f"{tmp_path}/in").collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = plain(texts[9 if r.doc_id is None else r.doc_id])
        told = r.asDict()
        assert abs(told.pop("score") - want.pop("score")) < 1e-12
        told.pop("doc_id"), want.pop("spans")
        assert told == want, (r.doc_id, texts[r.doc_id or 9])
    spans = {r.doc_id: r for r in scan_licenses(docs.where("doc_id IS NOT NULL")).collect()}
    for i, text in enumerate(texts):
        assert sorted((d["first"], d["end"], d["label"]) for d in spans[i].detections) == plain(text)["spans"], text


def test_every_rule_is_gated_by_its_own_words():
    rng = random.Random(22)
    assert len(RULES) >= 250 and len({r.pattern for r in RULES}) > 250
    for r in RULES:
        for _ in range(30):
            assert set(r.keywords) <= set(words_of(an_example(r.pattern, rng))), r


def test_many_detections_and_empty_table(spark):
    text = "Released under the MIT License. All rights reserved. " * 3000
    (row,) = scan_licenses(documents(spark, [text])).collect()
    assert len(row.base) == 3000 and len(row.detections) == 3000 and {d["label"] for d in row.detections} == {"mit"}
    assert scan_licenses(documents(spark, [])).count() == 0
