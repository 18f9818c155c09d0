"""Cases in which an operator once did less than the whole job."""

import random
import re

import pytest

import corpus_pipeline
from sluice.llm import quality, simhash
from tests.llm.cases import SCHEMA
from tests.llm.test_near import shingles


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "r", 1, 2, "tok", "h") for i, t, s in rows], SCHEMA)


def near_copies(rng):
    vocabulary = [f"wörd{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        ws = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 40, 200, 400]))
        rows.append(" ".join(ws))
        for _ in range(rng.randint(1, 8)):
            edited = list(ws)
            for _ in range(rng.randint(0, max(1, len(ws) // 30))):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                edited += rng.choices(vocabulary, k=len(ws) // 10)
            rows.append(" ".join(edited))
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(40)]
    rng.shuffle(rows)
    return [*enumerate(rows), (None, rows[0]), (900, None), (901, " \n"), (902, rows[1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_are_grouped_by_five_word_likeness(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BLOCK", 16)
    rows = near_copies(random.Random(seed))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    first = {}
    for i, (d, _) in enumerate(rows):
        first.setdefault(top(i), []).append(d)
    want = sorted((min(m, key=lambda d: (d is None, d or 0)) for m in first.values()), key=str)
    docs = documents(spark, [(i, t, "s0") for i, t in rows])
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == want
    assert len(want) < len(rows) / 2 + 40


def test_the_pipeline_drops_symbol_junk_repeated_lines_and_odd_words(spark):
    good = "\n".join(" ".join(f"word{i}{k}" for i in range(10)) for k in "abcd")
    rows = [(i, good, "s0") for i in range(8)]
    rows += [(10, good + " # $ % & |", "s0"), (11, "\n".join([good, *["one line again"] * 4]), "s0"), (12, " ".join("a b c d e f g h i j k l m n o p q r s t u v w x y z".split()), "s0"), (13, " ".join(f"{i}{'x' * 30}" for i in range(30)), "s0")]
    docs = documents(spark, rows)
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} == set(range(8))
    assert {r.doc_id for r in quality.judge(docs).filter("kept").collect()} == set(range(8))
    # Hosts are judged by the same rules.
    bad = documents(spark, [*rows[:1], *[(100 + i, good + " # $ % & |", "s1") for i in range(50)], (200, good, "s1"), *[(300 + i, good, "s2") for i in range(50)]])
    assert 200 not in {r.doc_id for r in corpus_pipeline.quality_rules(spark, bad, "").collect()}
