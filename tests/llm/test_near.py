"""SimHash groups, fingerprints and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import fingerprints, line_dedup, simhash
from sluice.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, _tie int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], SCHEMA)


def plain_simhash(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"wörd{i}" for i in range(200)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]
    near = [t.replace("wörd1 ", "Wörd1\t", 1) + " tail" for t in base[:20]]
    copies = base[:5] * 4
    return [*base, *near, *copies, "", None, " \n ", "one", "One", "long " * 30_000]


def test_simhash_groups_match_all_pairs(spark, texts):
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(table(spark, rows)).collect()}
    fps = {i: plain_simhash(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == fps
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert {i: c for i, (_, c) in got.items()} == group


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    one = np.unique(centres[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)))
    for within in (True, False):
        a, b = (one, one) if within else (one[::2].copy(), one[1::2].copy())
        blocks = [simhash.Block(np.arange(len(x)), x.reshape(-1, 1), simhash.quarter_counts(x.reshape(-1, 1))) for x in (a, b)]
        tied = simhash.Forest(len(a) if within else len(a) + len(b))
        for i, j in simhash.linked(*blocks, within, 3):
            tied.join(np.array([i]), np.array([j]))
        root = tied.root
        rows = one if within else np.concatenate([a, b])
        linked = np.bitwise_count(rows[:, None] ^ rows[None, :]) <= 3
        if not within:
            linked[: len(a), : len(a)] = linked[len(a) :, len(a) :] = False
        label = np.arange(len(rows))
        for _ in range(len(rows)):
            new = np.array([min(label[i], label[linked[i]].min(initial=label[i])) for i in range(len(rows))])
            if (new == label).all():
                break
            label = new
        assert [sorted(np.flatnonzero(root == r)) for r in np.unique(root)] and all((root[i] == root[j]) == (label[i] == label[j]) for i in range(0, len(rows), 7) for j in range(len(rows)))


def test_components_of_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (3, 4), (500, 500)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(edges.limit(0)).count() == 0


def plain_lines(rows):
    seen, lost = [], set()
    for i, t in sorted(rows, key=lambda r: r[0]):
        for at, line in enumerate((t or "").split("\n")):
            if not re.search(r"[^\x20\x09-\x0D]", line):
                continue
            if any(line == e or (min(len(line), len(e)) >= line_dedup.MIN_CHARS and abs(len(line) - len(e)) <= 1 and levenshtein(line, e) <= 1) for e in seen):
                lost.add((i, at))
            seen.append(line)
    return lost


def edits(line, rng):
    at = rng.randrange(len(line) + 1)
    return rng.choice([line[:at] + "x" + line[at:], line[:at] + line[at + 1 :], line[:at] + "y" + line[at + 1 :], line[:at] + "zz" + line[at:]])


def test_dropped_lines_match_all_pairs(spark):
    rng = random.Random(11)
    lines = ["".join(rng.choices("abé ", k=rng.randint(10, 40))) + "q" for _ in range(25)] + ["short", "aaaaaaaaaaaaaaaaaaaaaa", "ab" * 12]
    rows = []
    for i in range(40):
        picked = [rng.choice(lines) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(edits(p, rng) if rng.random() < 0.6 else p for p in picked)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "x" * 20_000), (54, "x" * 20_001), (55, "x" * 10_000 + "y" + "x" * 9_999)]
    small = [r for r in rows if r[0] < 53]
    got = {(r.doc_id, r.at) for r in line_dedup.dropped_lines(table(spark, rows)).collect()}
    assert {g for g in got if g[0] < 53} == plain_lines(small)
    assert {g for g in got if g[0] >= 53} == {(54, 0), (55, 0)}


def test_dedup_documents_keeps_columns_and_whole_lines(spark):
    line = "a line that is long enough"
    rows = [(2, f"first\n{line}"), (3, line), (1, f"{line}!\n\nother words here"), (4, None), (5, " "), (5, " ")]
    out = line_dedup.dedup_documents(table(spark, rows))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(1, f"{line}!\n\nother words here"), (2, "first"), (4, None), (5, " "), (5, " ")]
    assert line_dedup.dedup_documents(table(spark, rows).limit(0)).count() == 0


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_fingerprints_estimate_likeness(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id " * 9)]
    got = {r.doc_id: r for r in fingerprints.edited_pairs(table(spark, rows)).withColumn("near", fingerprints.likeness(fingerprints.F.col("fingerprint"), fingerprints.F.col("edited_fingerprint"))).collect()}
    assert len(got) == len(rows)
    order = [*sorted((i for i, _ in rows if i is not None), reverse=True), None]
    text = {i: t or "" for i, t in rows}
    errors = []
    for k, i in enumerate(order):
        mine, after = text[i], text[order[(k + 1) % len(order)]]
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + after[:half]
        assert got[i].edited == edited and got[i].n_chars == len(mine)
        a, b = shingles(mine), shingles(edited)
        if len(a | b) > 60:
            errors.append(got[i].near - len(a & b) / len(a | b))
        elif not a or not b:
            assert got[i].near == float(a == b)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert len({r.fingerprint for r in got.values() if r.text == texts[0]}) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), min_size=0, max_size=300, unique=True), st.integers(1, 300))
def test_buckets_are_counts_of_bounds(values, n):
    from bisect import bisect_right

    bounds = sorted(values)[:n]
    steps = max(1, len(bounds).bit_length())
    padded = bounds + [(1 << 63) - 1] * ((1 << steps) - len(bounds))
    for key in [*values[:20], 0]:
        at = 0
        for p in [1 << s for s in reversed(range(steps))]:
            at += p if padded[at + p - 1] <= key else 0
        assert at == bisect_right(bounds, key)
