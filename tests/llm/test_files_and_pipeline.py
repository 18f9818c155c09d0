"""Shards, token files and the pipeline: round trips, conflicts, and brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sluice.llm import compaction, line_dedup, simhash, token_shards
from sluice.llm.bpe import load_ranks
from sluice.llm.common import work_dir
from sluice.llm.shared_fs import SharedFolder
from tests.llm.cases import SCHEMA, awkward, awkward_rows, folder
from tests.llm.test_near import levenshtein, plain_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_shards_keep_all_rows_through_merges(spark):
    docs = awkward(spark)
    store = compaction.ShardStore(spark, work_dir(spark, "store"), target_bytes=60_000, least_bytes=4_000, fan_in=3)
    for k in range(7):
        store.append(docs.repartition(2, "text"))
        if k % 3 == 2:
            store.compact()
    before = store.manifest()
    version = store.compact()
    after = store.manifest()
    assert version >= before["version"] and not store.groups(after["shards"])
    want = rows_of(docs, docs.columns)
    assert rows_of(store.read(), docs.columns) == Counter({k: 7 * v for k, v in want.items()})
    assert any(s.merges > 1 for s in after["shards"]) and len(after["shards"]) < 14
    assert set(store.data.files()) >= {s.file for s in after["shards"]}
    assert {r.shard_file for r in store.read().collect()} <= {s.file for s in after["shards"]}
    # An older version stays readable as long as its files do.
    store.append(docs.limit(0))
    assert store.read(version).count() == store.read().count()


def test_two_writers_one_version(spark):
    path = work_dir(spark, "store")
    one, two = (compaction.ShardStore(spark, path) for _ in range(2))
    stale = one.manifest()
    two.append(awkward(spark))
    with pytest.raises(compaction.ConflictError):
        one.commit(stale, [], None)
    one.append(awkward(spark))
    assert one.version() == 2 and two.read().count() == 2 * len(awkward_rows())
    with pytest.raises(ValueError):
        one.append(awkward(spark).drop("text"))


def test_an_append_that_commits_after_anothers_compaction(spark):
    path, docs = work_dir(spark, "store"), awkward(spark)
    one, two = (compaction.ShardStore(spark, path, target_bytes=1 << 20, least_bytes=4_000, fan_in=2) for _ in range(2))
    for _ in range(4):
        two.append(docs.coalesce(1))
    old, written = two.version(), one._write(docs, 0)  # moved, not yet committed
    assert two.compact() > old
    two.vacuum()  # what is younger than a day stays
    before = one.manifest()
    one.commit(before, [*before["shards"], *written], before["schema"])
    want = rows_of(docs, docs.columns)
    assert rows_of(two.read(), docs.columns) == Counter({k: 5 * v for k, v in want.items()})
    # The version from before the compaction can be read until it is forgotten.
    assert rows_of(two.read(old), docs.columns) == Counter({k: 4 * v for k, v in want.items()})
    two.vacuum(keep_versions=1, least_age_s=0)
    assert set(two.data.files()) == {s.file for s in two.manifest()["shards"]} and [n for n in two.folder.files() if n.startswith("manifest-")] == [f"manifest-{two.version():010d}.json"]
    assert rows_of(two.read(), docs.columns) == Counter({k: 5 * v for k, v in want.items()})


def test_merges_that_another_writer_made_first_are_left_out(spark):
    path, docs = work_dir(spark, "store"), awkward(spark)
    one, two = (compaction.ShardStore(spark, path, target_bytes=1 << 20, least_bytes=4_000, fan_in=2) for _ in range(2))
    for _ in range(2):
        one.append(docs.coalesce(1))
    shards = one.manifest()["shards"]
    made = one._merge(shards)
    two.compact()
    version = two.version()
    one._replace({s.file for s in shards}, made)
    assert one.version() == version and one.read().count() == 2 * docs.count()


def test_groups_take_similar_sizes():
    store = compaction.ShardStore.__new__(compaction.ShardStore)
    store.target_bytes, store.least_bytes, store.fan_in = 1000, 10, 4
    shards = [compaction.Shard(f"s{i}", b, 0) for i, b in enumerate([5] * 9 + [200] * 3 + [600] * 8)]
    groups = store.groups(shards)
    assert [[s.bytes for s in g] for g in groups] == [[5] * 4, [5] * 4]
    assert all(sum(s.bytes for s in g) <= 1000 for g in store.groups([compaction.Shard(f"t{i}", 450, 0) for i in range(9)]))


def test_manifest_names_are_written_once(spark):
    at = SharedFolder(spark, work_dir(spark, "names"))
    assert at.write_once("a", "one é") and not at.write_once("a", "two")
    assert at.read_text("a") == "one é" and list(at.files()) == ["a"]


def test_sharding_query_has_every_row(spark, tmp_path):
    out = compaction.op4_sharding(spark, folder(spark, tmp_path, awkward(spark))).collect()
    want = Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in awkward_rows())
    assert Counter((r.doc_id, r.text_sha256) for r in out) == want
    assert compaction.op4_sharding(spark, folder(spark, tmp_path / "none", awkward(spark).limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32))
def test_feistel_is_a_permutation(n, seed):
    order = token_shards.Feistel(n, seed)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert order.place(slots).tolist() == list(range(n))


def test_token_files_hold_the_corpus(spark):
    docs = awkward(spark).repartition(3)
    path = work_dir(spark, "tokens")
    tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    about = token_shards.materialise(docs, path, token_shards.ByteBpe(tokenizer, public_tokenizers.PATTERN), 50_256, sequence=32, shard_rows=100)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(tokenizer), special_tokens={})
    reader = token_shards.TrainingReader(spark, path)
    rows = dict(reader.read())
    assert sorted(rows) == list(range(about["sequences"]))
    order = token_shards.Feistel(about["sequences"], about["seed"])
    by_place = dict(zip(order.place(np.arange(about["sequences"])).tolist(), range(about["sequences"]), strict=True))
    found = Counter()
    for _, start, n in about["partitions"]:
        stream = np.concatenate([rows[by_place[p]] for p in range(start, start - (-n // 32))])
        assert (stream[n:] == 50_256).all()
        document = []
        for t in stream[:n].tolist():
            if t == 50_256:
                found[tuple(document)] += 1
                document = []
            else:
                document.append(t)
    assert found == Counter(tuple(encoding.encode_ordinary(r[1] or "")) for r in awkward_rows())
    # Reading goes on from any slot, over the ends of files.
    for slot in (0, 99, 100, 250, about["sequences"] - 1):
        assert [(s, x.tolist()) for s, x in reader.read(slot, 3)] == [(s, rows[s].tolist()) for s in range(slot, min(slot + 3, about["sequences"]))]
    back = token_shards.read_back(spark, path, about).collect()
    assert {r.slot: r.place for r in back} == {s: p for p, s in by_place.items()}
    again = token_shards.materialise(docs, work_dir(spark, "tokens"), token_shards.ByteBpe(tokenizer, public_tokenizers.PATTERN), 50_256, sequence=32, shard_rows=100)
    assert sorted(s["sha256"] for s in again["shards"]) == sorted(s["sha256"] for s in about["shards"])


def test_no_documents_no_files(spark):
    about = token_shards.materialise(awkward(spark).limit(0), work_dir(spark, "tokens"), token_shards.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), 50_256)
    assert about["sequences"] == 0 and about["shards"] == []


def test_one_row_of_each_group_stays(spark):
    docs = awkward(spark).unionByName(awkward(spark).limit(10).withColumn("doc_id", simhash.F.col("doc_id") + 1000))
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in out.collect())
    fps = {i: (r.doc_id, plain_simhash(r.text)) for i, r in enumerate(docs.collect())}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(fps[a][1] ^ fps[b][1]).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a in fps for b in fps if bin(fps[a][1] ^ fps[b][1]).count("1") <= 4):
            break
    least = defaultdict(list)
    for i, r in root.items():
        least[r].append(fps[i][0])
    assert ids == Counter(min(x, key=lambda d: (d is None, d or 0)) for x in least.values())


def plain_pipeline(rows):
    """The first three stages by brute force: ids and texts that go into the mix."""
    kept = []
    for i, t, _, s in rows:
        ws = WORD.findall(t or "")
        windows = defaultdict(list)
        for k in range(len(ws) - 7):
            windows[tuple(ws[k : k + 8])].append(k)
        covered = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        if len(ws) >= 20 and 100 * len(covered) <= 30 * len(ws):
            kept.append((i, t))
    seen, texts = [], []
    for i, t in sorted(kept):
        lines = t.split("\n")
        out = []
        for line in lines:
            blank = not WORD.search(line)
            near = any(line == e or (min(len(line), len(e)) >= line_dedup.MIN_CHARS and abs(len(line) - len(e)) <= 1 and levenshtein(line, e) <= 1) for e in seen)
            if blank or not near:
                out.append(line)
            if not blank:
                seen.append(line)
        if len(out) == len(lines) or any(WORD.search(x) for x in out):
            texts.append((i, "\n".join(out)))
    fps, stays = [], []
    for i, t in texts:
        fp = plain_simhash(t)
        if all(bin(fp ^ x).count("1") > 4 for x in fps):
            stays.append((i, t))
        fps.append(fp)
    return stays


def test_pipeline_against_brute_force(spark, tmp_path):
    import random

    rng = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(6, 15)))
    texts = ["\n".join(line() for _ in range(rng.randint(3, 6))) for _ in range(40)]
    shared = line()
    texts += [f"{line()}\n{shared}\n{line()}\n{line()}" for _ in range(6)] + [texts[0], texts[1] + "!", "short", "a b c d e f g h\n" * 30, texts[2].replace("word1 ", "word2 ", 1)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t), "r", 1, 2, "tok", "h") for i, t, lang, s in rows], SCHEMA)
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, docs)).collect()
    stays = dict(plain_pipeline(rows))
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert set(got) <= set(stays) and len(got) > 0.7 * len(stays)
    total = 0
    for i, copies in got.items():
        mine = WORD.findall(stays[i])
        for r in copies:
            text = encoding.decode(r.ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, encoding.encode_ordinary(text))).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert not Counter(WORD.findall(text)) - Counter(mine)
            total += len(WORD.findall(text))
        assert sum(len(WORD.findall(encoding.decode(r.ids))) for r in copies) <= 2 * len(mine)
    size = sum(len(WORD.findall(t)) for t in stays.values())
    assert abs(total - 1.5 * size) < 0.15 * size


def test_stages_take_awkward_tables(spark, tmp_path):
    docs = awkward(spark)
    at = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "encode":
            assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), at).count() == 0, name
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    assert docs.count() > 0 and pq.read_table(f"{at}/encode").num_rows == docs.count()
