"""Tables of awkward documents: nulls in any column, ties, repeats, empty and very long texts."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, _tie int, size int, token string, h string"


def awkward_rows(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünder", "naïve", "it's", "x1", "2024", "word", "WORD", "a"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines), rng.choice(["en", None]), rng.choice(["s0", "s0", "s0", "s1", "é", None])))
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \t\n\x0b\x0c\r ", "en", "s1"), (103, "one", None, "empty-ish"), (None, "no id at all here", "en", "s0"), (None, None, None, None)]
    rows += [(104, "same same row", "en", "s0")] * 3 + [(105, "tie a", "en", "s0"), (105, "tie b", "fr", "s1")]
    rows += [(106, " ".join(rng.choices(vocabulary, k=20_000)), "en", "s0"), (107, "Zeile mit emoji 😀 und nbsp x", "de", "s1")]
    return [(i, t, lang, s, None if t is None else len(t), "r", 1, 2, "tok", "h") for i, t, lang, s in rows]


def awkward(spark, seed=1, n=40):
    return spark.createDataFrame(awkward_rows(seed, n), SCHEMA)


def folder(spark, tmp_path, df, **tables):
    """A folder like a test data one; returns its path."""
    for name, frame in {"documents": df, **tables}.items():
        frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
