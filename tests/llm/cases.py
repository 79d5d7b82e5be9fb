"""Small documents with the awkward cases, and brute-force versions of the operators."""

import random

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, n int, shard string, score string"


def documents(seed=1, near=25, passage=30):
    """Rows of (doc_id, text): nulls, empty and one-word texts, exact and near copies, a shared passage, a long text,
    runs of one character, other scripts."""
    r = random.Random(seed)
    words = ["w%03d" % i for i in range(400)] + ["Straße", "ñandú", "漢字", "🙂", "The", "don't"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "One two", "one two three four", "a" * 500, "ab" * 300, "a" * 500, "x\x00y \x1c z"]
    texts += [make(r.randint(3, 120)) for _ in range(40)]
    base = make(90)
    for _ in range(near):
        w = base.split(" ")
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.5:
            w = w[: r.randint(70, 90)]
        texts.append(" ".join(w))
    texts += [base] * 6 + [base.upper(), base.replace(" ", "\n")]
    shared = make(40)
    texts += [make(r.randint(0, 30)) + " " + shared + " " + make(r.randint(0, 30)) for _ in range(passage)]
    texts += [make(6000), "MIT License", "the Apache\nLicense, and the GNU General  Public-License; mit license MIT LICENSE."]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """With the columns of `documents` and others whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 0, "x", "y") for i, t in rows], SCHEMA)


def table_dir(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"
