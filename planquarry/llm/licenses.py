"""License scan with a positional index of rare licence words, in DataFrame operations only.

1. Each file keeps the positions of its licence words (the words of the templates below).
2. Document frequencies of these words over all files give their IDF. For each template a file looks up, of the
   template's words that it has itself, the KEYS words of highest IDF.
3. Their hits meet the template postings and vote for the template at (file position - template position).
4. A place that may hold SHARE of the template's words is verified: so many of them, and every word of the mandatory
   phrase, common or short ones too, must stand where they belong.

A place holds a template if SHARE of its words stand there, so at most a quarter of them is missing. That is fewer
than KEYS, so the votes lose no place, and what is found does not depend on frequencies or on other files. The three
base phrases are templates that are their own mandatory phrase, so all of their places are found. Every file keeps its
whole text's hits, and the work on a text grows with the number of its hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, table, written

#: (label, base phrase?, words of the template, mandatory phrase). Base phrases and licence wording.
TEMPLATES = [
    ("mit", True, "mit license", "mit license"),
    ("apache", True, "apache license", "apache license"),
    ("gpl", True, "general public license", "general public license"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("apache", False, "licensed under the apache license version 2 0 the license you may not use this file except in compliance", "licensed under the apache license"),
    ("gpl", False, "redistribute it and or modify it under the terms of the gnu general public license as published", "gnu general public license"),
    ("lgpl", False, "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl", False, "source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("cc", False, "licensed under a creative commons attribution license", "creative commons attribution"),
    ("proprietary", False, "all rights reserved", "all rights reserved"),
]
#: Common words carry no IDF and are not indexed: those of one or two signs and these.
COMMON = ["all", "and", "any", "are", "the", "this", "you", "may", "not", "for", "use", "with"]
KEYS = 5
SHARE = 0.75
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _indexed(phrase: str) -> list[tuple[int, str]]:
    return [(i, w) for i, w in enumerate(phrase.split()) if len(w) > 2 and w not in COMMON]


def _places() -> list[tuple]:
    """(template, label, base, word, position, mandatory?) of all indexed template words."""
    out = []
    for k, (label, base, words, must) in enumerate(TEMPLATES):
        all_words, phrase = words.split(), must.split()
        begin = next(i for i in range(len(all_words)) if all_words[i : i + len(phrase)] == phrase)
        out += [(k, label, base, w, i, begin <= i < begin + len(phrase)) for i, w in _indexed(words)]
    return out


def _phrases() -> list[tuple[int, int, str]]:
    """(template, position, word) of every word of the mandatory phrases, indexed or not."""
    out = []
    for k, (_, _, words, must) in enumerate(TEMPLATES):
        all_words, phrase = words.split(), must.split()
        begin = next(i for i in range(len(all_words)) if all_words[i : i + len(phrase)] == phrase)
        out += [(k, begin + i, w) for i, w in enumerate(phrase)]
    return out


def _unindexed() -> tuple[set[str], set[str], set[str]]:
    """Words of mandatory phrases without index; these with the word after them; those that end a phrase.

    Such words are frequent, so a hit is kept only before the word that follows in a phrase."""
    words, pairs, last = set(), set(), set()
    for *_, must in TEMPLATES:
        phrase = must.split()
        for i in set(range(len(phrase))) - {i for i, _ in _indexed(must)}:
            words.add(phrase[i])
            if i + 1 < len(phrase):
                pairs.add(f"{phrase[i]} {phrase[i + 1]}")
            else:
                last.add(phrase[i])
    return words, pairs, last


def scan(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Null text is empty; an empty text has no words, no labels and score 0; an empty table gives no rows. Repeated rows
    are separate, null ids stay. Very long texts are one row whose hits are dealt out by their places. `score` is the
    largest share of a template's words that stand at a place (1 for a base phrase), half of it where the mandatory
    phrase fails, 0 without places. `places` lists (label, start, share, verified).
    """
    spark = docs.sparkSession
    places = _places()
    vocabulary = sorted({p[3] for p in places})
    low = F.translate(F.coalesce(F.col(text), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    words = F.filter(F.split(low, SEPARATORS), lambda w: w != "")
    common, pairs, last = (sorted(s) for s in _unindexed())

    def hit(x):
        in_phrase = F.concat(x["w"], F.lit(" "), F.get("words", x["pos"] + 1)).isin(pairs) | x["w"].isin(last)
        return x["w"].isin(vocabulary) | (x["w"].isin(common) & F.coalesce(in_phrase, F.lit(False)))

    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.cast("int").alias("pos"), w.alias("w"))), hit)
    files = written(
        docs.select(F.col(row_id).alias("row_id"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
        .select("row_id", "row", F.size("words").cast("long").alias("n_words"), hits.alias("hits")),
        "licenses",
    )
    seen = files.where("size(hits) > 0")
    df = seen.select(F.explode(F.array_distinct("hits.w")).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # One row per word of TEMPLATES at most, whatever the corpus: the rarest word comes first.
    by_idf = [r.w for r in df.orderBy("df", "w").collect()]
    size = {k: sum(p[0] == k for p in places) for k in range(len(TEMPLATES))}
    postings = [(k, w, i, by_idf.index(w), sorted({by_idf.index(p[3]) for p in places if p[0] == k and p[3] in by_idf}), size[k]) for k, _, _, w, i, _ in places if w in by_idf]
    postings = spark.createDataFrame(postings, "template int, w string, tpos int, idf int, own array<int>, n int")
    ranks = F.array_sort(F.array_distinct(F.transform(F.filter("hits.w", lambda w: w.isin(vocabulary)), lambda w: (F.array_position(F.lit(by_idf or [""]), w) - 1).cast("int"))))
    keys = F.slice(F.array_intersect("ranks", "own"), 1, KEYS)
    votes = (
        # Ranks are taken before hits are dealt out, else each hit would carry all hits.
        seen.select("row", ranks.alias("ranks"), "hits")
        .select("row", "ranks", F.explode("hits").alias("h"))
        .select("row", "ranks", "h.pos", "h.w")
        .join(F.broadcast(postings), "w")
        .withColumn("keys", keys)
        .where(F.array_contains("keys", F.col("idf")))
        .groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("start"))
        .agg(F.count(F.lit(1)).alias("votes"), F.first(F.size("keys") - F.floor(F.col("n") * (1 - SHARE))).alias("least"))
        .where("votes >= least")
    )
    # What each place must hold, met with what stands there.
    must = {(k, i) for k, i, _ in _phrases()}
    labels = [(k, label, base) for k, (label, base, _, _) in enumerate(TEMPLATES)]
    wanted = {(k, i): w for k, _, _, w, i, _ in places} | {(k, i): w for k, i, w in _phrases()}
    indexed = {(k, i) for k, _, _, _, i, _ in places}
    wanted = [(k, i, w, (k, i) in indexed, (k, i) in must, size[k], sum(x[0] == k for x in must)) for (k, i), w in sorted(wanted.items())]
    wanted = spark.createDataFrame(wanted, "template int, tpos int, w string, indexed boolean, must boolean, n int, n_must int")
    verified = (
        votes.select("row", "template", "start")
        .join(F.broadcast(wanted), "template")
        .withColumn("pos", F.col("start") + F.col("tpos"))
        .join(seen.select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.w"), ["row", "pos", "w"])
        .groupBy("row", "template", "start")
        .agg((F.count(F.when(F.col("indexed"), 1)) / F.first("n")).alias("share"), (F.count(F.when(F.col("must"), 1)) == F.first("n_must")).alias("ok"))
        .where(F.col("share") >= SHARE)
        .join(F.broadcast(spark.createDataFrame(labels, "template int, label string, base boolean")), "template")
        .where("NOT base OR ok")
    )
    base_ok = F.col("base") & F.col("ok")
    found = verified.groupBy("row").agg(
        F.count(F.when(base_ok, 1)).alias("n_base"),
        F.min(F.when(base_ok, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base_ok, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base_ok, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("ok"), F.col("share")).otherwise(F.col("share") / 2)).alias("score"),
        F.sort_array(F.collect_set(F.struct("start", "label", "share", F.col("ok").alias("verified")))).alias("places"),
    )
    return files.join(found, "row", "left").select(
        F.col("row_id").alias(row_id),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "places",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence words, places and labels of all `documents`; see `scan` for nulls, empty and long texts and repeated rows."""
    return scan(table(spark, sf_dir, "documents")).drop("places")


def _sql() -> str:
    """Every place of every template, without any index: shares of words and whole mandatory phrases."""
    rows = ", ".join(f"({k}, '{w}', {i})" for k, _, _, w, i, _ in _places())
    phrases = ", ".join(
        f"({k}, '{label}', {base}, {min(i for t, i, _ in _phrases() if t == k)}, {must.split()})" for k, (label, base, _, must) in enumerate(TEMPLATES)
    )
    return f"""
WITH t(template, w, tpos) AS (VALUES {rows}),
p(template, label, base, off, phrase) AS (VALUES {phrases}),
n AS (SELECT template, count(*) AS n FROM t GROUP BY template),
files AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
hits AS (SELECT r, w, i - 1 AS pos FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM files) WHERE w IN (SELECT w FROM t)),
place AS (SELECT r, template, pos - tpos AS start, count(*) / CAST(min(n) AS DOUBLE) AS share FROM hits JOIN t USING (w) JOIN n USING (template)
  GROUP BY r, template, pos - tpos HAVING count(*) / CAST(min(n) AS DOUBLE) >= {SHARE}),
ver AS (SELECT place.*, label, base, start + off >= 0 AND ws[start + off + 1 : start + off + len(phrase)] = phrase AS ok
  FROM place JOIN p USING (template) JOIN files USING (r)),
agg AS (SELECT r, count(*) FILTER (base AND ok) AS n_base, min(start) FILTER (base AND ok) AS first_word, max(start) FILTER (base AND ok) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND ok) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels,
  max(CASE WHEN ok THEN share ELSE share / 2 END) AS score FROM ver WHERE NOT base OR ok GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM files LEFT JOIN agg USING (r)
"""


QUERIES = {"op4_licenses": op4_licenses}
ORACLE_SQL = {"op4_licenses": _sql()}
