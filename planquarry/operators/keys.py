"""Keys and labels of records: ids, images, shards, splits and checkpoints, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Fields that name a record, in order of preference, and words of file names that tell a split.
SHARD_FIELDS = ["sample_id", "image", "dataitem_name"]
SPLIT_WORDS = [("test", ["test"]), ("val", ["val", "dev"])]
OTHER_SPLIT = "train"
# End of fixed values.


def _clean(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def file_name(path: Column) -> Column:
    """Last part of a path; slashes at its end don't count."""
    return X.basename(F.rtrim(path, F.lit("/")))


def record_keys(ids: list[Column], images: Column) -> Column:
    """Distinct keys in order: the ids that are there, then each image as it is written and by its file name."""
    own = F.array(*[_clean(c) for c in ids]) if ids else F.array().cast("array<string>")
    named = F.flatten(F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda p: F.array(_clean(p), file_name(_clean(p)))))
    return F.array_distinct(F.filter(F.concat(own, named), lambda k: k != ""))


def primary_id(keys: Column, fallback: Column) -> Column:
    return F.coalesce(F.get(keys, 0), fallback)


def shard_key(fields: dict[str, Column]) -> Column:
    """The first of SHARD_FIELDS that is there, after its name; null where none is."""
    return F.coalesce(*[F.when(_clean(fields[n]) != "", F.concat(F.lit(f"{n}:"), _clean(fields[n]))) for n in SHARD_FIELDS if n in fields])


def split_of(path: Column) -> Column:
    """Split that a file's name tells."""
    name = F.lower(file_name(path))
    out = F.when(F.lit(False), "")
    for split, words in SPLIT_WORDS:
        for word in words:
            out = out.when(F.contains(name, F.lit(word)), split)
    return out.otherwise(OTHER_SPLIT)


def checkpoint_label(path: Column, root: str | None = None) -> Column:
    """A checkpoint's path below `root`, else its folder and name."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/+")
    last = F.array_join(F.filter(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), lambda p: p != ""), "/")
    if root is None:
        return last
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.rtrim(F.substring(path, len(top) + 1, 1 << 20), F.lit("/"))).otherwise(last)


def label_size(category: Column, size: Column) -> Column:
    """Category and size as one label."""
    return F.concat(category, F.lit("_"), F.coalesce(size, F.lit("")))


def tokens(views: Column, features: Column) -> Column:
    """Categories of a row as tokens that tell views from features."""
    named = lambda kind, items: F.transform(items, lambda c: F.concat(F.lit(f"{kind}:"), c))
    return F.concat(named("view", views), named("feature", features))
