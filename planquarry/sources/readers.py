"""Readers of annotation files: JSON arrays and wrapped objects, JSON lines, labelling exports, images, rules, documents."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE = "array<struct<value:struct<label:string,size:string>,bbox:array<double>>>"
RAW = f"dataitem_name string, width int, height int, tasks array<struct<task_name:string,task_values:{VALUE}>>"
# Keys under which files wrap their rows.
WRAPPERS = ["data", "items", "annotations", "records", "samples", "results", "predictions"]


def _wide(columns: str) -> str:
    return ", ".join(f"{k} array<struct<{_as_struct(columns)}>>" for k in WRAPPERS)


def _as_struct(columns: str) -> str:
    """`a int, b array<..>` to `a:int,b:array<..>`: only the first space of each top-level column turns into a colon."""
    out, depth, part = [], 0, ""
    for c in columns + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return ",".join(out)


def json_items(spark: SparkSession, path: str, columns: str = RAW, strict: bool = True) -> DataFrame:
    """Rows of JSON files that hold a list, or an object with the list under one of WRAPPERS."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    kind = f"array<struct<{_as_struct(columns)}>>"
    options = {"mode": mode}
    plain = F.from_json("v", kind, options)
    wrapped = F.from_json("v", _wide(columns), options)
    rows = F.when(F.ltrim(F.col("v")).startswith("["), plain).otherwise(F.coalesce(*[wrapped[k] for k in WRAPPERS]))
    return whole.select(F.inline(rows))


def json_lines(spark: SparkSession, path: str, columns: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped; bad lines fail if strict, else they are left out."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    kind = f"struct<{_as_struct(columns)}>"
    if strict:
        return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    good, _ = lines_with_errors(spark, path, columns)
    return good


def lines_with_errors(spark: SparkSession, path: str, columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): errors are (file, line) of lines that are no JSON object of these columns."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("value")).where("trim(value) <> ''")
    schema = f"struct<{_as_struct(columns)},_bad:string>"
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    names = [c.split(":")[0] for c in re.split(r",(?![^<]*>)", _as_struct(columns))]
    return parsed.where(~bad).select(*[f"r.{n}" for n in names]), parsed.where(bad).select("file", F.col("value").alias("line"))


def annotations(items: DataFrame) -> DataFrame:
    """(image, task, cat, size, box, pos) of raw items: nested tasks to rows; rows without label or box are left out."""
    from ..functions import geometry as G

    task = items.select(F.col("dataitem_name").alias("image"), F.posexplode("tasks").alias("t", "task"))
    value = task.select("image", "t", F.trim("task.task_name").alias("task"), F.posexplode("task.task_values").alias("v", "x"))
    box = G.ordered(G.box(F.col("x.bbox")))
    rows = value.select(
        "image", "task", F.trim("x.value.label").alias("cat"), F.trim(F.coalesce("x.value.size", F.lit(""))).alias("size"), box.alias("box"), (F.col("t") * 1_000_000 + F.col("v")).alias("pos")
    )
    return rows.where("cat <> '' AND box IS NOT NULL")


def is_labelling_export(columns: list[str]) -> bool:
    return "data" in columns and bool({"annotations", "completions"} & set(columns))


LABELLING = (
    "id long, data struct<image:string,prompt:string>, annotations array<struct<result:array<struct<type:string,original_width:double,original_height:double,"
    "value:struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>,choices:array<string>,text:array<string>,labels:array<string>>>>>>"
)


def labelling_boxes(export: DataFrame) -> DataFrame:
    """(image, cat, box in pixels) of a labelling tool's rectangles, which come in percent of the drawing's sides.
    Of several annotations of a drawing the first counts."""
    result = export.select(F.element_at(F.split(F.col("data.image"), "[/\\\\]"), -1).alias("image"), F.explode(F.get("annotations", 0)["result"]).alias("r"))
    v, w, h = F.col("r.value"), F.col("r.original_width"), F.col("r.original_height")
    side = lambda share, of: F.rint(share * of / 100)
    box = F.array(side(v["x"], w), side(v["y"], h), side(v["x"] + v["width"], w), side(v["y"] + v["height"], h))
    return result.where("r.type = 'rectanglelabels'").select("image", F.get(v["rectanglelabels"], 0).alias("cat"), box.alias("box"))


def _png_or_jpeg(raw: bytes) -> tuple[int, int] | None:
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


def image_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(image, path, width, height) from image headers; other files have null sizes. Pixels are never decoded."""

    def run(batches):
        for b in batches:
            sizes = [_png_or_jpeg(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s and s[0] for s in sizes], pa.int32()), pa.array([s and s[1] for s in sizes], pa.int32())], ["path", "width", "height"]
            )

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    sized = files.mapInArrow(run, "path string, width int, height int")
    return sized.select(F.element_at(F.split("path", "/"), -1).alias("image"), "path", "width", "height")


def resolved_images(items: DataFrame, files: DataFrame) -> DataFrame:
    """(image, width, height, status): sizes from the file, else the item's own, else missing."""
    first = files.groupBy("image").agg(F.min_by(F.struct("width", "height"), "path").alias("f"))
    known = (F.col("width") > 0) & (F.col("height") > 0)
    joined = items.select("image", "width", "height").join(first, "image", "left")
    local = F.col("f.width").isNotNull()
    pick = lambda c: F.when(local, F.col(f"f.{c}")).when(known, F.col(c))
    return joined.select("image", pick("width").alias("width"), pick("height").alias("height"), F.when(local, "local").when(known, "metadata_only").otherwise("missing").alias("status"))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(file, categories, step, keywords, content) of Markdown files with a front matter of simple keys."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    front = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    body = F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*\n", "")
    listed = lambda key: F.filter(
        F.transform(F.split(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{key}:\s*\[?(.*?)\]?\s*$", 1), "[\"']", ""), ","), _strip), lambda x: x != ""
    )
    step = F.coalesce(F.expr("try_cast(s AS INT)"), F.lit(0))
    return text.withColumn("s", F.regexp_extract(front, r"(?m)^step:\s*(\d+)\s*$", 1)).select(
        "file", listed("categories").alias("categories"), step.alias("step"), listed("keywords").alias("keywords"), _strip(body).alias("content")
    )


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Paragraphs packed into chunks of at most `size` signs where one paragraph allows; each chunk starts with the last
    `overlap` signs of the one before."""
    parts = F.filter(F.transform(F.split(text, "\n\n+"), _strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        fits = (F.length(joined) <= size) | (s["open"] == "")
        tail = F.concat(F.right(s["open"], F.lit(overlap)), F.lit("\n\n"), p) if overlap else p
        return F.struct(F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["open"])).alias("done"), F.when(fits, joined).otherwise(tail).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def reports(spark: SparkSession, paths: dict[str, str], columns: str) -> DataFrame:
    """(label, columns..) of JSON reports, one object per file; columns that a report lacks are null. A few small files."""
    out = None
    for label, path in paths.items():
        one = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<{_as_struct(columns)}>", {"mode": "FAILFAST"}).alias("r"))
        one = one.select(F.lit(label).alias("label"), "r.*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no reports")
    return out
