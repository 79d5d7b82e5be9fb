"""Scalar functions against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from planquarry.functions import geometry as G
from planquarry.functions import parsing as P
from planquarry.functions import text as X
from planquarry.functions import vocabulary as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lit(v):
    return F.lit(v) if v is not None else F.lit(None).cast("string")


def box(*v):
    return F.array(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize(
    "value, strict, lenient",
    [
        ("threaded_hole", "Threaded Hole", "Threaded Hole"),
        ("螺纹孔", "Threaded Hole", "Threaded Hole"),
        (" FRONT  view ", "Orthographic Projection - Front View", "Orthographic Projection - Front View"),
        ("orthographic projection–rear view", "Orthographic Projection - Rear View", "Orthographic Projection - Rear View"),
        ("Thread Hole X", None, "Thread Hole X"),
        ("", None, ""),
        (None, None, ""),
    ],
)
def test_category(spark, value, strict, lenient):
    assert one(spark, V.category(lit(value)), V.category(lit(value), strict=False)) == (strict, lenient)


def test_category_kinds_and_projection(spark):
    c = lit("Round Hole")
    assert one(spark, V.category(c, "feature"), V.category(c, "view")) == ("Round Hole", None)
    assert one(spark, V.projection(lit("first-angle")), V.projection(lit("")), V.projection(lit("other"))) == ("first_angle", "unknown", None)


@pytest.mark.parametrize(
    "value, kind, expected",
    [
        ("φ8,50 mm", "Round Hole", "8.50"),
        ("4-Ø18.0", "Round Hole Group", "4X18"),
        ("4-M6", "Threaded Hole Group", "4XM6"),
        ("LL12", "Slotted Hole", "12"),
        ("dia 5", None, "Ø5"),
        ("45 degrees", None, "45°"),
        ("2 × 3", None, "2X3"),
        (None, None, ""),
        ("  ", "Fillet", ""),
    ],
)
def test_size(spark, value, kind, expected):
    assert one(spark, X.size(lit(value), lit(kind) if kind else None)) == (expected,)


def test_older_size(spark):
    k = lit("Round Hole Group")
    assert one(spark, X.size_older(lit("4-φ8,0 mm"), k), X.size_older(lit("∅5")), X.size_older(lit("diameter 3")), X.size_older(lit("LL5"), lit("slot"))) == ("4-8", "∅5", "DIAMETER3", "LL5")


def test_size_similarity(spark):
    k = lit("Threaded Hole")
    pairs = [("M8", "M8DP10", 2 / 3), ("M8", "m8", 1.0), ("", "M8", 0.0), (None, "", 1.0), ("R1", "Ø2", 0.0), ("2X2", "2", 2 * 0.5 / 1.5)]
    for a, b, expected in pairs:
        assert one(spark, X.size_similarity(lit(a), lit(b), k))[0] == pytest.approx(expected)


def test_numbers_and_preference(spark):
    assert one(spark, X.number(lit("8.500")), X.number(lit("08")), X.number(lit("0.1234567"))) == ("8.5", "8", "0.123457")
    assert one(spark, X.prefer_size(F.array(*map(F.lit, ["8", "Ø8", "12345"])))) == ("Ø8",)


def test_names(spark):
    cases = {"226_A7E001_rot45.png": "a7e001", "a b_flip_h_rot90.jpg": "a_b", "x_page_2.png": "x", "123_other.png": "123_other", "": "unknown_family", "d/e/part-aug3.png": "part"}
    for name, family in cases.items():
        assert one(spark, X.family_id(lit(name))) == (family,)
    assert one(spark, X.is_augmented(lit("x_rot5.png")), X.is_augmented(lit("rotor.png")), X.stem(lit("a/b.c.png")), X.stem(lit(".hidden"))) == (True, False, "b.c", ".hidden")
    assert one(spark, X.without_thinking(lit("a<think>b</think>c<THINK>d"))) == ("ac",)
    assert one(spark, X.edit_distance(lit("kitten"), lit("sitting")), X.edit_distance(lit(""), lit(""))) == (3 / 7, 0.0)


def test_stable_rank(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7\0ns\x0042").digest()[:8], "big")
    assert int(one(spark, X.stable_rank(7, "ns", F.lit(42)))[0]) == want


@pytest.mark.parametrize(
    "values, size, expected",
    [
        ([0.1, 0.2, 0.5, 0.6], None, [100, 200, 500, 600]),
        ([1100, 10, 2000, 500], (2000, 1000), [550, 10, 1000, 500]),
        ([1100, 10, 2000, 500], None, None),
        ([5, 5, 5, 9], None, None),
        ([1100, 10, 2000, 500], (-1, 1000), None),
        ([10, 10, 20, 2000], None, [10, 10, 20, 1000]),
    ],
)
def test_normalize(spark, values, size, expected):
    w, h = (F.lit(size[0]), F.lit(size[1])) if size else (None, None)
    assert one(spark, G.normalize(box(*values), w, h)) == (expected,)


def test_boxes(spark):
    a, b = box(0, 0, 10, 10), box(0, 0, 10, 5)
    assert one(spark, G.iou(a, b), G.area(a), G.intersection(a, b), G.containment(b, a)) == (0.5, 100.0, 50.0, 1.0)
    assert one(spark, G.crop_to_global(box(0, 0, 500, 500), box(200, 200, 600, 600))) == ([200.0, 200.0, 400.0, 400.0],)
    assert one(spark, G.global_to_crop(box(200, 200, 400, 400), box(200, 200, 600, 600))) == ([0.0, 0.0, 500.0, 500.0],)
    assert one(spark, G.ordered(box(9, 9, 1, 1)), G.ordered(box(1, 1, 1, 9))) == ([1.0, 1.0, 9.0, 9.0], None)
    assert one(spark, G.valid(a), G.valid(box(0, 0, 2000, 10)), G.valid(F.lit(None).cast("array<double>"))) == (True, False, False)
    assert one(spark, G.box(F.array(*map(F.lit, ["1", "2", "3", "4"]))), G.box(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(2.0), F.lit(3.0)))) == ([1.0, 2.0, 3.0, 4.0], None)
    assert one(spark, G.expand(box(100, 100, 200, 200)), G.match_score(F.lit(0.8), F.lit(True)), G.match_score(F.lit(0.5), F.lit(False))) == ([90.0, 90.0, 210.0, 210.0], 1.0, 0.25)
    repaired = G.normalize_repaired(box(100, 0, 100, 50), F.lit(100), F.lit(100))
    assert one(spark, repaired, G.normalize_repaired(box(100, 0, 100, 50), F.lit(100), F.lit(100), "up")) == ([999.0, 0.0, 1000.0, 500.0], [1000.0, 0.0, 1000.0, 500.0])
    nothing = F.lit(None).cast("array<double>")
    assert one(spark, G.iou(a, nothing), G.area(nothing), G.normalize(nothing)) == (0.0, 0.0, None)


def test_parsing():
    item = '{"category": "Fillet", "size": "R1", "bbox": [1, 2, 3, 4]}'
    assert P.object_of("<think>{}</think> ```json\n{\"a\": 1}\n```") == {"a": 1}
    assert P.object_of('{"a": 1} x') is None and P.object_of("[1]") is None and P.object_of(None) is None and P.object_of('{"a": NaN}') is None
    assert P.list_of(f"text [{item}, {{\"category\": \"Ro") == [{"category": "Fillet", "size": "R1", "bbox": [1, 2, 3, 4]}]
    assert P.list_of("nothing here") is None and P.list_of("") is None
    assert P.lists_of("a [1] b [2, 3] c [") == [[1], [2, 3]]
    assert P.items_of([{"label": "A", "bbox_2d": [1, 2, 3, 4]}, {"label": "", "bbox": [1, 2, 3, 4]}, {"label": "B", "bbox": [1]}, 7]) == [{"category": "A", "size": "", "bbox": [1.0, 2.0, 3.0, 4.0]}]


def test_parsing_columns(spark):
    rows = spark.createDataFrame([("```json\n[{\"category\":\"A\",\"bbox\":[1,2,3,4]}]\n```",), ("x",), (None,)], "t string")
    got = [r.i and [tuple(x) for x in r.i] for r in rows.select(P.parse_items("t").alias("i")).collect()]
    assert got == [[("A", "", [1.0, 2.0, 3.0, 4.0])], None, None]
    snapped = rows.sparkSession.createDataFrame([("ound Hole",), ("zzz",), (None,)], "t string").select(P.snap(V.FEATURES)("t").alias("s"))
    assert [r.s for r in snapped.collect()] == ["Round Hole", "zzz", None]


def test_families_have_no_cap(spark):
    name = "part" + "_rot5" * 9 + ".png"
    assert one(spark, X.family_id(lit(name)), X.safe_stem(lit("")), X.safe_stem(lit("a b"))) == ("part", "image", "a_b")


def test_older_and_newer_signs_in_sizes(spark):
    values = ["DIA.deg", "45deg", "8 mm x 9MM", "1,5,2", "dia. 5", "DIA.5", "3.00", "3.001"]
    got = one(spark, *[X.size(lit(v)) for v in values])
    assert got == ("ØDEG", "45DEG", "8X9", "1.5.2", "Ø.5", "Ø5", "3", "3.001")
