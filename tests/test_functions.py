import pytest
from pyspark.sql import functions as F

from millrace.functions import dictionaries as D
from millrace.functions import imaging as I
from millrace.functions import text as X
from millrace.functions import vectors as V


def of(spark, fn, *values):
    schema = ", ".join(f"c{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'binary' if isinstance(v, bytes) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in enumerate(values))
    return spark.createDataFrame([values], schema).select(fn(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize("fn,raw,want", [
    (X.part_number, "13000-K62-B00", "13000K62B00"), (X.part_number, "13000 K62 B00", "13000K62B00"), (X.part_number, "w712/80", "W71280"), (X.part_number, "a b", "AB"), (X.part_number, None, ""),
    (X.find_part_number, "Part No: W712/80", "W712/80"), (X.find_part_number, "BP1234 and BP12345", "BP12345"), (X.find_part_number, "none", None), (X.find_part_number, None, None),
    (X.manufacturer_number, "ab-12 or cd", "AB12"), (X.manufacturer_number, "Does not apply", ""), (X.manufacturer_number, "x1", ""), (X.brand_name, "  Foo   Bar ", "foo bar"), (X.brand_name, "N/A", ""),
    (X.slug, "--ab 1/2 ", "AB-1-2"), (X.file_safe, "bosch::a/b", "bosch__a_b"), (X.split_codes, "90306-KGH-901-94201-30280--misc", ["90306-KGH-901", "94201-30280", "misc"]), (X.clean_note, " | a | ", "a"), (X.url_base, "a?b?c", "a"), (X.class_name, " Brake-Pad x", "brake_pad_x"),
])
def test_text(spark, fn, raw, want):
    assert of(spark, fn, raw) == want


def test_confused_numbers(spark):
    assert of(spark, X.equivalent, "BOSCH-8", "BOSCH-B") and of(spark, X.part_number, "BOSCH-8") != of(spark, X.part_number, "BOSCH-B")


@pytest.mark.parametrize("text,want", [("BOSCH", "Bosch"), ("NGK Spark Plug", "NGK"), ("Unknown", None), ("plate", "ATE"), ("", None), (None, None)])
def test_brands(spark, text, want):
    assert of(spark, lambda c: X.first_entry(c, D.BRANDS), text) == want
    found = of(spark, lambda c: X.brand_with_confidence(c, D.BRANDS), text)
    assert found.brand == want and (found.confidence > 0) == (want is not None)


@pytest.mark.parametrize("name,want", [("brake_pad", "brake"), ("oil_filter", "filter"), ("car_battery", "battery"), ("unknown_object", "unknown"), ("truck", "automotive")])
def test_classes(spark, name, want):
    assert of(spark, lambda c: X.class_category(c, D.CLASS_KEYWORDS), name) == want


def test_dictionary_changes():
    more = D.add_entry(D.BRANDS, "New", ["NeW Parts"])
    assert more["New"] == ["new parts"] and "New" not in D.BRANDS and "New" not in D.remove_entry(more, "New")


@pytest.mark.parametrize("head,want", [(b"\xff\xd8\xff" + bytes(9), "JPEG"), (b"\x89PNG" + bytes(8), "PNG"), (b"RIFF" + bytes(4) + b"WEBP", "WEBP"), (bytes(4) + b"ftyp" + bytes(4), "HEIC"), (b"plain text, long", None), (b"\xff\xd8", None)])
def test_formats(spark, head, want):
    assert of(spark, I.detect_format, head) == want


@pytest.mark.parametrize("values,error,status", [
    ((16 * 2**20, "JPEG", 800, 800), "file_too_large", 413), ((10, None, 800, 800), "unsupported_format", 415), ((10, "JPEG", 100, 100), "image_too_small: 100x100 minimum 320x320", 422), ((10, "JPEG", 4500, 4500), None, None)])
def test_image_gates(spark, values, error, status):
    n, fmt, w, h = values
    v = of(spark, lambda a, b, c, d: I.validate(a, b, c, d, F.lit(100.0), F.lit(50.0), F.lit(20.0)), n, fmt, w, h)
    assert (v.error, v.http_status, v.valid) == (error, status, error is None) and (v.width or 0) <= 4096


def test_image_warnings(spark):
    look = lambda w, h, mean, std, blur: of(spark, lambda a: I.validate(F.lit(1), a, F.lit(w), F.lit(h), F.lit(mean), F.lit(std), F.lit(blur)), "PNG")
    assert look(640, 640, 128.0, 0.0, 0.0).error.startswith("image_too_uniform")
    assert look(640, 640, 0.0, 0.0, 0.0).error.startswith("image_too_uniform")
    assert look(3200, 400, 100.0, 50.0, 20.0).warning == "extreme_aspect_ratio"
    assert look(640, 640, 100.0, 50.0, 49.0).warning == "low_image_quality:blurry"


def test_crops(spark):
    crop = lambda p: of(spark, lambda a: I.box_crop(F.lit(400), F.lit(200), a, F.lit(75), F.lit(250), F.lit(125), p), 150)
    assert crop(0.15).side == 130 and crop(0.0).side == 100


def test_vectors(spark):
    assert of(spark, V.cosine, [1.0, 1.0], [2.0, 2.0]) == pytest.approx(1)
    assert of(spark, V.cosine, [0.0, 0.0], [2.0, 2.0]) == 0
    assert of(spark, V.normalised, [3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert of(spark, lambda a: V.score(a, "l2"), 1.0) == 1 and of(spark, lambda a: V.score(a, "inner_product"), -1.0) == 0
    with pytest.raises(ValueError):
        V.score(F.lit(1.0), "other")
    assert of(spark, lambda v: V.hamming(V.sign_hash(v), F.lit(0)), [1.0, -1.0] * 32) == 32
    assert of(spark, V.mean_absolute_difference, [1.0, 5.0], [2.0, 2.0]) == 2


def test_first_entry_against_plain_search(spark):
    import random

    rng = random.Random(3)
    entries = {"A": ["ab", "abc", "x y"], "B": ["bc", "ab", "q+"], "C": ["c", "zz"], "D": ["d.d", "bcd"]}
    rows = [("".join(rng.choice("abcd xyq+.z") for _ in range(rng.choice([0, 1, 3, 6, 9]))),) for _ in range(400)] + [("w" * 300 + t,) for t in ("", "bcd", "D.D", "zz ab")]
    t = F.col("t")
    for text, got, slow, conf in spark.createDataFrame(rows, "t string").select("t", X.first_entry(t, entries), X.first_entry(t, entries, long=True), X.brand_with_confidence(t, entries)).collect():
        want = next(((n, a) for n, al in entries.items() for a in al if a in text.lower()), (None, ""))
        assert got == slow == want[0] == conf.brand, text
        assert conf.confidence == (min(1.0, len(want[1]) / max(1, len(text))) if want[0] else 0.0)
