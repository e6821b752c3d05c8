import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.functions import geometry, ner, pixels, spans, text
from quillmask.functions.patterns import SPANS, detect_patterns
from quillmask.operators import actions, change

# Texts and what is found in them.
VECTORS = [
    ("mail a.b@x.co.in and ravi@okaxis now", [("EMAIL", "a.b@x.co.in"), ("UPI", "ravi@okaxis")]),
    ("rahul [at] gmail [dot] com", [("EMAIL", "rahul [at] gmail [dot] com")]),
    ("PAN ABCPE1234F and é192.168.1.1", [("PAN", "ABCPE1234F"), ("IP", "192.168.1.1")]),
    ("abcpe1234f ABCXE1234F", []),
    ("aadhaar 2341 2341 2346", [("AADHAAR", "2341 2341 2346")]),
    ("aadhaar 2341 2341 2347", []),
    ("card 4111 1111 1111 1111", [("CARD", "4111 1111 1111 1111")]),
    ("card 4111 1111 1111 1112", []),
    ("account no 4111111111111111", [("ACCOUNT", "4111111111111111")]),
    ("  123456789012  ", [("ACCOUNT", "  123456789012  ")]),
    ("call +91 98765 43210.", [("PHONE", "+91 98765 43210")]),
    ("call 58765 43210", []),
    ("dob: 31/02/1990 dob 12/03/1990", [("DOB", "12/03/1990")]),
    ("born 3rd March 1990", [("DOB", "3rd March 1990")]),
    ("on 3rd March 1990", []),
    ("Pune, 411 001", [("PINCODE", "411 001")]),
    ("passport K1234567", [("PASSPORT", "K1234567")]),
    ("KA 01 AB 1234 XX 01 AB 1234", [("VEHICLE", "KA 01 AB 1234")]),
    ("HDFC0001234", [("IFSC", "HDFC0001234")]),
    ("27AAPFU0939F1ZV 27AAPFU0939F1ZW", [("GSTIN", "27AAPFU0939F1ZV")]),
    ("1.2.3.256 01.2.3.4 1.2.3.4", [("IP", "1.2.3.4")]),
    (None, []),
    ("", []),
]


def test_detection_vectors(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VECTORS)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", detect_patterns(F.col("t")).alias("s")).collect()}
    for i, (t, want) in enumerate(VECTORS):
        assert [(s.type, s.value) for s in got[i]] == want, t
        assert all(t[s.start : s.end] == s.value for s in got[i])


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def lit_spans(*items):
    return F.array(*(F.struct(F.lit(t).alias("type"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("v").alias("value"), F.lit(s).alias("source"), F.lit(0.9).alias("confidence")) for t, a, b, s in items)).cast(SPANS)


def test_fusion(spark):
    cases = [
        ([("NAME", 0, 10, "ner"), ("PAN", 3, 5, "pattern")], [("NAME", 0, 3), ("PAN", 3, 5), ("NAME", 5, 10)]),
        ([("NAME", 0, 5, "ner"), ("ADDRESS", 3, 9, "ner")], [("NAME", 0, 9)]),
        ([("PAN", 0, 5, "pattern"), ("CARD", 2, 9, "known")], [("PAN", 0, 5)]),
        ([("NAME", 2, 4, "ner"), ("PAN", 0, 9, "pattern")], [("PAN", 0, 9)]),
    ]
    for given, want in cases:
        (out,) = one(spark, spans.merge_spans(lit_spans(*given)).alias("m"))
        assert [(s.type, s.start, s.end) for s in out] == want


def test_known_values_and_field_words(spark):
    entries = F.array(F.struct(F.lit("NAME").alias("type"), F.lit("A.b").alias("value")), F.struct(F.lit("PIN").alias("type"), F.lit("12").alias("value")))
    (found,) = one(spark, spans.known_values(F.lit("a.B xA.b a.b! 12"), entries).alias("k"))
    assert [(s.start, s.end, s.value) for s in found] == [(0, 3, "a.B"), (9, 12, "a.b")]
    names = F.array(F.struct(F.lit("NAME").alias("type"), F.lit(4).alias("start"), F.lit(20).alias("end"), F.lit("UPI  diptendu no").alias("value"), F.lit("ner").alias("source"), F.lit(0.9).alias("confidence")))
    (kept,) = one(spark, ner.drop_field_words(names.cast(SPANS)).alias("k"))
    assert [(s.start, s.end, s.value) for s in kept] == [(9, 17, "diptendu")]


def test_hashes_and_urls(spark):
    got = one(spark, text.fnv1a(F.lit("abc")), text.fnv1a(F.lit("c"), text.fnv1a(F.lit("ab"))), text.origin_of(F.lit("HTTPS://u@Ex.com:443/a")), text.origin_of(F.lit("about:blank")), text.host_of(F.lit("not a url")), text.clip(F.lit("abcdef"), 4))
    assert got == [440920331, 440920331, "https://ex.com", "", "", "abc…"]


def test_boxes(spark):
    b = lambda *v: geometry.box(*map(F.lit, v))
    faces = F.array(*(F.struct(F.lit(s).alias("score"), b(*v).alias("box")) for s, v in ((0.7, (0, 0, 10, 10)), (0.9, (1, 1, 10, 10)), (0.8, (50, 50, 5, 5)))))
    kept, share, small = one(spark, geometry.suppress(faces), geometry.union_share(F.array(b(10, 10, 10, 10), b(15, 10, 10, 10)), F.lit(100), F.lit(100), 0), geometry.clipped(b(-5, 0, 40, 90), F.lit(100), F.lit(100)))
    assert [f.score for f in kept] == [0.9, 0.8] and share == pytest.approx(0.015) and small is None


def test_pixels():
    rng = np.random.Generator(np.random.PCG64(3))
    img = rng.integers(0, 255, (64, 80, 4), dtype=np.uint8)
    assert pixels.difference_hash(img, 0, 0, 80, 64) == pixels.difference_hash(img.copy(), 0, 0, 80, 64)
    flat = np.full((32, 32, 4), 9, np.uint8)
    assert pixels.difference_hash(flat, 0, 0, 32, 32) == 0 and len(pixels.tile_hashes(img)) == 64
    assert (pixels.resize(img, 0, 0, 80, 64, 80, 64) == img).all()
    black = pixels.black_fill(img, [(10, 10, 5, 5)], 0)
    assert (black[10:15, 10:15] == (0, 0, 0, 255)).all() and (black[:10] == img[:10]).all()
    assert (pixels.only_inside(img, [(10, 10, 5, 5)])[10:15, 10:15] == img[10:15, 10:15]).all()
    assert pixels.pixel_key(img) != pixels.pixel_key(black) and pixels.pixel_key(img) == pixels.pixel_key(img.copy())
    mask = np.zeros((6, 8), bool)
    mask[1:3, 1:4] = mask[2:5, 3] = mask[5, 7] = True
    assert pixels.components(mask, 2) == [(1, 1, 3, 4)] and len(pixels.components(mask, 1)) == 2
    assert pixels.normalized_planes(flat, (0, 0, 0), (1, 1, 1)).shape == (3, 32, 32)


def test_pixel_columns(spark):
    img = np.zeros((16, 16, 4), np.uint8)
    img[:, 8:] = 200
    df = spark.createDataFrame([(bytearray(img.tobytes()), 16, 16, [[0.0, 0.0, 4.0, 4.0]], [])], "data binary, w int, h int, t array<array<double>>, f array<array<double>>")
    row = df.select(pixels.column("hash")("data", "w", "h").alias("h"), pixels.column("tiles")("data", "w", "h").alias("t"), pixels.column("key")("data", "w", "h").alias("k"), pixels.column("redact")("data", "w", "h", "t", "f").alias("r")).first()
    assert row.h == pixels.difference_hash(img, 0, 0, 16, 16) and len(row.t) == 64 and row.k.startswith("16x16:") and len(row.r) == len(img.tobytes())


def test_decoders(spark):
    frames = F.array(*(F.array(*map(F.lit, f)) for f in ([0.9, 0.1, 0.0], [0.1, 0.8, 0.1], [0.1, 0.7, 0.2], [0.6, 0.2, 0.2], [0.1, 0.6, 0.3], [0.0, 0.1, 0.9])))
    (out,) = one(spark, ner.decode_ctc(frames, F.array(F.lit(""), F.lit("a"), F.lit("b"))))
    assert out.text == "aab" and out.confidence == pytest.approx((0.8 + 0.6 + 0.9) / 3)
    assert one(spark, actions.raw_types(F.lit("x 4111 1111 1111 1111")))[0] == ["CARD"]


def test_keys_follow_what_is_read(spark):
    def key(value, options):
        e = F.struct(*(F.lit(v).alias(k) for k, v in (("nodeId", "n1"), ("role", "textbox"), ("name", "a"), ("text", ""), ("value", value), ("checked", None), ("disabled", None), ("context", None), ("options", options), ("x", 1.0), ("y", 2.0), ("w", 3.0), ("h", 4.0))))
        return change.observation_key(F.lit("u"), F.lit(1), F.lit(2), F.array(e), F.array().cast("array<string>"))

    a, b, c = one(spark, key("x", "p"), key("x", "q"), key("y", "p"))
    assert a == b != c and a.startswith("1.0.")
