"""Scalar columns and filters, table by table."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordloom.functions import columns as C
from recordloom.functions.filters import ScanFilter, checked_distance
from recordloom.functions.fingerprints import band, hamming_distance, quick_signature, sign_bits, simhash
from recordloom.sources import inventory as source


def values(spark, column, rows, schema):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def test_names(spark):
    paths = [("/a/b.TXT",), ("/a/.bashrc",), ("/a/x.tar.gz",), ("/a/name.",), ("/a/none",), ("top",), ("/a/.x.y",)]
    assert values(spark, C.extension(F.col("p")), paths, "p string") == [".txt", "", ".gz", "", "", "", ".y"]
    assert values(spark, C.stem(C.file_name(F.col("p"))), paths, "p string") == ["b", ".bashrc", "x.tar", "name.", "none", "top", ".x"]
    assert values(spark, C.parent(F.col("p")), paths[:1], "p string") == ["/a"]


def test_normalize_extension(spark):
    texts = [None, "", "  ", "JPG", " .Png ", "tar.gz"]
    want = ["", "", "", ".jpg", ".png", ".tar.gz"]
    assert values(spark, C.normalize_extension(F.col("t")), [(t,) for t in texts], "t string") == want
    assert C.normalized_extensions(texts) == [w for w in want if w]


def test_every_extension_has_its_category(spark):
    cases = [(e, c) for c, own in C.CATEGORY_EXTENSIONS.items() for e in own] + [(".tif", "other"), ("", "other")]
    assert len(cases) == 58
    assert values(spark, C.classify(F.col("e")), [(e,) for e, _ in cases], "e string") == [c for _, c in cases]
    folders = ["Images", "Videos", "Audio", "Documents", "Other", "Other", "Other"]
    assert values(spark, C.folder_name(F.col("c")), [(c,) for c in C.FOLDERS], "c string") == folders


def test_seasons(spark):
    want = ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]
    assert values(spark, C.season(F.col("m")), [(m,) for m in range(1, 13)], "m int") == want
    for month in (0, 13):
        with pytest.raises(PySparkException, match="Invalid month"):
            values(spark, C.season(F.col("m")), [(month,)], "m int")


def test_size_text(spark):
    sizes = {0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1.00 KB", 1536: "1.50 KB", 1 << 20: "1.00 MB", 5 << 20: "5.00 MB", 1 << 30: "1.00 GB", 3 << 30: "3.00 GB", 1 << 40: "1.00 TB", 2048 << 50: "2048.00 PB"}
    assert values(spark, C.format_size(F.col("s")), [(s,) for s in sizes], "s long") == list(sizes.values())


def test_paths(spark):
    assert values(spark, C.relative_path(F.col("p"), "/r/"), [("/r/a/b",), ("/rx/a/b",), ("/r",)], "p string") == ["a/b", "b", "r"]
    rows = [("/r/a", "/r"), ("/r", "/r/"), ("/rx", "/r"), ("/r/./a//b/", "/r/a")]
    assert values(spark, C.is_sub_path(F.col("p"), F.col("q")), rows, "p string, q string") == [True, True, False, True]
    assert values(spark, C.numbered_name(F.col("n"), F.col("k")), [("a.tar.gz", 0), ("a.tar.gz", 2), (".x", 1)], "n string, k int") == ["a.tar.gz", "a.tar (2).gz", ".x (1)"]


def test_destination_takes_the_declared_zone(spark):
    time = datetime(2024, 3, 1, 2, tzinfo=timezone.utc)
    at = F.lit(time)
    rows = [("image",)]
    assert values(spark, C.destination_folder("/t", F.col("c"), at), rows, "c string") == ["/t/Images/2024/03"]
    assert values(spark, C.destination_folder("/t", F.col("c"), at, "America/New_York"), rows, "c string") == ["/t/Images/2024/02"]


def test_error_message(spark):
    message = C.error_message("Failed", F.col("p"), {"b": F.lit(2), "a": F.lit("x")}, F.col("e"))
    assert values(spark, message, [("/p", "boom"), ("/p", None)], "p string, e string") == ["Failed (path='/p', a='x', b=2): boom", "Failed (path='/p', a='x', b=2)"]
    texts = ["plain", "it's", 'both \' and "', "back\\slash", "two\nlines", None]
    shown = values(spark, C.error_message("Op", None, {"v": F.col("t")}), [(t,) for t in texts], "t string")
    assert shown == [f"Op (v={t!r})" for t in texts]
    assert values(spark, C.error_message("Op", None, {"v": F.col("b")}), [(True,)], "b boolean") == ["Op (v=True)"]


def test_size_ties_round_to_even(spark):
    sizes = [*range(1024, 4096), *range(1 << 20, (1 << 20) + 3000), 1152, 1157627904, (1 << 50) + (1 << 47), (1 << 63) - 1]

    def text(n):
        for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), start=1):
            if n < 1024 ** (k + 1) or unit == "PB":
                return f"{n / 1024**k:.2f} {unit}"

    assert values(spark, C.format_size(F.col("n")), [(n,) for n in sizes], "n long") == [text(n) for n in sizes]
    assert values(spark, C.error_message("Failed"), [("x",)], "p string") == ["Failed"]


def record(path, size=100, time=datetime(2024, 1, 1, tzinfo=timezone.utc)):
    return path, size, time


def scanned(spark, rows, options, **more):
    frame = spark.createDataFrame(rows, "full_path string, size_bytes long, last_write_utc timestamp")
    frame = frame.withColumn("extension", C.extension(F.col("full_path"))).withColumn("category", C.classify(F.col("extension")))
    return sorted(r.full_path for r in source.scan(frame, options, **more).collect())


@pytest.mark.parametrize(
    ("name", "include", "exclude", "kept"),
    [("a.jpg", [".jpg"], [], True), ("a.png", [".jpg"], [], False), ("a.jpg", [".jpg"], [".jpg"], False), ("a.txt", [], [".jpg"], True), ("A.JPG", ["jpg"], [], True), ("a", [".jpg"], [], False)],
)
def test_extension_filter(spark, name, include, exclude, kept):
    assert bool(scanned(spark, [record(f"/d/{name}")], ScanFilter(include, exclude))) == kept


def test_bounds_are_inclusive(spark):
    sizes = [1, 128, 1024, 4096, 1 << 20, 2 << 20, 8 << 20]
    rows = [record(f"/d/{s}", s) for s in sizes]
    assert scanned(spark, rows, ScanFilter(min_size=1024, max_size=2 << 20)) == sorted(f"/d/{s}" for s in sizes if 1024 <= s <= 2 << 20)
    middle = datetime(2024, 5, 1, tzinfo=timezone.utc)
    rows = [record(f"/d/{k}", 1, middle + timedelta(days=k)) for k in (-10, -2, -1, 0, 1, 2, 10)]
    kept = scanned(spark, rows, ScanFilter(from_utc=middle - timedelta(days=2), to_utc=middle + timedelta(days=2)))
    assert kept == sorted(f"/d/{k}" for k in (-2, -1, 0, 1, 2))


def test_hidden_and_reserved(spark):
    rows = [record(p) for p in ("/d/.hidden", "/.dir/seen", "/d/.RecordLoom/x", "/duplicates_quarantine/y", "/d/z")]
    assert scanned(spark, rows, ScanFilter()) == ["/.dir/seen", "/d/z"]
    assert scanned(spark, rows, ScanFilter(exclude_hidden=False)) == ["/.dir/seen", "/d/.hidden", "/d/z"]


def test_distances_are_checked():
    assert [checked_distance(d) for d in range(65)] == list(range(65))
    for wrong in (-10, -1, 65, 120, "abc", object(), None, True, 1.5):
        with pytest.raises(ValueError):
            checked_distance(wrong)


def test_bits(spark):
    rows = [(0, 0), (-1, 0), (5, 6), (-(1 << 63), 0)]
    assert values(spark, hamming_distance(F.col("a"), F.col("b")), rows, "a long, b long") == [0, 64, 2, 1]
    assert [values(spark, band(F.col("a"), k), [(-1 ^ 0xFFFF,)], "a long")[0] for k in range(4)] == [0, 65535, 65535, 65535]
    assert values(spark, sign_bits(F.col("v")), [([1.0, -1.0, 0.5],), ([-1.0] * 63 + [1.0],)], "v array<double>") == [5, -(1 << 63)]


def test_simhash_and_signature(spark):
    rows = spark.createDataFrame([("a", "x y z"), ("b", "X  y z"), ("c", ""), ("d", None)], "k string, t string")
    found = {r.k: r.fp for r in simhash(rows, "k", "t").collect()}
    assert set(found) == {"a", "b"} and found["a"] == found["b"]
    big = "x" * (3 << 20)
    texts = [("",), ("abc",), (big,), (big[:-1] + "y",), (big[:1_600_000] + "z" + big[1_600_001:],)]
    marks = values(spark, quick_signature(F.col("t")), texts, "t string")
    assert marks[0] == "empty" and len(set(marks)) == 5
