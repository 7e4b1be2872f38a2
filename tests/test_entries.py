import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from parchmine.functions import entries as E
from parchmine.sources import archives as A


def test_headings():
    got = [E.prefix_and_body(x) for x in ("1.2 Title", "Chapter 3: The end", "A.1 More", "A word", "第二章 绪论", "十二、附则", "**Plain**", None)]
    assert got == [("1.2", "Title"), ("3", "The end"), ("A.1", "More"), ("", "A word"), ("2", "绪论"), ("12", "附则"), ("", "Plain"), ("", "")]


def test_wrapped_lines():
    assert E.unwrapped(["1 A long ti-", "tle that wraps 12", "2 Next", "goes on 1 3", "", "References x i v"]) == ["1 A long title that wraps 12", "2 Next goes on 13", "References xiv"]


def test_cut_entries():
    assert E.cut_entries("1 Start 3 2 Middle part 14 References 20") == ["1 Start 3", "2 Middle part 14", "References 20"]
    assert E.cut_entries("1 Start and no more") == [] and E.cut_entries(None) == [] and E.cut_entries("plain prose 4") == []


def test_short_manual():
    page = [("title", "说明书"), ("title", "一、概述"), ("paragraph", "字" * 35), ("title", "二、使用"), ("paragraph", "字" * 20)]
    assert E.short_manual(page)
    assert not E.short_manual(page[1:]) and not E.short_manual(page[:3]) and not E.short_manual([])


def test_repair():
    assert E.repaired("a�c d�", "abc de") == "abc de"
    assert E.repaired("a�", "xyz") == "a�" and E.repaired(None, "a") is None and E.repaired("abc", "xyz") == "abc"


def test_columns(spark):
    df = spark.createDataFrame([("/ABCDEF+Arial-Identity-H", "1 a", ["go", "on"])], "f string, h string, l array<string>")
    r = df.select(E.font_key(F.col("f")).alias("f"), E.prefix_and_body_of("h").alias("h"), E.unwrapped_of("l").alias("l")).first()
    assert (r.f, r.h.prefix, r.l) == ("arial", "1", ["go on"])
    assert E.unwrapped(["x", "y"]) == ["x", "y"]  # a Roman numeral ends an entry
    kind = "array<struct<type:string,text:string,bbox:array<double>>>"
    pages = spark.createDataFrame([(1, [("paragraph", "Chapter 1", [0.0, 0.2, 1.0, 0.25]), ("title", "Start", [0.0, 0.3, 1.0, 0.35])]), (2, [("paragraph", "Chapter 1", [0.0, 0.6, 1.0, 0.65]), ("title", "Start", [0.0, 0.7, 1.0, 0.75])]), (3, [])], f"id int, b {kind}")
    assert [x[0] for x in pages.orderBy("id").select(E.split_chapter(F.col("b"), F.lit(1.0))).collect()] == [True, False, False]


def test_archives(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b.md", "text")
        z.writestr("../evil", "x")
    got = {(r.member, r.error) for r in A.zip_members(spark.createDataFrame([("z", out.getvalue()), ("n", b"no")], "path string, content binary")).collect()}
    assert got == {("a/b.md", None), ("../evil", "leaves the root"), (None, "not an archive")}
    names = spark.createDataFrame([(x,) for x in ("a/b", "/a", "../a", "a/../../b", "C:x", "a\\b", "")], "n string")
    assert [r[0] for r in names.select(A.safe_member(F.col("n"))).collect()] == [True] + [False] * 6
    arrays = {"w": np.arange(6.0).reshape(2, 3), "b": np.zeros(2)}
    assert A.array_bytes(arrays) == A.array_bytes(dict(reversed(arrays.items())))
    (tmp_path / "m.npz").write_bytes(A.array_bytes(arrays))
    assert (A.read_arrays(spark, f"file://{tmp_path}/m.npz")["w"] == arrays["w"]).all()


def test_made_pages(spark):
    pages = A.made_pages(spark, 8)
    assert pages.count() == 6 * 14 + 2 * 5
    assert sorted(map(tuple, pages.collect())) == sorted(map(tuple, A.made_pages(spark, 8).collect()))
