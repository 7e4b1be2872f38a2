import json

import pytest
from pyspark.sql import functions as F

from parchmine.functions import html_tables as H
from parchmine.functions import text as T
from parchmine.operators import markdown as M
from parchmine.operators import ranges, regions, training
from parchmine.sources import files
from parchmine.streaming import progress


@pytest.mark.parametrize("expression,merged", [("1-3,5", "1-3,5"), ("5，1–3、4", "1-5"), ("all", "all"), ("", "all"), ("全文", "all"), ("3-1", None), ("0", None), ("a", None), ("2,2,3", "2-3"), ("7-9,1-20", "1-20")])
def test_page_ranges(spark, expression, merged):
    df = spark.createDataFrame([(expression,)], "e string")
    assert df.select(ranges.ranges_text(ranges.parse_ranges(F.col("e")))).first()[0] == merged


def test_page_set(spark):
    df = spark.createDataFrame([("1-3, 2,9",), ("1-11",), ("x",), ("3-2",)], "e string")
    assert [r[0] for r in df.select(ranges.page_set(F.col("e"), F.lit(10))).collect()] == [[1, 2, 3, 9], None, None, None]


def test_choose_pages(spark):
    docs = spark.createDataFrame([("short", 5, 900, [], "text"), ("found", 200, 200000, [3], "text"), ("toc", 200, 200000, [3], "text"), ("scan", 200, 200000, [], "scanned")], "doc string, page_count long, tokens long, contents array<int>, kind string")
    matches = spark.createDataFrame([("found", 50, 9), ("found", 51, 7), ("found", 120, 8), ("found", 1, 3)], "doc string, page int, score int")
    got = {r.doc: (r.pages, r.strategy) for r in ranges.choose_pages(docs, matches).collect()}
    assert got["short"] == ([1, 2, 3, 4, 5], "short-document-full")
    assert got["found"] == ([1, 2, 49, 50, 51, 52, 119, 120, 121], "native-text-search")
    assert got["toc"] == ([3, 4, 5, 6], "contents-first")
    assert got["scan"][0] == list(range(1, 9))


def test_text_functions(spark):
    assert T.text_key("**Ｆull** [Straße](x) ① !") == "fullstrasse1"
    assert T.similarity("abcd", "bcde") == 0.75 and T.similarity(None, "a") is None
    assert sum(v * v for v in T.hashed_features("some text 目").values()) == pytest.approx(1)
    assert [T.chinese_number(x) for x in ("一", "十", "十二", "二十", "九十九", "十十", "x", None)] == [1, 10, 12, 20, 99, None, None, None]
    assert [T.strict_json_error(x) for x in ('{"a": 1}', '{"a": 1, "a": 2}', "{", "NaN", None)] == [None, "repeated key", "not JSON", "not JSON", "null"]
    assert T.flat_text('[{"content": [{"text": "a  b"}, "c"]}, 3, {"x": 1}]') == "a b c"
    assert T.merge_sequences(list("abd"), list("bcd")) == list("abcd")
    assert T.running_confidence([0.9, 0.95, 0.8]) == round((round((0.9 + 0.95) / 2, 2) * 2 + 0.8) / 3, 2)
    T.register(spark)
    assert spark.sql("select text_key('A b'), similarity('ab', 'ab'), chinese_number('三')").first()[:] == ("ab", 1.0, 3)


def test_tables():
    assert H.table_markdown("<table><tr><th>a<th>b|c</tr><tr><td>1<td>2</table>") == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"
    spans = H.table_markdown("<table><tr><td colspan=2>Title</td></tr><tr><td>x</td><td>y</td></tr><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr><tr><td colspan=2>group</td></tr></table>")
    assert spans == "**Title**\n\n| x | y |\n| --- | --- |\n| r | 1 |\n|  | 2 |\n| **group** |  |"
    assert H.with_markdown_tables("t <table><tr><td>one</td></tr></table>") == "t <table><tr><td>one</td></tr></table>"
    assert "![i](s.png)" in H.with_markdown_tables("<table><tr><td><img src=s.png alt=i></td><td>b</td></tr></table>")


DOC = """# Contents

1 First part ..... 3
1.1 Detail .......... 4
Closing words ..... 9
ISO 9001

# 1 First part

Body.

```
## 1.1 Detail
```

## 1.1 Detail

More.

# Closing words

End."""


def test_navigation_links():
    out = M.link_navigation(DOC)
    assert M.link_navigation(out) == out
    assert "- [1 First part](#1)" in out and "  - [1.1 Detail](#2)" in out and "- [Closing words](#3)" in out
    assert out.count("[↑ Contents](#nav-contents)") == 3
    for line in ("Body.", "More.", "End.", "## 1.1 Detail", "```"):
        assert line in out.split("\n")
    assert M.link_navigation("no list\n# A") == "no list\n# A"
    assert M.link_navigation(None) is None and M.link_navigation("") == ""


def test_entries():
    assert M.parse_entry("Figure 2-1: A thing ..... 12") == ("Figure 2-1: A thing", "12", "2.1", 1)
    assert M.parse_entry("2.3 According to ISO 9001")[1] == ""
    assert M.parse_entry("prose without a page") is None
    assert [M.list_kind(t) for t in ("Table of Contents (continued)", "List of Figures", "目录", "Contents of the box")] == ["contents", "figures", "contents", None]


def test_audit(spark):
    df = spark.createDataFrame([(1, M.link_navigation(DOC)), (2, "text")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in M.audit_navigation(df).collect()}
    assert got == {1: (3, 3, 0, 0, True), 2: (0, 0, 0, 0, True)}


def page(doc, n, *blocks):
    return [(doc, n, i, k, t) for i, (k, t) in enumerate(blocks)]


def test_page_kinds_and_regions(spark):
    index = "\n".join(f"Topic {i} ..... {i}" for i in range(8))
    rows = page("d", 1, ("title", "A book")) + page("d", 2, ("title", "目录 / Contents"), ("index", index)) + page("d", 3, ("index", index)) + page("d", 4, ("title", "Abstract")) + page("d", 5, ("index", index)) + page("d", 6, ("title", "Chapter 1 Start")) + page("d", 7, ("paragraph", "nothing here"))
    df = spark.createDataFrame(rows, "doc string, page long, pos int, type string, text string")
    kinds = regions.classify_pages(df)
    assert [r.kind for r in kinds.orderBy("page").collect()] == ["cover", "contents", "contents", "abstract", "contents", "body_start", "other_front"]
    got = {(r.kind, r.first, r["last"]): r.confidence for r in regions.merge_regions(kinds).collect()}
    assert got["contents", 2, 3] == pytest.approx(0.95, abs=0.011) and ("contents", 5, 5) in got


def test_rules():
    entry = lambda i: f"Topic {i} ..... {i}"
    spaced = [f"Subject {'abcdefgh'[i]} {i + 3}" for i in range(8)]
    assert regions.rule(3, [("index", entry(1) + "\n" + entry(2)), ("paragraph", "x")], None) == ("contents", 0.68, "index without heading")
    assert regions.rule(3, [("index", "\n".join(map(entry, range(8))))], None) == ("contents", 0.92, "dense index")
    assert regions.rule(3, [("index", "\n".join(map(entry, range(8))))], "list_of_tables")[:2] == ("list_of_tables", 0.92)
    assert regions.rule(3, [("title", "Contents"), ("index", entry(1))], None) == ("contents", 0.98, "title")
    assert regions.rule(3, [("page_header", "Contents"), ("list", "\n".join(spaced))], None) == ("contents", 0.95, "page header")
    assert regions.rule(3, [("page_header", "Contents"), ("list", "\n".join(["no page here"] * 3 + spaced[:5]))], None)[2] != "page header"
    assert regions.rule(1, [("paragraph", "A book")], None) == ("other_front", 0.35, "nothing")
    assert regions.rule(1, [("title", "A book")], None) == ("cover", 0.68, "first page")
    assert regions.rule(1, [("title", "A book"), ("paragraph", "x" * 1300)], None)[0] == "other_front"
    assert regions.rule(2, [("paragraph", "a"), ("paragraph", "b"), ("paragraph", "Introduction")], None)[0] == "other_front"
    assert regions.rule(2, [("paragraph", "a"), ("paragraph", "Introduction")], None) == ("body_start", 0.74, "body paragraph")
    assert regions.rule(2, [("paragraph", "a"), ("paragraph", "b"), ("paragraph", "Abstract")], None) == ("abstract", 0.91, "leading keyword")
    assert regions.rule(2, [("title", "Chapter Ten Ends")], None) == ("body_start", 0.9, "body title")
    assert regions.rule(2, [("paragraph", "x")], None, split=True) == ("body_start", 0.94, "split chapter")
    manual = [("title", "手册"), ("title", "一、概述"), ("paragraph", "字" * 31), ("title", "二、安装"), ("paragraph", "字" * 20)]
    assert regions.rule(1, manual, None) == ("body_start", 0.94, "short manual") and regions.rule(2, manual, None)[2] != "short manual"
    assert regions.rule(4, [("index", entry(1) + "\n" + entry(2))], "list_of_figures") == ("list_of_figures", 0.78, "continuation")


def test_mixed_pages_seed_the_next_and_chapters_split(spark):
    rows = page("d", 1, ("title", "Abstract"), ("paragraph", "prose"), ("title", "List of Tables"), ("paragraph", "1 First 3 2 Second 7")) + page("d", 2, ("index", "A thing ..... 9\nB thing ..... 10"))
    df = spark.createDataFrame(rows, "doc string, page long, pos int, type string, text string")
    assert [(r.kind, r.strength) for r in regions.classify_pages(df).orderBy("page").collect()] == [("abstract", 0.97), ("list_of_tables", 0.78)]
    boxes = [("e", 5, 0, "paragraph", "Chapter 1", [0.0, 0.2, 1.0, 0.25], 1.0), ("e", 5, 1, "title", "Start", [0.0, 0.3, 1.0, 0.35], 1.0)]
    df = spark.createDataFrame(boxes, "doc string, page long, pos int, type string, text string, bbox array<double>, height double")
    assert regions.classify_pages(df).first().reason == "split chapter"


def test_cascade_asks_for_evidence(spark):
    rows = [("d", 1, "contents", 0.69, "continuation without entries"), ("d", 2, "contents", 0.78, "continuation"), ("d", 3, "contents", 0.68, "index without heading"), ("d", 4, "body_start", 0.94, "short manual"), ("d", 5, "contents", 0.62, "debris")]
    kinds = spark.createDataFrame(rows, "doc string, page long, kind string, strength double, reason string")
    none = spark.createDataFrame([], "doc string, page long, top string, p1 double, p2 double, ood boolean")
    assert [r.stage for r in regions.cascade(kinds, none, none).orderBy("page").collect()] == ["abstain", "rule", "abstain", "rule", "abstain"]


def test_cascade(spark):
    kinds = spark.createDataFrame([("d", i, k, s, "title" if s > 0.9 else "nothing") for i, (k, s) in enumerate([("abstract", 0.97), ("other_front", 0.35), ("other_front", 0.35), ("other_front", 0.35), ("other_front", 0.35)])], "doc string, page long, kind string, strength double, reason string")
    schema = "doc string, page long, top string, p1 double, p2 double, ood boolean"
    layout = spark.createDataFrame([("d", 1, "legal", 0.9, 0.05, False), ("d", 2, "legal", 0.5, 0.4, False), ("d", 3, "legal", 0.5, 0.4, True)], schema)
    text = spark.createDataFrame([("d", 2, "preface", 0.9, 0.05, False), ("d", 3, "legal", 0.4, 0.3, False)], schema)
    got = [(r.stage, r.kind, r.reason) for r in regions.cascade(kinds, layout, text).orderBy("page").collect()]
    assert got == [("rule", "abstract", "accepted"), ("layout", "legal", "accepted"), ("abstain", None, "conflict"), ("abstain", None, "out of distribution"), ("abstain", None, "no model")]


def test_training(spark):
    rows = [(i, [float(i % 3 == 0) + 0.1 * (i % 7), float(i % 3 == 1)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    model = training.fit_linear(df)
    assert model == training.fit_linear(df) and len(model["fingerprint"]) == 64
    got = {r.id: r for r in training.predict_linear(df, model).collect()}
    assert all(got[i].top == y for i, _, y in rows) and all(r.p1 >= r.p2 >= 0 for r in got.values())


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "a.pdfout").mkdir()
    (tmp_path / "a.pdfout" / "b.pdf").write_bytes(b"x")
    (tmp_path / "a.pdfout" / "a.md").write_text("# t")
    (tmp_path / "c.md").write_text("no")
    found = files.find_pdfs(spark, f"file://{tmp_path}").select("path", "sha256", files.output_folder(F.col("path")).alias("o")).collect()
    assert len(found) == 1 and found[0].o.endswith("/a.pdfout")
    assert [r.text for r in files.find_markdown(spark, f"file://{tmp_path}").collect()] == ["# t"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 1, "a": 2}\nnope\n')
    got = [(r.line, r.error, r.a) for r in files.read_json_lines(spark, f"file://{tmp_path}/x.jsonl", "a int").orderBy("line").collect()]
    assert [g[:2] for g in got] == [(1, None), (3, "repeated key"), (4, "not JSON")] and got[0][2] == 1


def test_content_lists(spark):
    block = {"type": "Title", "content": {"title_content": [{"content": "x"}]}, "bbox": [0, 0, 1, 1]}
    rows = [("list", json.dumps([[block], {"blocks": [block, 3, {"type": "p", "text": "t", "bbox": [3, 0, 1, 1]}]}])), ("dict", json.dumps({"pages": [[block]]})), ("bad", "{"), ("null", None)]
    got = [(r.doc, r.page, r.pos, r.type, r.bbox) for r in files.read_content_lists(spark.createDataFrame(rows, "doc string, json string")).orderBy("doc", "page", "pos").collect()]
    assert got == [("dict", 1, 0, "title", [0, 0, 1, 1]), ("list", 1, 0, "title", [0, 0, 1, 1]), ("list", 2, 0, "title", [0, 0, 1, 1]), ("list", 2, 2, "p", None)]


def test_progress_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"task": t, "value": v}) for t, v in [("a", "10%\r5%\n\x1b[1m3/4 done"), ("b", "no figure"), ("b", "150%")]))
    lines = progress.log_lines(spark.readStream.schema("task string, value string").json(f"file://{source}"))
    query = progress.monotone_progress(lines).writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.processAllAvailable()
    (source / "2.json").write_text(json.dumps({"task": "a", "value": "70%\n80%"}))
    query.processAllAvailable()
    query.stop()
    assert sorted((r.task, r.percent) for r in spark.table("progress").collect()) == [("a", 10.0), ("a", 75.0), ("a", 80.0), ("b", 100.0)]


def test_hashed_features_match_a_token_by_token_sum():
    import hashlib
    import re

    for text in (None, "", "Some text, some TEXT 目录 12", "a" * 9000, "naïve\n\tcafé " * 40):
        compact = re.sub(r"\s+", " ", (text or "").casefold()).strip()[: T.MOST_CHARS]
        framed, sums = f"^{compact}$", {}
        tokens = ["w:" + w for w in re.findall(r"[a-z0-9]+|[㐀-鿿]", compact)[: T.MOST_WORDS]]
        tokens += [f"c{n}:{framed[i : i + n]}" for n in (2, 3, 4, 5) for i in range(len(framed) - n + 1)]
        for t in tokens:
            h = hashlib.blake2b(t.encode(), digest_size=8).digest()
            slot = int.from_bytes(h, "little") % 512
            sums[slot] = sums.get(slot, 0) + (-1 if h[0] % 2 else 1)
        norm = sum(v * v for v in sums.values()) ** 0.5 or 1.0
        assert T.hashed_features(text) == pytest.approx({s: v / norm for s, v in sums.items()})
