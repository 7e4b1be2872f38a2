import random

import corpus_pipeline as C
from parchmine.llm.common import Workspace


def documents(spark):
    rng = random.Random(8)
    words = "people water little number sound place years live back give most very after thing name good sentence great think help through much before line right mean same tell follow came want show also around form three small".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(120) + "\n" + say(30), "en", f"s{i % 3}", 0) for i in range(60)]
    copy = rows[5][1].split(" ")
    copy[50] = "changed"
    rows += [(100, rows[3][1], "en", "s0", 0), (101, " ".join(copy), "en", "s1", 0), (102, None, None, None, None), (103, "", "en", "s1", 0), (104, "spam " * 300, "en", "s1", 0), (None, say(90), "en", "s2", 0), (7, rows[7][1], "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, rows = docs.columns, {}
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        if i < 4:
            assert docs.columns == columns
        rows[i] = docs.collect()
    assert {r.doc_id for r in rows[0]} == {*range(60), 100, 101, None}
    text = {r.doc_id: r.text for r in rows[1]}
    assert text[100] == "" and text[3] and text[101] == "" and text[5]
    assert len(rows[1]) == len(rows[0])
    ids = [r.doc_id for r in rows[2]]
    assert sorted(ids, key=str) == sorted([*range(60), 100, None], key=str)
    assert {r.doc_id for r in rows[3]} == set(ids) and len(rows[3]) >= len(ids)
    assert len(rows[4]) == len(rows[3])
    assert sorted(map(tuple, C.run(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, rows[4]), key=str)


def test_clashing_columns_and_repeated_ids(spark, tmp_path):
    docs = documents(spark)
    for name in ("quality_kept", "quality_rules", "a.b", "k", "fp", "document"):
        docs = docs.withColumn(name, docs["doc_id"] * 2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in C.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r[n] == (None if r.doc_id is None else 2 * r.doc_id) for r in out.collect() for n in ("quality_kept", "a.b", "k", "fp", "document"))


def test_near_duplicates_keep_one_row_of_each_component(spark):
    one, two, three = ("alpha beta gamma " * 30, "delta epsilon zeta eta " * 30, "theta iota kappa lambda mu " * 30)
    rows = [(1, one), (1, two), (2, one), (None, two), (None, three), (None, three), (5, ""), (6, None)]
    got = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, one), (1, two), (None, three), (5, "")], key=str)
    assert C.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_near_duplicates_broadcast_only_what_they_ask_for(spark, monkeypatch):
    """Whatever size Spark guesses: what grows with the documents isn't gathered by the driver."""
    rows = [(i, f"alpha beta {i} gamma {i % 7} delta") for i in range(60)]
    docs, write, plans, name = spark.createDataFrame(rows, "doc_id long, text string"), Workspace.write, [], "spark.sql.autoBroadcastJoinThreshold"
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    monkeypatch.setattr(Workspace, "write", lambda self, df: plans.append(joins(df)) or write(self, df))
    before, counts = spark.conf.get(name), []
    try:
        for threshold in ("1g", "-1"):
            spark.conf.set(name, threshold)
            plans.clear()
            counts.append([joins(C.near_duplicates(spark, docs, "")), *plans])
    finally:
        spark.conf.set(name, before)
    assert counts[0] == counts[1]
