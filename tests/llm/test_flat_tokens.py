import random

import numpy as np
import pytest

from parchmine.llm import flat_tokens as T
from parchmine.llm.common import Workspace


def brute(tokens):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == T.SEPARATOR:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + [(len(out), start, len(tokens) - start, False)] * (start < len(tokens))


@pytest.mark.parametrize("run", [2, 1024])
def test_scan_matches_brute_force(spark, tmp_path, monkeypatch, run):
    monkeypatch.setattr(T, "RUN", run)
    rng = random.Random(run)
    files = {}
    for name, n, p in (("a", 5000, 0.02), ("b", 777, 0.9), ("c", 400, 0), ("d", 1, 1), ("e", 64, 0.001), ("f", 3000, 0.0008)):
        files[name] = [T.SEPARATOR if rng.random() < p else rng.randrange(50000) for _ in range(n)]
        (tmp_path / f"{name}.bin").write_bytes(np.array(files[name], "<u2").tobytes())
    blocks = T.flat_file_blocks(spark, f"file://{tmp_path}", 128)
    got = {}
    for r in T.separator_scan(blocks, Workspace(spark, "t")).collect():
        got.setdefault(r.file.rsplit("/", 1)[1][0], []).append((r.ordinal, r.start, r.n_tokens, r.ended))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(v) for k, v in files.items()}


def test_documents(spark, tmp_path):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|> is text"), (None, "a b"), (1, "hello world"), (6, "long " * 30000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, file string").write.parquet(f"{tmp_path}/documents.parquet")
    enc = T.encoding(T.default_ranks())
    got = sorted(((r.doc_id, r.n_tokens) for r in T.op8_separator_scan(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in rows), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert T.op8_separator_scan(spark, str(tmp_path)).count() == 0


def test_ids_beside_a_null_keep_all_digits(spark, tmp_path):
    ids = [9007199254740993, None, 9007199254740995, -(2**63), 2**63 - 1]
    spark.createDataFrame([(i, "a") for i in ids], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id for r in T.op8_separator_scan(spark, str(tmp_path)).collect()), key=str) == sorted(ids, key=str)
    flat = T.write_flat(spark.createDataFrame([("x", "a b"), (None, "c")], "doc_id string, text string"), Workspace(spark, "t"))
    assert sum((r.ids for r in flat.where("data is null").orderBy("file").collect()), []) in (["x", None], [None, "x"])
