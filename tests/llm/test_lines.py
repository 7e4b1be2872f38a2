import random

import pytest

from parchmine.llm import lines as L


def brute(rows):
    places = sorted((d is None, d or 0, pos, x.strip(L.SPACES), i) for i, (d, t) in enumerate(rows) for pos, x in enumerate((t or "").split("\n")) if x.strip(L.SPACES))
    texts = sorted({p[3] for p in places})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if len(a) >= L.SHINGLE and len(b) >= L.SHINGLE and L.similar(a, b):
                root[find(a)] = find(b)
    kept, out = {}, {}
    for none, d, pos, x, i in places:
        first = kept.setdefault(find(x), (i, pos))
        if first != (i, pos):
            out.setdefault(i, set()).add(pos)
    return [None if t is None else "\n".join(x for pos, x in enumerate(t.split("\n")) if pos not in out.get(i, ())) for i, (d, t) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    words = [a + b for a in ("al", "be", "cor", "dun", "esk") for b in ("on", "ar", "ith", "us")]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(60)]
    rows = [(1000, None), (1001, ""), (1002, "\n \n"), (1003, "short\nshort\n short\t\n" + base[0]), (None, base[0] + "\n" + base[1])]
    for d in range(80):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            w = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("block", [2, 256])
def test_dedup_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "FEW", 3 if block == 2 else 24)
    rows = corpus(block)
    df = spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, k string, `a.b` int")
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    got = {r["a.b"]: r["text"] for r in out.collect()}
    want = brute(rows)
    assert sum(got[i] != w for i, w in enumerate(want)) <= 1  # banding may miss a link in a few hundred
    assert sum(w != t for w, (_, t) in zip(want, rows)) > 40


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one line of text\nb"), (1, "one line of text\nb"), (2, "one line of text")], "doc_id long, text string")
    assert sorted(r.text for r in L.dedup_lines(df).collect()) == ["", "one line of text\nb", "one line of text\nb"]
    assert L.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 100])
def test_similar_across_matches_pairs(monkeypatch, few):
    monkeypatch.setattr(L, "FEW", few)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(80)) for _ in range(4)]
    lines = []
    for _ in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(80)] = rng.choice("xyz")
        lines.append("".join(t))
    part, block = [rng.randrange(30) for _ in lines], [rng.randrange(2) for _ in lines]
    for own in (True, False):
        def joined(pairs):
            label = list(part)
            for i, j in pairs:
                label = [label[i] if x == label[j] else x for x in label]
            return [label.index(x) for x in label]
        brute = [(i, j) for i in range(60) for j in range(i) if (block[i] == block[j]) == own and L.similar(lines[i], lines[j])]
        assert joined(L.similar_across(L.HashedLines(lines), list(range(60)), part, block, own, L.Labels())) == joined(brute)


def test_recall_of_bands_at_the_threshold():
    """Of pairs with a similarity of 0.80 to 0.84, at any length, 0.99 or more share a band."""
    rng = random.Random(11)
    for size in (30, 80, 200, 600, 3000):
        near = []
        while len(near) < 400:
            a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))
            b = list(a)
            for _ in range(max(1, round(size * 0.011 * rng.random() + 0.3))):
                b[rng.randrange(size if size > 60 else 8)] = "#"
            x, y = L.shingles(a), L.shingles("".join(b))
            if 0.8 <= len(x & y) / len(x | y) < 0.84:
                near.append((a, "".join(b)))
        ka, kb = (L.band_keys(list(side)) for side in zip(*near))
        assert (ka == kb).any(1).mean() >= 0.99, size


def test_queries_columns_match_brute_force(spark, tmp_path):
    rows = corpus(5)
    spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in L.op9_line_dedup(spark, str(tmp_path)).collect()}
    wrong = 0
    for (d, t), w in zip(rows, brute(rows)):
        r, lines = got[d], (t or "").split("\n")
        assert r.n_lines == sum(x.strip(L.SPACES) != "" for x in lines) and r.n_dropped == len(r.dropped_lines)
        wrong += "\n".join(x for i, x in enumerate(lines) if i not in r.dropped_lines) != (w or "")
    assert wrong <= 1


def test_shared_keys_over_any_batches():
    rng = random.Random(8)
    rows = sorted(((rng.randrange(-20, 20), rng.randrange(4)) for _ in range(300)), key=lambda r: r[0])
    nodes = {}
    for k, n in rows:
        nodes.setdefault(k, set()).add(n)
    want = sorted((k, n) for k, ns in nodes.items() if len(ns) > 1 for n in ns)
    for step in (1, 2, 7, 1000):
        batches = [L.pa.RecordBatch.from_arrays([L.pa.array(c) for c in zip(*rows[i : i + step])], ["key", "node"]) for i in range(0, 300, step)]
        got = list(zip(*(sum((b.column(c).to_pylist() for b in L._shared_keys(iter(batches))), []) for c in range(3))))
        assert sorted({g[:2] for g in got}) == want
        assert len({(k, r) for k, _, r in got}) == len({k for k, _ in want}) and all(r in nodes[k] for k, _, r in got)


def test_exact_hashes_tell_shingles_apart():
    rng = random.Random(3)
    for letters in ("abc", "abcdefghäöü€", "".join(map(chr, range(300, 500)))):
        lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(9, 200))) for _ in range(50)]
        hashed = L.HashedLines(lines)
        assert hashed.exact == (len(set("".join(lines))) < 128)
        assert all(len(hashed.all(i)) == len(L.shingles(x)) for i, x in enumerate(lines))
        assert all(len(hashed.all(i) & hashed.all(j)) == len(L.shingles(lines[i]) & L.shingles(lines[j])) for i in range(50) for j in range(i))


@pytest.mark.parametrize("lookups", [1, 1 << 18])
def test_pairs_at_once_match_pairs(monkeypatch, lookups):
    monkeypatch.setattr(L, "LOOKUPS", lookups)
    monkeypatch.setattr(L, "PAIRED", 30)
    rng = random.Random(lookups)
    for letters in ("abcdefgh ", "".join(map(chr, range(300, 500)))):
        base = ["".join(rng.choice(letters) for _ in range(size)) for size in (9, 40, 80, 300)]
        lines = [b[: rng.randrange(9, len(b) + 1)] if rng.random() < 0.3 else b[:-1] + rng.choice("xyz") for b in rng.choices(base, k=60)]
        hashed = L.HashedLines(lines)
        pairs = [(i, j) for i in range(60) for j in range(60)]
        assert hashed.similar_pairs(*L.np.array(pairs).T).tolist() == [L.similar(lines[i], lines[j]) for i, j in pairs]
        member, group = L.np.array(rng.sample(range(60), 55)), L.np.repeat([0, 1, 2, 3], [2, 18, 4, 31])
        block, own = L.np.array(rng.choices((0, 1), k=55)), L.np.isin(group, (1, 2))
        got = L.similar_in_pairs(hashed, member, list(range(60)), block, group, own, L.Labels())

        def joined(links):
            label = list(range(60))
            for i, j in links:
                label = [label[i] if x == label[j] else x for x in label]
            return [label.index(x) for x in label]

        near = lambda i, j: group[i] == group[j] < 3 and (block[i] == block[j]) == own[i] and L.similar(lines[member[i]], lines[member[j]])
        assert joined(got) == joined([(member[i], member[j]) for i in range(55) for j in range(i) if near(i, j)])
        assert len(got) > 5


def test_hashes_that_agree_but_for_their_last_bits():
    hashed = L.HashedLines(["abcdefghi", "bcdefghij", "abcdefghi"])
    hashed.hashes[[0, 9, 18]] = [8, 9, 8]
    assert hashed.similar_pairs(L.np.array([0, 0, 1]), L.np.array([1, 2, 2])).tolist() == [False, True, False]
