"""Removal of repeated byte strings by suffix sorting: sorted suffixes of anchors induce those before them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Workspace, row_key, skew_join, table, text_of

#: Bytes of a repeated string, and of the gram whose hash makes an anchor.
LENGTH, GRAM = 400, 128
#: Groups of more different contexts than this are cut by cells of so many window starts, and again while they are as large.
HOT, WIDTHS = 2000, (39, 6, 1)
#: Suffixes that a task sorts at once, and window starts of a text that are searched at once.
CHUNK, STRETCH = 20_000, 1_000_000
_A, _B = np.array([0x9E3779B97F4A7C15], np.uint64), np.array([0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, length: int, base: np.ndarray = _A) -> np.ndarray:
    """Polynomial hashes modulo 2**64, mixed, of all substrings of so many bytes."""
    power, h, done, out, shift = base, data.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(data) - length + 1
    while True:  # h: hashes of `done` bytes, a power of two
        if length & done:
            part = h[shift : shift + n]
            out = part if out is None else out * power + part
            shift += done
        if done * 2 > length:
            return _mix(out)
        h = h[:-done] * power + h[done:]
        power, done = power * power, done * 2


def anchors(text: bytes) -> list[tuple[int, int, int, int]]:
    """(place, first, last, hash): the windows that start at first..last have their least gram hash at place.

    Equal windows have their anchors at equal offsets and with equal hashes, whatever surrounds them.
    """
    out, wide = [], LENGTH - GRAM + 1
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - LENGTH + 1, STRETCH):
        grams = gram_hashes(data[at : at + STRETCH + LENGTH - 1], GRAM)
        n = len(grams) - wide + 1
        key = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        full = np.append(key, np.full(-len(key) % wide, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, wide)
        before = np.minimum.accumulate(full, axis=1).ravel()
        after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], n) - 1
        out += zip((place[first] + at).tolist(), (first + at).tolist(), (last + at).tolist(), grams[place[first]].view(np.int64).tolist())
    return out


def induced_repeats(group: np.ndarray, context: list[bytes], place: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, first, last): runs of window starts whose windows also start elsewhere, by context.

    Contexts of one group have the same gram at `place`; their windows are those that lie in them. The suffixes that
    start at the anchors are sorted first, with the lengths of common prefixes of neighbours. From the order of the
    suffixes that start o bytes before the anchors, the order for o + 1 is induced: a stable sort by the byte that
    comes before, by which common prefixes grow by one where the bytes agree. A window is repeated if its suffix has
    LENGTH bytes in common with a neighbour. Suffixes that can't get there any more leave.
    """
    size = np.array([len(c) for c in context])
    right = np.minimum(size - place, LENGTH)
    matrix = np.zeros((len(context), LENGTH), np.uint8)
    for i, (c, p) in enumerate(zip(context, place.tolist())):
        tail = c[p : p + LENGTH]
        matrix[i, : len(tail)] = np.frombuffer(tail, np.uint8)
    order = np.lexsort((right, matrix.view(f"S{LENGTH}").ravel(), group))
    differ = matrix[order[:-1]] != matrix[order[1:]]
    common = np.where(differ.any(1), differ.argmax(1), LENGTH)
    common = np.minimum(common, np.minimum(right[order[:-1]], right[order[1:]]))
    common[group[order[:-1]] != group[order[1:]]] = 0
    flat, base = np.frombuffer(b"".join(context), np.uint8), np.cumsum(size) - size
    least = place - (size - LENGTH)  # offset of the last window
    found_context, found_start = [], []
    for o in range(LENGTH):
        beside = np.maximum(np.append(common, 0), np.insert(common, 0, 0)) if len(order) > 1 else np.zeros(len(order), int)
        hit = order[(beside >= LENGTH) & (least[order] <= o) & (o <= place[order])]
        found_context.append(hit)
        found_start.append(place[hit] - o)
        stay = np.flatnonzero((beside + place[order] - o >= LENGTH) & (place[order] > o))
        if len(stay) < 2:
            break
        common = np.minimum.reduceat(common[: stay[-1]], stay[:-1]) if len(stay) < len(order) else common
        order = order[stay]
        byte = flat[base[order] + place[order] - o - 1]
        key = group[order] * 256 + byte
        turn = np.argsort(key, kind="stable")
        a, b = turn[:-1], turn[1:]
        same = key[a] == key[b]
        grown = np.zeros(len(a), np.int64)
        near = same & (b == a + 1)
        grown[near] = common[a[near]] + 1
        far = np.flatnonzero(same & (b > a + 1))
        if len(far):
            ends = np.column_stack([a[far], b[far]]).ravel()
            grown[far] = np.minimum.reduceat(np.append(common, 0), ends)[::2] + 1
        order, common = order[turn], grown
    return _runs(np.concatenate(found_context), np.concatenate(found_start))


def _runs(owner: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(owner):
        return []
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
    last = np.append(new[1:], len(owner)) - 1
    return list(zip(owner[new].tolist(), start[new].tolist(), start[last].tolist()))


def _anchor_rows(batches):
    """For each anchor: k, the first window's start, the anchor's place in the context, the context's size, the gram's hash, and two hashes of the context and place."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            rows, digests = [], []
            for k, text in zip(batch["k"].iloc[at : at + 64], batch["text"].iloc[at : at + 64]):
                data = memoryview((text or "").encode())
                for place, first, last, h in anchors(data):
                    rows.append((k, first, place - first, last + LENGTH - first, h))
                    digests.append(xxhash.xxh3_128_digest(data[first : last + LENGTH], place - first))
            out = pd.DataFrame(rows, columns=["k", "first", "place", "size", "g"])
            yield out.assign(**_pair(digests))


def _pair(digests: list[bytes]) -> dict[str, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return {"c1": both[:, 0], "c2": both[:, 1]}


def _contexts(batches):
    """The bytes of each run of windows: k, g, hot, place (in the context), first, context. Repeated rows come next to each other and are read once."""
    before = None
    for batch in batches:
        for at in range(0, len(batch), 64):
            rows = []
            for k, text, runs in zip(*(batch[c].iloc[at : at + 64] for c in ("k", "text", "runs"))):
                if k != before:
                    data, before = (text or "").encode(), k
                    rows += [(k, r["g"], r["hot"], r["place"], r["first"], data[r["first"] : r["first"] + r["size"]]) for r in runs]
            yield pd.DataFrame(rows, columns=["k", "g", "hot", "place", "first", "context"])


def cells(place: int, context: bytes, width: int) -> list[tuple[int, int, int, int, bytes]]:
    """A context cut by cells of the distance from a window's start to the anchor: (cell, start, end, place, core).

    Windows of one cell have `core` in common, so windows that are equal lie in the same cell and have equal cores.
    """
    out, low = [], place - (len(context) - LENGTH)
    for cell in range(low // width, place // width + 1):
        near, far = max(low, cell * width), min(place, cell * width + width - 1)
        core = context[place - cell * width : place - cell * width - width + 1 + LENGTH]
        out.append((cell, place - far, place - near + LENGTH, far, core))
    return out


def _split(width: int):
    def split(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows, digests = [], []
                for k, g, place, first, context in zip(*(batch[c].iloc[at : at + 500] for c in ("k", "g", "place", "first", "context"))):
                    context = bytes(context)
                    for cell, start, end, there, core in cells(place, context, width):
                        part = context[start:end]
                        group = xxhash.xxh3_64_intdigest(core, (g + cell) & 0xFFFFFFFFFFFFFFFF)
                        rows.append((k, first + start, there, len(part), group - (1 << 64) if group >> 63 else group, part))
                        digests.append(xxhash.xxh3_128_digest(part, there))
                yield pd.DataFrame(rows, columns=["k", "first", "place", "size", "g", "context"]).assign(**_pair(digests))

    return split


def _sorted_groups(batches):
    """Repeats among the contexts of a task, which come sorted by anchor, a bounded number of groups at a time."""

    def repeats(df: pd.DataFrame) -> pd.DataFrame:
        group = np.unique(df["g"].to_numpy(), return_inverse=True)[1]
        found = induced_repeats(group, df["context"].tolist(), df["place"].to_numpy())
        k, first = df["k"].to_numpy(), df["first"].to_numpy()
        return pd.DataFrame([(k[i], first[i] + a, first[i] + b + LENGTH) for i, a, b in found], columns=["k", "start", "end"]).astype({"start": "int64", "end": "int64"})

    held = None
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            held = part if held is None or not len(held) else pd.concat([held, part])
            if len(held) >= CHUNK:
                g = held["g"].to_numpy()
                whole = g != g[-1]  # the last group may go on
                if whole.any():
                    yield repeats(held[whole])
                    held = held[~whole]
    if held is not None and len(held):
        yield repeats(held)


def _alike(work: Workspace, found: DataFrame, hot: int, drop: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of the contexts found (k, first, place, size, g, c1, c2, ...): the spans of those that are equal throughout to
    another, and one context of each kind in groups that have several, marked hot if they have more than `hot`.
    """
    names = [c for c in found.columns if c not in ("c1", "c2")]
    often = work.write(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    hits = work.write(skew_join(found, often, ["g"], "n").drop("n"))
    if drop:
        work.drop(found)
    mark = F.xxhash64("k", "first")  # of equal contexts the one with the least mark stands for all
    kinds = work.write(hits.groupBy("g", "c1", "c2").agg(F.count("*").alias("n"), F.min(mark).alias("least")))
    groups = work.write(kinds.groupBy("g").agg(F.count("*").alias("m")))
    kinds = work.write(skew_join(kinds, groups, ["g"], "m").select(F.col("g").alias("kind_g"), "c1", "c2", "n", "least", "m"))
    told = skew_join(hits, kinds, ["c1", "c2"], "n").where("g = kind_g").withColumn("alone", (F.col("m") > 1) & (mark == F.col("least")))
    told = work.write(told.where("n > 1 or alone").select(*names, "n", "alone", (F.col("m") > hot).alias("hot")))
    for used in (often, hits, groups, kinds):
        work.drop(used)
    return told.where("n > 1").select("k", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("end")), told.where("alone").drop("n", "alone")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """k (see row_key) and spans (start, end), not yet united: the bytes covered by strings that also start elsewhere."""
    work = Workspace(docs.sparkSession, "suffixes")
    texts = docs.select(row_key().alias("k"), text_of().alias("text")).where(F.octet_length("text") >= LENGTH)
    row = "k binary, first long, place int, size int, g long, c1 long, c2 long"
    found = work.write(texts.mapInPandas(_anchor_rows, row))
    equal, rest = _alike(work, found, hot)
    spans = [equal]
    runs = rest.groupBy("k").agg(F.collect_list(F.struct("g", "hot", "place", "first", "size")).alias("runs"))  # of one text each
    contexts = work.write(texts.join(runs.hint("merge"), "k").mapInPandas(_contexts, "k binary, g long, hot boolean, place int, first long, context binary"))
    n = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for width in (*WIDTHS, None):
        cold = contexts.where("not hot").select("k", "g", "place", "first", "context").repartition(n, "g").sortWithinPartitions("g")
        spans.append(work.write(cold.mapInPandas(_sorted_groups, "k binary, start long, end long")))
        large = contexts.where("hot")
        if width is None or not large.limit(1).count():
            break
        parts = work.write(large.mapInPandas(_split(width), row + ", context binary"))
        equal, contexts = _alike(work, parts, hot)
        spans.append(equal)
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


DIGEST = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType()), StructField("n_kept", LongType()), StructField("kept_text", StringType())])


def union_of(spans) -> list[tuple[int, int]]:
    """Sorted (start, end) spans with those joined that overlap or touch."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def kept_bytes(text: str | None, spans) -> bytes:
    data, at, parts = (text or "").encode(), 0, []
    for a, b in union_of(spans):
        parts.append(data[at:a])
        at = b
    return b"".join(parts) + data[at:]


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept_text of every row of docs (doc_id, text, ...).

    Texts are bytes in UTF-8; a null text is empty. Texts under 400 bytes lose nothing. Repeated rows repeat each
    other, so all of their bytes go; ids may be null. Other columns aren't read, whatever their names. kept_text is
    the remaining bytes as text, with U+FFFD where a cut has left a part of a character; the digest is of the bytes.
    """
    spans = Workspace(docs.sparkSession, "spans").write(repeated_spans(docs, hot))

    @pandas_udf(DIGEST)
    def digests(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans):
            joined = union_of([(x["start"], x["end"]) for x in s]) if s is not None else []
            kept = kept_bytes(t, joined)
            rows.append((sum(b - a for a, b in joined), len(joined), hashlib.sha256(kept).hexdigest(), len(kept), kept.decode(errors="replace") if joined else t))
        return pd.DataFrame(rows, columns=DIGEST.names)

    rows = docs.select("doc_id", text_of().alias("text")).withColumn("k", row_key()).join(spans.hint("merge"), "k", "left")
    out = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digests("text", "spans").alias("d"))
    return out.select("doc_id", "n_bytes", "d.*")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() over all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))
