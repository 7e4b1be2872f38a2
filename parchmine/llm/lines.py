"""Fuzzy line deduplication by MinHash."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from .common import HEAVY, Workspace, row_key, skew_join, table, text_of
from .components import connected_components

#: Characters of a shingle, rows of a band, bands, and the least Jaccard similarity of linked lines. A pair at the
#: threshold shares a band with probability 1 - (1 - 0.8 ** 3) ** 9 = 0.998.
SHINGLE, ROWS, BANDS, THRESHOLD = 9, 3, 9, 0.8
#: Lines of a bucket that one group of the second round compares with as many others, and lines that it takes at once.
BLOCK, CHUNK = 1000, 4000
#: Larger buckets have all lines held against the first before the rest is compared; larger groups are compared by posting lists.
FEW, PAIRED = 24, 128
#: Shingles that are looked up at once.
LOOKUPS = 1 << 18
SPACES = " \t\n\v\f\r"
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(lines: list[str], exact: bool = False) -> tuple[np.ndarray, np.ndarray, bool]:
    """A hash for each place of the joined lines, of the shingle that starts there, the lengths of the lines, and
    whether different shingles have different hashes.

    Every line has SHINGLE or more characters; at the last SHINGLE - 1 places of each the hash is the largest number.
    With exact, characters are numbered anew where these lines have up to 127 different ones, so that a shingle fits
    into 63 bits; such hashes compare only with each other.
    """
    joined = "".join(lines)
    points = np.frombuffer(joined.encode("latin-1" if joined.isascii() else "utf-32-le"), np.uint8 if joined.isascii() else np.uint32)
    if exact and not joined.isascii():
        there = np.zeros(points.max() + 1, bool)
        there[points] = True
        exact = there.sum() < 128
        points = np.cumsum(there)[points] - 1 if exact else points
    points = points.astype(np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    base = np.array([128], np.uint64) if exact else _MIX[:1]
    h, power, done = points, base, 1
    while done * 2 <= SHINGLE:  # h: hashes of `done` characters
        h = h[:-done] * power + h[done:]
        power, done = power * power, done * 2
    for i in range(done, SHINGLE):
        h = h[:-1] * base + points[i:]
    out = np.empty(len(points), np.uint64)
    out[: len(h)] = _mix(h)
    out[(np.cumsum(lengths)[:, None] - np.arange(1, SHINGLE)).ravel()] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return out, lengths, exact


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys of one-permutation MinHash signatures of character shingles; every line has SHINGLE or more characters."""
    k = ROWS * BANDS
    h, lengths, _ = shingle_hashes(lines)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(len(lines) * k, empty)
    slot = ((h >> np.uint64(40)) * np.uint64(k) >> np.uint64(24)).astype(np.int64) + np.repeat(np.arange(len(lines)) * k, lengths)
    np.minimum.at(sig, slot, h)
    sig = sig.reshape(-1, k)
    full, need = sig != empty, sig == empty
    rng = np.random.default_rng(7)
    while need.any():  # an empty bin takes the value of a bin that a fixed order of tries leads to first
        source = rng.integers(0, k, k)
        take = need & full[:, source]
        sig = np.where(take, _mix(sig[:, source] + np.arange(k, dtype=np.uint64)), sig)
        need &= ~take
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * _MIX[0] + sig[:, r::ROWS][:, :BANDS] + np.arange(BANDS, dtype=np.uint64))
    return keys


class HashedLines:
    """Lines with hashes of their shingles: as many are shared as shingles are, or more if hashes collide, which only inexact ones can."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.hashes, lengths, self.exact = shingle_hashes(lines, True) if lines else (np.empty(0, np.uint64), np.empty(0, np.int64), True)
        self.stop = np.cumsum(lengths)
        self.lengths = lengths
        self.start = (self.stop - lengths).tolist()
        self.stop = (self.stop - SHINGLE + 1).tolist()
        self.whole: dict[int, set[int]] = {}

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Each line's different hashes, sorted, as line << shift plus the hash without its last bits, or, where that
        makes two of them equal, plus its number; where each line's begin; and shift."""
        n, there = len(self.lines), np.ones(len(self.hashes), bool)
        there[(np.cumsum(self.lengths)[:, None] - np.arange(1, SHINGLE)).ravel()] = False
        value, bits = self.hashes[there], np.uint64((n + 1).bit_length())
        kinds = np.sort(value)
        kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])]
        if (kinds[1:] >> bits == kinds[:-1] >> bits).any():
            value = np.searchsorted(kinds, value).astype(np.uint64)
        else:
            value >>= bits
        shift = np.uint64(64) - bits
        keys = np.sort((np.repeat(np.arange(n, dtype=np.uint64), self.lengths - SHINGLE + 1) << shift) + value)
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
        return keys, np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << shift), shift

    def similar_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """similar() of pairs of lines: the shingles of the shorter line are looked up in the other, a bounded number at a time."""
        keys, first, shift = self.keys
        size = np.diff(first)
        x, y = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        fit, both = size[x] >= THRESHOLD * size[y], np.zeros(len(a), np.int64)
        todo = np.flatnonzero(fit)
        ends, at = np.cumsum(size[x[todo]]), 0
        while at < len(todo):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKUPS, "right")))
            pairs = todo[at:to]
            n = size[x[pairs]]
            owner = np.repeat(np.arange(len(pairs)), n)
            place = np.arange(len(owner)) + (first[x[pairs]] - (np.cumsum(n) - n))[owner]
            want = keys[place] + ((y[pairs] - x[pairs]).astype(np.uint64) << shift)[owner]
            found = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
            both[pairs] = np.bincount(owner[found], minlength=len(pairs))
            at = to
        out = fit & (both >= THRESHOLD * (size[x] + size[y] - both))
        if not self.exact:
            for i in np.flatnonzero(out).tolist():
                out[i] = similar(self.lines[a[i]], self.lines[b[i]])
        return out

    def all(self, i: int) -> set[int]:
        if (got := self.whole.get(i)) is None:
            got = self.whole[i] = set(self.hashes[self.start[i] : self.stop[i]].tolist())
        return got


class Labels:
    """Union-find over labels, and the pairs that were found not to be similar."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.unlike: set[tuple[int, int]] = set()

    def find(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            x = up
        return x


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: str, b: str) -> bool:
    """Whether the Jaccard similarity of the shingle sets is at least the threshold."""
    x, y = shingles(a), shingles(b)
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= THRESHOLD * (len(x) + len(y) - both)


def similar_across(lines: HashedLines, members: list[int], part: list[int], block: list[int], own: bool, labels: Labels) -> list[tuple[int, int]]:
    """Pairs of similar lines (places in members) that join all parts which similar pairs of different parts join.

    With own, pairs lie in one block, else in two; labels carries what is known of these lines from group to group. Each line outside the
    largest part is held against all others at once, by counting the lines that have each of its shingles.
    """
    n, out = len(members), []

    def link(i: int, j: int) -> None:
        x, y = labels.find(part[i]), labels.find(part[j])
        if x == y:
            return
        pair = (members[i], members[j]) if members[i] < members[j] else (members[j], members[i])
        if pair in labels.unlike:
            return
        if lines.exact or similar(lines.lines[pair[0]], lines.lines[pair[1]]):
            out.append((i, j))
            labels.up[y] = x
        else:
            labels.unlike.add(pair)

    sets = [np.unique(lines.hashes[lines.start[m] : lines.stop[m]]) for m in members]
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    by = np.argsort(ids, kind="stable")
    holders, first = np.repeat(np.arange(n), size)[by], np.searchsorted(ids[by], np.arange(ids.max() + 2))
    at, parts, blocks = np.cumsum(size) - size, np.array(part), np.array(block)
    values, counts = np.unique(parts, return_counts=True)
    for i in np.flatnonzero(parts != values[counts.argmax()]).tolist():
        mine = ids[at[i] : at[i] + size[i]]
        both = np.bincount(np.concatenate([holders[first[k] : first[k + 1]] for k in mine]), minlength=n)
        for j in np.flatnonzero((both >= THRESHOLD * (size + size[i] - both)) & ((blocks == blocks[i]) == own)).tolist():
            link(i, j)
    return out


def similar_in_pairs(lines: HashedLines, member: np.ndarray, part: list[int], block: np.ndarray, group: np.ndarray, own: np.ndarray, labels: Labels) -> list[tuple[int, int]]:
    """similar_across() of all groups of PAIRED lines or fewer at once; pairs of lines, and part by line.

    Rows come sorted by group. The first line of each group is held against its others, then all whose parts are still
    different.
    """
    start = np.searchsorted(group, group)
    few, ones, others, n = np.bincount(group)[group] <= PAIRED, [], [], len(part)
    for d in range(1, PAIRED):
        together = few[d:] & (group[d:] == group[:-d])
        if not together.any():
            break
        ones.append(np.flatnonzero(together & ((block[d:] == block[:-d]) == own[d:])))
        others.append(ones[-1] + d)
    if not ones:
        return []
    i, j = np.concatenate(ones), np.concatenate(others)
    code, star, done, out = np.minimum(member[i], member[j]) * n + np.maximum(member[i], member[j]), i == start[i], np.empty(0, np.int64), []
    for some in (star, ~star):
        root = np.array([labels.find(p) for p in part], np.int64)
        pairs = np.unique(code[some])
        pairs = pairs[root[pairs // n] != root[pairs % n]]
        done = pairs = pairs[~np.isin(pairs, done)]
        for pair in pairs[lines.similar_pairs(pairs // n, pairs % n)].tolist():
            a, b = divmod(pair, n)
            x, y = labels.find(part[a]), labels.find(part[b])
            if x != y:
                out.append((a, b))
                labels.up[y] = x
    return out


def _bands(batches):
    """Band keys and line hashes of a task's texts; a line that the task has met lately is left out."""
    seen: set[int] = set()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for at in range(0, len(texts), 64):
            new: dict[int, str] = {}
            for text in texts[at : at + 64]:
                for line in (text or "").split("\n"):
                    line = line.strip(SPACES)
                    if len(line) >= SHINGLE:
                        h = xxhash.xxh64_intdigest(line.encode(), 42)
                        if h not in seen:
                            seen.add(h)
                            new[h] = line
            if new:
                nodes = np.fromiter(new, np.uint64, len(new)).view(np.int64)
                keys = band_keys(list(new.values())).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(nodes, BANDS))], ["key", "node"])
            if len(seen) > 400_000:
                seen.clear()


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, k (see row_key), pos and the trimmed line, for lines with a word."""
    line = docs.withColumn("k", row_key()).select("doc_id", "k", F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    return line.select("doc_id", "k", "pos", F.btrim("line", F.lit(SPACES)).alias("line")).where("line != ''")


_H1, _H2 = F.xxhash64, lambda line: F.xxhash64(F.lit(1), line)


@pandas_udf(BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for at in range(0, len(a), 250):
        number: dict[str, int] = {}
        pairs = [(number.setdefault(x, len(number)), number.setdefault(y, len(number))) for x, y in zip(a.iloc[at : at + 250], b.iloc[at : at + 250])]
        lines = HashedLines(list(number))
        out += lines.similar_pairs(*np.array(pairs).T).tolist()
    return pd.Series(out, dtype="bool")


def _shared_keys(batches):
    """key, node, rep of the keys with several nodes, from a task's rows, which come sorted by key; rep is one of the nodes."""
    held = None  # the last key so far, its rep, a node of it, and whether its rows went out
    for batch in batches:
        key, node = (batch.column(i).to_numpy() for i in range(2))
        if held:
            key, node = np.append(held[0], key), np.append(held[2], node)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        key, node = key[fresh], node[fresh]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        rep, many = node[start], size > 1
        at = int(np.searchsorted(key, held[0])) if held else 0
        rows = np.ones(len(key), bool)
        if held:
            g = int(np.searchsorted(start, at))
            rep[g] = held[1]
            if held[3]:
                many[g] = True
                rows[at : at + size[g]] = node[at : at + size[g]] != held[2]
        rows &= np.repeat(many, size)
        held = key[-1], rep[-1], node[-1], bool(many[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[rows], node[rows], np.repeat(rep, size)[rows])], ["key", "node", "rep"])


def _buckets(work: Workspace, docs: DataFrame) -> DataFrame:
    """key, node, rep: the lines of each band's key that several different lines share, and one of them that stands for
    all. A line can come more than once.

    Keys with more than a thousandth of all rows, as a sample tells (a wrong guess changes only how a key's rows are
    combined), stay where they are and are combined before they are shuffled; all others are shuffled and sorted once.
    """
    keyed = work.write(docs.select("text").mapInArrow(_bands, "key long, node long"))
    share = 0.02
    least = max(50, keyed.count() * share / HEAVY)
    often = [r.key for r in keyed.sample(share, 7).groupBy("key").count().where(F.col("count") > least).select("key").collect()]  # HEAVY keys at most
    heavy = F.col("key").isin(often)
    light = keyed.where(~heavy) if often else keyed
    light = light.repartition(_partitions(docs), "key").sortWithinPartitions("key")
    stars = light.mapInArrow(_shared_keys, "key long, node long, rep long")
    if often:
        hot = keyed.where(heavy)
        ends = hot.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("top")).where("rep < top").drop("top")
        stars = stars.unionByName(hot.join(F.broadcast(ends), "key"))
    out = work.write(stars.distinct())
    work.drop(keyed)
    return out


def _partitions(docs: DataFrame) -> int:
    spark = docs.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """k and dropped, the sorted positions of the lines that go, for each document (by its key k) that loses any."""
    work = Workspace(docs.sparkSession, "lines")
    docs = docs.select("doc_id", "text")
    lines = work.write(_lines(docs).select("doc_id", "k", "pos", _H1("line").alias("h1"), _H2("line").alias("h2")))
    stars = _buckets(work, docs)
    nodes = stars.select(F.col("node").alias("h1")).distinct()
    # of two lines with one h1, which 64 bits can't exclude, the one with the lesser h2 takes part
    texts = _lines(docs).select(_H1("line").alias("h1"), _H2("line").alias("h2"), "line").join(nodes.hint("merge"), "h1", "left_semi")
    texts = work.write(texts.groupBy("h1").agg(F.min(F.struct("h2", "line")).alias("t")).select("h1", "t.h2", "t.line"))
    prints = [F.sum(F.xxhash64(F.lit(s), "node").cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)]
    sizes = work.write(stars.groupBy("key").agg(F.count("*").alias("n"), *prints))
    large = sizes.where(F.col("n") > FEW).select("key", "n")
    pairs = skew_join(stars, large, ["key"], "n").where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    pairs = work.write(pairs.distinct())
    reps = work.write(pairs.groupBy("b").count().join(texts.select(F.col("h1").alias("b"), F.col("line").alias("tb")).hint("merge"), "b"))
    sides = work.write(pairs.join(texts.select(F.col("h1").alias("a"), F.col("line").alias("ta")).hint("merge"), "a"))
    links = work.write(skew_join(sides, reps, ["b"], "count").where(_similar("ta", "tb")).select("a", "b"))
    parts = work.write(connected_components(work, links))
    links = work.write(links.union(_within(work, stars, sizes, parts, texts)))
    parts = work.write(connected_components(work, links))

    told = texts.select("h1", "h2").join(parts.select(F.col("node").alias("h1"), "component").hint("merge"), "h1")
    different = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    different = work.write(different.join(told.hint("merge"), ["h1", "h2"], "left").where("component is not null or n > 1"))
    # a group is a component, or the equal lines of one kind
    group = [F.coalesce("component", "h1").alias("g1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(0).alias("g2"), F.col("component").isNull().alias("equal")]
    grouped = work.write(skew_join(lines, different, ["h1", "h2"], "n").select("doc_id", "k", "pos", *group))
    ids = ["g1", "g2", "equal"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "pos")
    firsts = work.write(grouped.groupBy(*ids).agg(F.min(place).alias("kept"), F.count("*").alias("m")))
    gone = skew_join(grouped, firsts, ids, "m").where((F.col("k") != F.col("kept.k")) | (F.col("pos") != F.col("kept.pos")))
    return gone.groupBy("k").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def _within(work: Workspace, stars: DataFrame, sizes: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame:
    """Links within buckets: in large ones, those that the comparison with the bucket's first line has left open.

    Only lines of different components are compared, in groups of two blocks of a bucket's lines. Of buckets with the
    same lines one is taken.
    """
    part = F.coalesce("component", stars.node)
    located = work.write(stars.join(parts.hint("merge"), stars.node == parts.node, "left").select("key", "rep", stars.node, part.alias("part")))
    whole = located.groupBy("key").agg((F.min("part") == F.max("part")).alias("one")).where("one")
    apart = sizes.join(whole.hint("merge"), "key", "left_anti").groupBy("s1", "s2", "n").agg(F.min("key").alias("key"))
    apart = work.write(apart.select("key", "n", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    dealt = skew_join(located, apart, ["key"], "n").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    groups = dealt.select("rep", "key", "node", "part", "block", F.explode(F.expr("transform(sequence(0L, blocks - 1), p -> struct(least(p, block) as x, greatest(p, block) as y))")).alias("g"))
    groups = groups.select("rep", "key", "node", "part", "block", "g.x", "g.y").join(texts.select(F.col("h1").alias("node"), "line").hint("merge"), "node")
    # buckets with the same first line share many others, so they are compared by one task, next to each other
    groups = groups.repartition(_partitions(stars), "rep", "x", "y").sortWithinPartitions("rep", "key", "x", "y")
    return groups.mapInPandas(_compare, "a long, b long")


def _compare(batches):
    """similar_across() for each group of a task, which come sorted by group, a bounded number of lines at a time."""

    def links(df: pd.DataFrame) -> pd.DataFrame:
        key, x, y = (df[c].to_numpy() for c in ("key", "x", "y"))
        part, block, ids = (df[c].tolist() for c in ("part", "block", "node"))
        text, parts = dict(zip(ids, df["line"])), dict(zip(ids, part))
        node = list(text)
        number = {m: i for i, m in enumerate(node)}
        lines, labels = HashedLines(list(text.values())), Labels()
        new = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        bounds = np.concatenate(([0], new, [len(df)]))
        member, group = np.array([number[m] for m in ids]), np.repeat(np.arange(len(new) + 1), np.diff(bounds))
        few = similar_in_pairs(lines, member, [parts[m] for m in node], df["block"].to_numpy(), group, x == y, labels)
        out = [(node[a], node[b]) for a, b in few]
        many = np.flatnonzero(np.diff(bounds) > PAIRED)
        for a, b in zip(bounds[many].tolist(), bounds[many + 1].tolist()):
            out += [(ids[a + i], ids[a + j]) for i, j in similar_across(lines, member[a:b].tolist(), part[a:b], block[a:b], x[a] == y[a], labels)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    held = None
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            held = batch.iloc[at : at + CHUNK] if held is None else pd.concat([held, batch.iloc[at : at + CHUNK]])
            ids = held[["key", "x", "y"]].to_numpy()
            whole = (ids != ids[-1]).any(1)  # the last group may go on
            if whole.any():
                yield links(held[whole])
                held = held[~whole]
    if held is not None and len(held):
        yield links(held)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with `text` without the lines that repeat others; its other columns and rows stay.

    Lines are cut at \\n and compared without the ASCII white space at their ends. Lines that are equal or have a
    Jaccard similarity of 0.8 or more on 9-character shingles are linked, and of each component the first line by
    (doc_id, position) stays. Lines without a word always stay; lines under 9 characters are only linked to equal
    ones. A null text stays null, and a document that loses all its lines gets an empty text. A null doc_id comes
    last. Rows with equal doc_id and text count as one document and lose the same lines.
    """
    dropped = Workspace(docs.sparkSession, "dropped").write(dropped_lines(docs))
    clean = F.expr("array_join(transform(filter(transform(split(text, '\\n'), (x, i) -> struct(x, i)), s -> not array_contains(_parchmine_dropped, s.i)), s -> s.x), '\\n')")
    dropped = dropped.select(F.col("k").alias("_parchmine_k"), F.col("dropped").alias("_parchmine_dropped"))
    marked = docs.join(dropped.hint("merge"), row_key() == F.col("_parchmine_k"), "left")
    text = F.when(F.col("_parchmine_dropped").isNull(), F.col("text")).otherwise(clean)
    return marked.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_dropped and dropped_lines (their positions, counted from 0)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dropped = Workspace(spark, "dropped").write(dropped_lines(docs))
    n = F.size(F.filter(F.split(text_of(), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    rows = docs.select("doc_id", row_key().alias("k"), n.cast("long").alias("n_lines"))
    positions = F.coalesce("dropped", F.array().cast("array<int>"))
    return rows.join(dropped.hint("merge"), "k", "left").select("doc_id", "n_lines", F.size(positions).cast("long").alias("n_dropped"), positions.alias("dropped_lines"))
