"""Toxicity: a sparse logistic model, regularised by counterfactual swaps of identity terms."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .common import Workspace, table

#: Labelled rows of each class that the model is fitted on at most, those with the smallest hashes of their ids.
MAX_TOXIC, MAX_CLEAN = 4_000, 8_000
#: Hashed features; those in fewer than MIN_DOCS fitted texts are left out, and of the rest the MAX_FEATURES that tell most are fitted.
BITS, MIN_DOCS, MAX_FEATURES = 22, 4, 6_000
L1, COUNTERFACTUAL, ROUNDS = 3e-4, 1.0, 400

#: Neutral terms for groups, by language and grammatical kind; terms of one list are swapped.
IDENTITY_TERMS = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"],
    ["black", "white", "asian", "african", "latino", "arab", "european", "american", "mexican", "chinese", "indian"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"],
    ["woman", "man", "girl", "boy"],
    ["women", "men", "girls", "boys"],
    ["immigrant", "refugee", "foreigner", "citizen"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["blind", "deaf", "disabled", "elderly", "young", "old"],
    ["frauen", "männer", "muslime", "christen", "juden", "ausländer", "deutsche", "flüchtlinge"],
    ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "français", "réfugiés"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "españoles", "refugiados"],
]
_GROUP = {t: g for g in IDENTITY_TERMS for t in g}
_TERM = re.compile(r"\b(?:" + "|".join(sorted(_GROUP, key=len, reverse=True)) + r")\b", re.IGNORECASE)
_WORD = re.compile(r"\w+")
#: Sentences that name a group and say nothing bad; a labelled text without a term is paired with itself plus one of them.
MENTIONS = ["as a {} person", "the {} community", "my neighbour is {}", "we are {}", "they said {}"]


def swap(text: str) -> str:
    """The text with each identity term replaced by another of its list, or with a neutral mention if it has none."""
    key = zlib.crc32(text.encode())

    def other(m: re.Match) -> str:
        group = _GROUP[m[0].lower()]
        return group[(group.index(m[0].lower()) + 1 + key % (len(group) - 1)) % len(group)]

    new, n = _TERM.subn(other, text)
    group = IDENTITY_TERMS[key % len(IDENTITY_TERMS)]
    return new if n else f"{text} {MENTIONS[key // 16 % len(MENTIONS)].format(group[key // 256 % len(group)])}"


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: the word and its prefixes of 4 to 6 letters."""
    parts = ["w" + word, *(f"p{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts]


def features(text: str | None) -> np.ndarray:
    """The features that occur in the whole text, sorted."""
    return np.unique(np.array([f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)], np.int32))


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self._known = lru_cache(200_000)(lambda word: tuple(f for f in word_features(word) if f in self.weights))

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        for w in set(_WORD.findall((text or "").lower())):
            found.update(self._known(w))
        z = self.bias + sum(map(self.weights.__getitem__, sorted(found)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def choose(names: np.ndarray, pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """The features to fit, sorted: of those in MIN_DOCS texts or more, the MAX_FEATURES whose shares in toxic and clean texts differ most."""
    share = (pos + 0.5) / (toxic + 1), (neg + 0.5) / (clean + 1)
    tells = np.where(pos + neg >= MIN_DOCS, np.abs(share[0] - share[1]) / np.sqrt(share[0] + share[1]), -1)
    chosen = np.lexsort((names, -tells))[:MAX_FEATURES]
    return np.sort(names[chosen[tells[chosen] > 0]])


def places(names: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where the features of found that are among names stand in names, as 16-bit numbers."""
    at = np.minimum(np.searchsorted(names, found), max(0, len(names) - 1))
    return at[names[at] == found].astype(np.uint16) if len(names) else np.empty(0, np.uint16)


def fit(rows: list[np.ndarray], swapped: list[np.ndarray], toxic: np.ndarray, l1: float = L1, counterfactual: float = COUNTERFACTUAL) -> Model:
    """fit_chosen() over feature arrays in memory, of texts and of their swapped forms."""
    toxic = np.asarray(toxic, float)
    names, column = np.unique(np.concatenate([np.empty(0, np.int32), *rows]), return_inverse=True)
    y = toxic[np.repeat(np.arange(len(rows)), [len(r) for r in rows])]
    pos, neg = np.bincount(column, y, len(names)), np.bincount(column, 1 - y, len(names))
    names = choose(names, pos, neg, int(toxic.sum()), int(len(toxic) - toxic.sum()))
    coded = [(places(names, x), places(names, np.setdiff1d(s, x)), places(names, np.setdiff1d(x, s))) for x, s in zip(rows, swapped)]
    return fit_chosen(names, coded, toxic, l1, counterfactual)


def fit_chosen(names: np.ndarray, coded: list[tuple], toxic: np.ndarray, l1: float = L1, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Minimises the mean logistic loss, plus l1 |w|, plus the mean squared change of the logit under swaps.

    coded holds, for each text, the places in names of its features, of those a swap adds, and of those it takes.
    Classes weigh alike. Without rows of both classes all weights are zero and every text scores 0.1.
    """
    toxic = np.asarray(toxic, float)
    if not 0 < toxic.sum() < len(toxic):
        return Model({}, float(np.log(0.1 / 0.9)))
    (r, c), (pr, pc), (mr, mc) = (
        (np.repeat(np.arange(len(coded), dtype=np.int32), [len(t[i]) for t in coded]), np.concatenate([t[i] for t in coded])) for i in range(3)
    )
    pairs, cols = np.concatenate([pr, mr]), np.concatenate([pc, mc])
    signs = np.concatenate([np.ones(len(pr), np.float32), -np.ones(len(mr), np.float32)])
    weight = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum()))
    w, b, n = np.zeros(len(names)), 0.0, len(coded)
    squares, square_b = np.full(len(names), 1e-8), 1e-8
    for _ in range(ROUNDS):  # AdaGrad with a proximal step
        z = b + _sums(r, c, w, n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        change = _sums(pairs, cols, w, n, signs)
        grad = _sums(c, r, g, len(names)) + counterfactual * 2 / n * _sums(cols, pairs, change, len(names), signs)
        squares += grad**2
        square_b += g.sum() ** 2
        step = 0.3 / np.sqrt(squares)
        w = w - step * grad
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
        b -= 0.3 / np.sqrt(square_b) * g.sum()
    return Model({int(k): float(v) for k, v in zip(names, w) if v}, float(b))


def _sums(to: np.ndarray, of: np.ndarray, values: np.ndarray, n: int, signs: np.ndarray | None = None, run: int = 1 << 20) -> np.ndarray:
    """values[of], times signs, added up by `to`, a run at a time so that no long array of doubles is made."""
    out = np.zeros(n)
    for i in range(0, len(to), run):
        v = values[of[i : i + run]]
        out += np.bincount(to[i : i + run], v if signs is None else v * signs[i : i + run], n)
    return out


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: the remainder of its id's CRC-32 by 5 is 0, or it has no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fits on labelled documents that aren't held out: at most max_toxic and max_clean of the two classes.

    Labels without a doc_id or a class are passed over; of several labels of a doc_id the toxic one counts. Of rows
    that share a doc_id the text that sorts first is read, and ids without a text count as empty. Other columns
    aren't read, whatever their names. Features are counted on the executors; the driver gets the MAX_FEATURES chosen
    ones and, for each fitted text, their 16-bit places, so it needs 2 bytes for each of (max_toxic + max_clean) x
    MAX_FEATURES places at the very most, however long the texts are.
    """
    work = Workspace(docs.sparkSession, "toxicity")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("y") == y).orderBy(*order).limit(most).select("doc_id", F.col("y").cast("int").alias("y")) for y, most in ((1, max_toxic), (0, max_clean))]
    chosen = F.broadcast(work.write(picked[0].union(picked[1])))  # bounded by the two limits
    texts = work.write(docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text"))
    sizes = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return fit_chosen(np.empty(0, np.int32), [], np.zeros(0))

    def count(batches):
        for batch in batches:
            y = batch["y"].to_numpy()
            found = [features(t) for t in batch["text"]]
            ids, at = np.unique(np.concatenate([np.empty(0, np.int32), *found]), return_inverse=True)
            toxic = y[np.repeat(np.arange(len(y)), [len(f) for f in found])]
            yield pd.DataFrame({"f": ids, "pos": np.bincount(at, toxic, len(ids)).astype("int64"), "neg": np.bincount(at, 1 - toxic, len(ids)).astype("int64")})

    counts = work.write(texts.mapInPandas(count, "f int, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= MIN_DOCS))
    a, b = (F.col("pos") + 0.5) / (sizes[1] + 1), (F.col("neg") + 0.5) / (sizes[0] + 1)
    best = counts.orderBy((F.abs(a - b) / F.sqrt(a + b)).desc(), "f").limit(MAX_FEATURES).collect()
    names = choose(*(np.array([r[i] for r in best], np.int32 if i == 0 else np.int64) for i in range(3)), sizes[1], sizes[0])

    def code(batches):
        for batch in batches:
            rows = []
            for y, t in zip(batch["y"], batch["text"]):
                x, s = features(t), features(swap(t or ""))
                rows.append((y, *(places(names, part).tobytes() for part in (x, np.setdiff1d(s, x), np.setdiff1d(x, s)))))
            yield pd.DataFrame(rows, columns=["y", "x", "plus", "minus"])

    coded, toxic = [], []
    for r in work.write(texts.mapInPandas(code, "y int, x binary, plus binary, minus binary")).orderBy("y", "x", "plus", "minus").toLocalIterator():
        toxic.append(r.y)
        coded.append(tuple(np.frombuffer(part, np.uint16) for part in (r.x, r.plus, r.minus)))
    return fit_chosen(names, coded, np.array(toxic))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text, ...), repeated rows and ids included.

    Whole texts are read, however long. Null and empty texts get the score of no features. A null doc_id is held out.
    Columns of docs by other names, score and predicted included, are left alone and don't return.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    @pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model that labels outside the held-out fifth give; see train() and toxicity_scores()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
