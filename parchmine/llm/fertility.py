"""Quality rules: word and line counts, and tokeniser fertility with rejection bands per language or script."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .common import Workspace, bounded_broadcast, table
from .pieces import PieceCodec, codec, default_model

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: Code point ranges that tell a script.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Thai": [(0xE00, 0xE7F)],
    "Hangul": [(0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}

#: Widest bands for a script's texts and the multilingual vocabulary of 32,000 pieces: lowest and highest characters
#: per token, highest share of byte-fallback tokens, lowest token entropy in bits.
SCRIPT_BANDS = {
    "Latin": (1.3, 7.5, 0.15, 4.2),
    "Greek": (0.6, 4.0, 0.30, 3.5),
    "Cyrillic": (1.2, 5.0, 0.20, 4.2),
    "Hebrew": (0.5, 3.0, 0.50, 3.5),
    "Arabic": (0.5, 3.0, 0.50, 3.5),
    "Devanagari": (0.3, 3.0, 0.90, 3.0),
    "Thai": (0.3, 3.0, 0.90, 3.0),
    "Hangul": (0.3, 2.0, 0.90, 3.0),
    "Kana": (0.4, 2.5, 0.60, 3.5),
    "Han": (0.3, 2.0, 0.80, 3.5),
}
ANY_BAND = (0.25, 8.0, 1.0, 3.0)
#: Each language has a band of its own besides, for characters per token, over its distinct texts that pass the base
#: rules: its median and WIDTH robust standard deviations, LEAST_REACH of the median at least. It is wider by LEAST_DOCS
#: over the number of texts, and for short texts, whose figures scatter more.
LEAST_DOCS, WIDTH, SHORT, LEAST_REACH = 200, 4.5, 300, 0.08

MEASURES = StructType(
    [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField("base_failed", BooleanType()), StructField("in_script_band", BooleanType()), StructField("n_tokens", LongType())]
    + [StructField(n, DoubleType()) for n in ("chars_per_token", "byte_share", "token_entropy")]
    + [StructField("script", StringType())]
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    key = ids[:-2] * len(number) + ids[1:-1]
    if len(number) >= 1 << 21:
        key = np.unique(key, return_inverse=True)[1]
    key = key * len(number) + ids[2:]
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    again = np.zeros(n, bool)
    again[order[:-1][same]] = again[order[1:][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + n] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def script_of(text: str) -> str | None:
    """The script of most letters of the whole text; None if it has no letter of a known script."""
    if text.isascii():
        return "Latin" if re.search("[A-Za-z]", text) else None
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = {s: sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges) for s, ranges in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def fertility(text: str, c: PieceCodec) -> tuple[int, float | None, float | None, float | None]:
    """Tokens, characters per token, share of byte-fallback tokens (line feeds apart) and token entropy in bits."""
    ids = np.array(c.encode(text), np.int32)
    if not len(ids):
        return 0, None, None, None
    ids = np.sort(ids)
    at = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    n = np.diff(np.append(at, len(ids)))
    fallback = int(n[c.is_byte[ids[at]] & (ids[at] != c.newline)].sum())
    return len(ids), len(text) / len(ids), fallback / len(ids), float(np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids))


def measure(text: str, c: PieceCodec) -> tuple:
    words, chars, symbols, dup, repeat = base_counts(text)
    tokens, per_token, fallback, entropy = fertility(text, c)
    failed = words < 50 or 100 * repeat > 50 * words
    script = script_of(text)
    low, high, most, least = SCRIPT_BANDS.get(script, ANY_BAND)
    fits = bool(tokens and low <= per_token <= high and fallback <= most and entropy >= least)
    return words, chars, symbols, dup, repeat, failed, fits, tokens, per_token, fallback, entropy, script


def measured(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs (text, ...) with a struct column `quality_rules` of counts and fertility; every text is read whole.

    A column of docs by that name is replaced.
    """

    @pandas_udf(MEASURES)
    def measures(texts: pd.Series) -> pd.DataFrame:
        c = codec(model or default_model())
        return pd.DataFrame([measure(t or "", c) for t in texts], columns=MEASURES.names)

    return docs.withColumn("quality_rules", measures("text").withField("text_hash", F.xxhash64("text")))


def language_bands(rows: DataFrame) -> DataFrame:
    """lang, middle and reach of characters per token over the distinct texts that pass the base rules and fit their script."""
    q = F.col("quality_rules")
    use = rows.where(~q.base_failed & q.in_script_band & F.col("lang").isNotNull())
    texts = use.groupBy("lang", q.text_hash.alias("text_hash")).agg(F.min(q.chars_per_token).alias("x"))
    stats = texts.groupBy("lang").agg(F.percentile_approx("x", [0.25, 0.5, 0.75], 10_000).alias("p"), F.count("*").alias("n"))
    reach = F.greatest(WIDTH * (F.col("p")[2] - F.col("p")[0]) / 1.349, LEAST_REACH * F.col("p")[1]) * (1 + LEAST_DOCS / F.col("n"))
    return stats.select("lang", F.col("p")[1].alias("middle"), reach.alias("reach"))


def judged(rows: DataFrame) -> DataFrame:
    """rows, as measured() returns them and read from a written table, with the verdict `quality_kept` besides.

    A null or empty text has counts of zero, null fertility and fails. A null lang has no band of its own; its texts
    are held against their script's band, and texts without letters of a known script against a wide one. Repeated
    rows get equal verdicts, and copies don't move a band. A column `quality_kept` of rows is replaced.
    """
    bands = language_bands(rows)
    few = bounded_broadcast(bands, rows.select("lang").distinct().count())
    few = few.select(F.col("lang").alias("_parchmine_lang"), F.col("middle").alias("_parchmine_middle"), F.col("reach").alias("_parchmine_reach"))
    q = F.col("quality_rules")
    reach = F.col("_parchmine_reach") * F.sqrt(1 + SHORT / F.greatest(q.n_tokens, F.lit(1)))
    inside = F.coalesce(F.abs(q.chars_per_token - F.col("_parchmine_middle")) <= reach, F.lit(True))
    out = rows.join(few, F.col("lang") == F.col("_parchmine_lang"), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != "quality_kept"], (~q.base_failed & q.in_script_band & inside).alias("quality_kept"))


def quality_rules(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with `quality_rules` and `quality_kept`; see judged()."""
    return judged(Workspace(docs.sparkSession, "quality").write(measured(docs, model)))


def op3_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, fertility and verdict of every document; see measured() and judged()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = Workspace(spark, "quality").write(measured(docs).drop("text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    more = ["n_tokens", "chars_per_token", "byte_share", "token_entropy", "script"]
    return judged(rows).select("doc_id", *[f"quality_rules.{c}" for c in base], F.col("quality_kept").alias("kept"), *[f"quality_rules.{c}" for c in more])
