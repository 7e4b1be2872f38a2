"""Text functions that SQL lacks, as plain functions and as Arrow-batched columns."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, MapType, StringType, StructType

#: Bounds of the hashed text features.
SLOTS, MOST_WORDS, MOST_CHARS = 512, 8192, 8192


#: Rows and bytes of input of which a worker holds results, or values as Python objects, at once.
MOST_ROWS, MOST_BYTES = 256, 1 << 20


def _shaped(kind: DataType) -> Callable:
    """Values of a kind as Arrow takes them: maps as pairs, tuples of a struct's fields as dictionaries."""
    if isinstance(kind, MapType):
        return lambda x: x and list(x.items())
    if isinstance(kind, StructType):
        return lambda x: dict(zip(kind.names, x)) if isinstance(x, tuple) else x
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (ArrayType, MapType, StructType)):
        one = _shaped(kind.elementType)
        return lambda x: x and [one(y) for y in x]
    return lambda x: x


def sliced(function: Callable, kind: DataType, batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Results of function for each row of Arrow batches, in parts of bounded rows and bytes whatever the batches' sizes."""
    shaped, arrow = _shaped(kind), to_arrow_type(kind)
    for batch in batches:
        n = len(batch[0])
        step = max(1, min(MOST_ROWS, MOST_BYTES * n // max(1, sum(x.nbytes for x in batch))))
        for i in range(0, max(1, n), step):
            rows = zip(*[x.slice(i, step).to_pylist() for x in batch])
            yield pa.array([shaped(function(*row)) for row in rows], arrow)


def column(function: Callable, kind: DataType) -> Callable[..., Column]:
    """An Arrow UDF that applies function to each row; for a struct, function returns a dictionary of its fields."""

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(function, kind, ((a,) for a in batches))

    def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return sliced(function, kind, batches)

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else more, kind)(*columns)


def plain(text: str) -> str:
    """The text without tags, images (their alternative text stays), link targets and emphasis marks.

    Fixed values: the four patterns, which decide what counts as markup.
    """
    for pattern, new in ((r"<[^>]+>", ""), (r"!\[([^]]*)\]\([^)]+\)", r"\1"), (r"\[([^]]+)\]\([^)]+\)", r"\1"), (r"\*\*|__|`", "")):
        text = re.sub(pattern, new, text)
    return text.strip().strip("*_")


def text_key(text: str | None) -> str | None:
    """Letters and numbers of the plain text, compatibility-normalised and case-folded."""
    if text is None:
        return None
    folded = unicodedata.normalize("NFKC", plain(text)).casefold()
    return "".join(c for c in folded if unicodedata.category(c)[0] in "LN")


def matching(a: str, b: str) -> int:
    """Characters in the blocks that difflib matches without its heuristic: the longest, first in a and then in b, and so on at both its sides.

    The longest is searched by growing it: at each place of a, by whether b has one character more than the best so far.
    """
    total, parts = 0, [(0, len(a), 0, len(b), len(a))]
    while parts:
        i0, i1, j0, j1, most = parts.pop()  # most: no block in these ranges is longer
        most = min(most, i1 - i0, j1 - j0)
        if most <= 1:
            while most == 1 and i0 < i1 and j0 < j1:  # blocks of one character: each place of a takes the next in b
                if (j := b.find(a[i0], j0, j1)) >= 0:
                    total, j0 = total + 1, j + 1
                i0 += 1
            continue
        size, i, at_a, at_b = 0, i0, 0, 0
        while size < most and i + size < i1:
            if (j := b.find(a[i : i + size + 1], j0, j1)) >= 0:
                size, at_a, at_b = size + 1, i, j
            else:
                i += 1
        if size:
            total += size
            parts += [(i0, at_a, j0, at_b, size), (at_a + size, i1, at_b + size, j1, size)]
    return total


def similarity(a: str | None, b: str | None) -> float | None:
    """Ratio of matching characters over longest common blocks, without the popularity heuristic."""
    return None if a is None or b is None else 2.0 * matching(a, b) / (len(a) + len(b)) if a or b else 1.0


@lru_cache(1 << 18)
def _slot(token: str) -> tuple[int, float]:
    h = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(h, "little") % SLOTS, -1.0 if h[0] & 1 else 1.0


def hashed_features(text: str | None) -> dict[int, float]:
    """Signed hashes of words, CJK characters and character 2- to 5-grams in 512 slots, of unit length."""
    compact = re.sub(r"\s+", " ", (text or "").casefold()).strip()[:MOST_CHARS]
    framed = f"^{compact}$"
    grams = {"w": re.findall(r"[a-z0-9]+|[㐀-鿿]", compact)[:MOST_WORDS]} | {f"c{n}": [framed[i : i + n] for i in range(len(framed) - n + 1)] for n in range(2, 6)}
    slots: dict[int, float] = {}
    for kind, found in grams.items():
        for gram, times in Counter(found).items():
            slot, sign = _slot(f"{kind}:{gram}")
            slots[slot] = slots.get(slot, 0.0) + sign * times
    norm = math.sqrt(sum(v * v for v in slots.values())) or 1.0
    return {s: v / norm for s, v in slots.items()}


def strict_json_error(text: str | None) -> str | None:
    """Why a text isn't strict JSON: null, not JSON, or an object with a repeated key; null if it is."""
    if text is None:
        return "null"

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise KeyError
        return dict(pairs)

    def constant(name):
        raise ValueError(name)

    try:
        json.loads(text, object_pairs_hook=unique, parse_constant=constant)
    except KeyError:
        return "repeated key"
    except (ValueError, RecursionError):
        return "not JSON"
    return None


#: Keys of a nested block that hold its text, first found first taken.
TEXT_KEYS = ("content", "text", "item_content", "title_content", "paragraph_content", "value")


def flat_text(value: str | None) -> str | None:
    """Text of a nested JSON block: lists joined by blanks, the first text key of an object."""

    def walk(x, depth=0):
        if isinstance(x, str):
            return " ".join(x.split())
        if depth > 64 or isinstance(x, (bool, int, float)) or x is None:
            return ""
        if isinstance(x, list):
            return " ".join(t for t in (walk(y, depth + 1) for y in x) if t)
        return next((t for k in TEXT_KEYS if k in x and (t := walk(x[k], depth + 1))), "")

    try:
        return None if value is None else walk(json.loads(value))
    except (ValueError, RecursionError):
        return ""


def merge_sequences(a: list, b: list) -> list:
    """The shortest sequence that holds both in order: what a longest common subsequence shares comes once."""
    n, m = len(a), len(b)
    longest = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            longest[i][j] = 1 + longest[i + 1][j + 1] if a[i] == b[j] else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif longest[i + 1][j] >= longest[i][j + 1]:
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return out + a[i:] + b[j:]


#: Chinese digits.
CHINESE = {c: i for i, c in enumerate("一二三四五六七八九", 1)}


def chinese_number(text: str | None) -> int | None:
    """1 to 99 from a Chinese numeral, else null."""
    tens, ten, ones = (text or "").partition("十")
    if not ten:
        return CHINESE.get(tens)
    if (tens and tens not in CHINESE) or (ones and ones not in CHINESE):
        return None
    return CHINESE.get(tens, 1) * 10 + CHINESE.get(ones, 0)


def running_confidence(values: list[float] | None, places: int = 2) -> float | None:
    """The mean of values, kept as they come and rounded after each, as Python rounds binary numbers."""
    mean = None
    for n, v in enumerate(values or []):
        mean = v if mean is None else round((mean * n + v) / (n + 1), places)
    return mean


text_key_of = column(text_key, StringType())
similarity_of = column(similarity, DoubleType())
hashed_features_of = column(hashed_features, MapType(IntegerType(), DoubleType()))
strict_json_error_of = column(strict_json_error, StringType())
flat_text_of = column(flat_text, StringType())
chinese_number_of = column(chinese_number, IntegerType())


def register(spark) -> None:
    """The functions for SQL: text_key, similarity, hashed_features, strict_json_error, flat_text, chinese_number, table_markdown."""
    from .html_tables import table_markdown

    for name, f, kind in (
        ("text_key", text_key, StringType()), ("similarity", similarity, DoubleType()), ("hashed_features", hashed_features, MapType(IntegerType(), DoubleType())),
        ("strict_json_error", strict_json_error, StringType()), ("flat_text", flat_text, StringType()), ("chinese_number", chinese_number, IntegerType()), ("table_markdown", table_markdown, StringType()),
    ):
        spark.udf.register(name, f, kind)
