"""Lines of lists: numbering and body of headings, wrapped lines, entries that run together, repair of characters."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import chinese_number, column, plain

NUMBERED = re.compile(r"((?:chapter|section|part|appendix|figure|fig\.?|table)\s+)?((?:\d+|[IVXLCDM]+(?=[.\s:)])|[A-Z](?=[.\d]))(?:[.\-–]\d+)*)[.:)]?\s+(.*)", re.I | re.S)
CHINESE_HEADING = re.compile(r"(?:第\s*([一二三四五六七八九十\d]+)\s*[章节篇部卷]|([一二三四五六七八九十]{1,3})[、.．])\s*(.*)", re.S)
#: How an entry of a list starts, and how it ends in its page.
ENTRY_START = re.compile(r"(?:\d+(?:\.\d+)*|references|bibliography|appendi(?:x|ces)|acknowledge?ments?|index|glossary)(?=\s)", re.I)
ENTRY_END = re.compile(r"(?:^|\s)(?:[ivxlcdm]{1,8}|[a-z]?\s*-?\d{1,3}(?:\s*[-–—]\s*\d{1,3})?)$", re.I)
#: Most words of a paragraph that is cut into entries.
MOST_WORDS = 400


def prefix_and_body(heading: str | None) -> tuple[str, str]:
    """Numbering of a heading, as dotted upper case, and the rest of it; a single letter counts only with a dot or digit after it."""
    text = plain(unicodedata.normalize("NFKC", heading or ""))
    if m := NUMBERED.fullmatch(text):
        return re.sub(r"[-–]", ".", m[2].upper()), m[3].strip()
    if m := CHINESE_HEADING.fullmatch(text):
        number = m[1] or m[2]
        return str(number if number.isdigit() else chinese_number(number) or number), m[3].strip()
    return "", text


def starts_entry(line: str) -> bool:
    return bool(ENTRY_START.match(line.strip()) or NUMBERED.match(line.strip()))


def unwrapped(lines: list[str]) -> list[str]:
    """Lines with those joined that go on with the one before: without numbering of their own, after a line without a page.

    A hyphen between letters at the end of a line goes; page numbers and Roman numerals in single characters close up.
    """
    out: list[str] = []
    for raw in lines:
        line = re.sub(r"(?<!\S)((?:[ivxlcdm]\s){1,7}[ivxlcdm]|(?:\d\s){1,3}\d)$", lambda m: re.sub(r"\s", "", m[0]), raw.strip())
        if not line:
            continue
        if out and not starts_entry(line) and not ENTRY_END.search(out[-1]):
            last = out[-1]
            out[-1] = last[:-1] + line if re.search(r"[^\W\d_]-$", last) and line[:1].islower() else f"{last} {line}"
        else:
            out.append(line)
    return out


def cut_entries(paragraph: str | None) -> list[str]:
    """The most entries that a paragraph falls into as a whole, each from a start to a page; empty if it doesn't fall into two."""
    words = (paragraph or "").split()
    if len(words) > MOST_WORDS:
        return []
    starts = [bool(ENTRY_START.match(w + " ")) for w in words]

    @lru_cache(None)
    def best(at: int) -> tuple[int, tuple[int, ...]] | None:
        if at == len(words):
            return 0, ()
        if not starts[at]:
            return None
        found = None
        for end in range(at + 2, len(words) + 1):
            if ENTRY_END.search(words[end - 1]) and (end == len(words) or starts[end]) and (rest := best(end)):
                if found is None or rest[0] + 1 > found[0]:
                    found = rest[0] + 1, (end, *rest[1])
        return found

    cuts = best(0) if words else None
    best.cache_clear()
    if not cuts or cuts[0] < 2:
        return []
    ends = cuts[1]
    return [" ".join(words[a:b]) for a, b in zip((0, *ends), ends)]


def short_manual(blocks: list[tuple[str, str]]) -> bool:
    """Whether a page's (type, text) blocks are a title, then sections 一、 and 二、 with prose of some length after each."""
    found = [(k, t) for k, t in blocks if k in ("title", "doc_title", "paragraph_title", "paragraph", "text") and t]
    at = [(i, n) for i, (k, t) in enumerate(found) if k == "title" and (m := re.match(r"\s*([一二三四五六七八九十]{1,3})[、.．]\s*\S", t)) and (n := chinese_number(m[1]))]
    numbers = [n for _, n in at]
    if numbers[:2] != [1, 2] or numbers != sorted(set(numbers)) or not any(k in ("title", "doc_title") for k, _ in found[: at[0][0]]):
        return False
    after = [found[i + 1] if i + 1 < len(found) else ("", "") for i, _ in at[:2]]
    sizes = [len(t.strip()) for _, t in after]
    return all(k in ("paragraph", "text") for k, _ in after) and min(sizes) >= 12 and sum(sizes) >= 50 and max(sizes) >= 30


def repaired(native: str | None, other: str | None) -> str | None:
    """native with its replacement characters taken from other, where both agree around a run of equal length."""
    if native is None or other is None or "�" not in native:
        return native
    out: list[str] = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, native, other, autojunk=False).get_opcodes():
        mine, theirs = native[a:b], other[c:d]
        fits = tag == "replace" and b - a == d - c and all(x == y or x == "�" for x, y in zip(mine, theirs))
        out.append(theirs if fits else mine)
    return "".join(out)


def font_key(name: Column) -> Column:
    """A font's name without the prefix of its subset and the suffix of its encoding."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^/?([A-Z]{6}\+)?", ""), r"-Identity-[HV]$", ""))


def split_chapter(blocks: Column, height: Column) -> Column:
    """Whether a page's first blocks (type, text, bbox) are a chapter mark and, below it, its title, both in the upper part.

    Fixed values: the bounds of the two places, as shares of the page's height.
    """
    mark, title = F.try_element_at(blocks, F.lit(1)), F.try_element_at(blocks, F.lit(2))
    y = lambda b, i: b["bbox"][i] / F.greatest(height, F.lit(1e-9))
    exact = F.lower(F.trim(mark["text"])).rlike(r"^((chapter|part)\s+(\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)|第[一二三四五六七八九十百零〇\d]+章)$")
    place = (y(mark, 1).between(0.10, 0.34)) & (y(mark, 3) <= 0.40) & (y(title, 1) >= y(mark, 1)) & (y(title, 1) <= 0.50) & (y(title, 3) <= 0.62) & (y(title, 1) - y(mark, 3) <= 0.18)
    return F.coalesce((mark["type"] == "paragraph") & (title["type"] == "title") & exact & F.length(title["text"]).between(2, 180) & place, F.lit(False))


PREFIX = StructType([StructField("prefix", StringType()), StructField("body", StringType())])
prefix_and_body_of = column(lambda h: dict(zip(("prefix", "body"), prefix_and_body(h))), PREFIX)
cut_entries_of = column(cut_entries, ArrayType(StringType()))
unwrapped_of = column(lambda lines: unwrapped(list(lines)) if lines is not None else None, ArrayType(StringType()))
repaired_of = column(repaired, StringType())
