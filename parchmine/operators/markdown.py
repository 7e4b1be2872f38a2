"""Navigation of Markdown documents: lists of contents become links, and their headings link back."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from parchmine.functions.text import column, similarity, text_key

#: Titles of lists, as keys.
TITLES = {
    "contents": "contents tableofcontents sommaire inhalt indice 目录",
    "figures": "listoffigures listingoffigures listoffiguresandtables listofillustrations listofplates 图目录 插图目录 图表目录",
    "tables": "listoftables 表目录",
}
_KINDS = {t: k for k, ts in TITLES.items() for t in ts.split()}
HEADING = re.compile(r"(#{1,6})\s+(\S.*)")
LEADERS = re.compile(r"(?:\s*[.．·•…⋯]\s*){2,}|-{4,}|\s{3,}")
PAGE = re.compile(r"(.*\S)\s+([A-Za-z]?\d+(?:[-–.]\d+)*|[ivxlcdm]+)$", re.I)
IDENTIFIER = re.compile(r"(?:(figure|fig\.?|table|图|表)\s*)?(\d+(?:[.\-–]\d+)*|[A-Z](?:[.\-–]\d+)+)(?:[.:)]?\s+|$)", re.I)
#: Marks of a list that goes on.
CONTINUED = re.compile(r"\s*(?:\((?:continued|cont\.?|续)\)|[-–:]\s*(?:continued|cont\.?|续))\s*$", re.I)
MADE = re.compile(r'<a id="[^"]*" data-nav="(section|target)"></a>$|\[↑ .*\]\(#[^)]*\)$')
FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
#: Least ratio of an unnumbered title and its heading, and least lead over the next best.
ALIKE, LEAD = 0.94, 0.08


class Entry(NamedTuple):
    title: str
    page: str
    identifier: str
    depth: int


def list_kind(title: str) -> str | None:
    """contents, figures or tables, if a title is that of such a list, be it continued."""
    return _KINDS.get(text_key(CONTINUED.sub("", title)) or "")


def parse_entry(line: str) -> Entry | None:
    """Title, page label, identifier and depth of a line of a list; null if it isn't numbered, ends in a page or is a link.

    The label of a link that link_navigation() made is the title as it stands.
    """
    if made := re.fullmatch(r"\s*- \[(.+)\]\(#[^)]+\)", line):
        number = IDENTIFIER.match(made[1])
        identifier = re.sub(r"[-–]", ".", number[2].upper()) if number else ""
        return Entry(made[1], "", identifier, min(5, identifier.count(".")))
    line = re.sub(r"^\s*(?:[-*+]\s+)?", "", line)
    line = re.sub(r"\[([^]]+)\]\([^)]*\)", r"\1", line).strip()
    parts = LEADERS.sub(" ", line).strip()
    paged = PAGE.match(parts)
    number = IDENTIFIER.match(parts)
    standard = paged and re.search(r"\b(?:ISO|IEC|IEEE|ASTM|DIN|EN)$", paged[1])
    title, page = (paged[1], paged[2]) if paged and not standard and (number or LEADERS.search(line)) else (parts, "")
    if not title or not (number or page):
        return None
    identifier = re.sub(r"[-–]", ".", number[2].upper()) if number else ""
    return Entry(title.strip(" .·•…⋯"), page, identifier, min(5, identifier.count(".")))


def in_code(lines: list[str]) -> list[bool]:
    """Whether each line is part of a fenced block, the fences included."""
    out, fence = [], None
    for line in lines:
        m = FENCE.match(line)
        if fence:
            out.append(True)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
        else:
            fence = m[1] if m else None
            out.append(bool(m))
    return out


def without_navigation(lines: list[str]) -> list[str]:
    """The lines without anchors and links back that link_navigation() made."""
    return [x for x in lines if not MADE.fullmatch(x)]


def link_navigation(text: str | None) -> str | None:
    """The document with its lists as links to headings or captions, which get anchors and a link back.

    An entry goes to the heading with its identifier and title, or else with its title, or else to the one heading
    whose title is most alike; entries without such a heading stay text. Applying it twice changes nothing more, and
    no line of the body is lost.
    """
    if text is None:
        return None
    lines = without_navigation(text.split("\n"))
    code = in_code(lines)
    headings = [(i, m[1], m[2]) for i, x in enumerate(lines) if not code[i] and (m := HEADING.fullmatch(x))]
    starts = {i: kind for i, _, title in headings if (kind := list_kind(title))}
    sections: dict[int, tuple[int, str, list[Entry]]] = {}
    for start, kind in starts.items():
        end, entries = start + 1, []
        for i in range(start + 1, len(lines)):
            entry = parse_entry(lines[i]) if lines[i].strip() and not code[i] and not HEADING.fullmatch(lines[i]) else None
            if entry:
                entries.append(entry)
                end = i + 1
            elif lines[i].strip():
                break
        if entries:
            sections[start] = end, kind, entries
    if not sections:
        return text
    owned = {i for s, (e, *_) in sections.items() for i in range(s, e)}
    body = [(i, title) for i, _, title in headings if i not in owned and i not in starts]
    captions = [(i, x.strip()) for i, x in enumerate(lines) if i not in owned and not code[i] and (m := IDENTIFIER.match(x.strip())) and m[1]]
    anchors: dict[int, tuple[int, list[int]]] = {}
    used, links = set(re.findall(r'<a id="(\d+)"', "\n".join(lines))), {}
    for start, (_, kind, entries) in sections.items():
        targets = body if kind == "contents" else captions
        by_key: dict[str, list[int]] = {}
        for i, title in targets:
            by_key.setdefault(text_key(title) or "", []).append(i)
        taken: set[int] = set()
        for n, entry in enumerate(entries):
            key = text_key(entry.title) or ""
            found = [i for i in by_key.get(key, []) if i not in taken][:1]
            if not found and not entry.identifier:  # only unnumbered entries are compared with every title
                scores = sorted(((similarity(key, k), i) for k, at in by_key.items() for i in at if i not in taken), reverse=True)
                if scores and scores[0][0] >= ALIKE and (len(scores) == 1 or scores[0][0] - scores[1][0] >= LEAD):
                    found = [scores[0][1]]
            if found:
                taken.add(found[0])
                links[start, n] = found[0]
                anchors.setdefault(found[0], (0, []))[1].append(start)
    number = 0
    for i in sorted(anchors):
        number += 1
        while str(number) in used:
            number += 1
        anchors[i] = number, anchors[i][1]
    names, out, i = {}, [], 0
    for start, (_, kind, _) in sorted(sections.items()):
        n = sum(k == kind for s, (_, k, _) in sections.items() if s < start)
        names[start] = f"nav-{kind}" + (f"-{n + 1}" if n else "")
    while i < len(lines):
        if i in sections:
            end, _, entries = sections[i]
            out += [f'<a id="{names[i]}" data-nav="section"></a>', lines[i], ""]
            for n, e in enumerate(entries):
                label = e.title if not e.page or (i, n) in links else f"{e.title} ..... {e.page}"
                out.append("  " * e.depth + "- " + (f"[{e.title}](#{anchors[links[i, n]][0]})" if (i, n) in links else label))
            i = end
            continue
        if i in anchors:
            number, sources = anchors[i]
            out += [f'<a id="{number}" data-nav="target"></a>', lines[i]]
            out += [f"[↑ {HEADING.fullmatch(lines[s])[2]}](#{names[s]})" for s in dict.fromkeys(sources)]
        else:
            out.append(lines[i])
        i += 1
    return "\n".join(out)


ENTRY = ArrayType(StructType([StructField(n, StringType()) for n in ("title", "page", "identifier")]))


def parse_entries(text: str | None) -> list[tuple[str, str, str]]:
    """Entries of a list's lines, each (title, page) once."""
    found = [e for line in (text or "").split("\n") if line.strip() and (e := parse_entry(line))]
    return list(dict.fromkeys((e.title, e.page, e.identifier) for e in found))


link_navigation_of = column(link_navigation, StringType())
parse_entries_of = column(parse_entries, ENTRY)
in_code_of = column(lambda text: in_code((text or "").split("\n")), ArrayType(BooleanType()))


def audit_navigation(docs: DataFrame) -> DataFrame:
    """doc_id, links, backlinks, missing (links without an anchor), repeated (anchors more than once), idempotent.

    For docs (doc_id, text) that link_navigation() has made.
    """
    ids = F.regexp_extract_all("text", F.lit(r'<a id="([^"]*)" data-nav='), F.lit(1))
    to = F.regexp_extract_all("text", F.lit(r"\]\(#([^)]*)\)"), F.lit(1))
    back = F.regexp_count("text", F.lit(r"(?m)^\[↑ "))
    out = docs.select("doc_id", "text", ids.alias("ids"), to.alias("to"), back.alias("backlinks"), link_navigation_of("text").alias("again"))
    return out.select(
        "doc_id", (F.size("to") - F.col("backlinks")).alias("links"), "backlinks", F.size(F.array_except("to", "ids")).alias("missing"),
        (F.size("ids") - F.size(F.array_distinct("ids"))).alias("repeated"), (F.col("again") == F.col("text")).alias("idempotent"),
    )
