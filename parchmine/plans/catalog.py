"""The relational operators as plans: name -> (operator ids, frames, SQL). See dialect.py for tokens, tables.py for frames."""

from __future__ import annotations

def tokens(t: str) -> str:
    """Estimated tokens of a text: 1.2 for a CJK character, 1 for 3.5 others, 15 % more, rounded half to even, at least 1."""
    cjk = f"length({t}) - length(regexp_replace({t}, '[㐀-鿿]', ''@G))"
    return f"CAST(greatest(1, @EVEN(((CAST({cjk} AS DOUBLE)) * CAST(1.2 AS DOUBLE) + CAST(length({t}) - ({cjk}) AS DOUBLE) / CAST(3.5 AS DOUBLE)) * CAST(1.15 AS DOUBLE), 0)) AS BIGINT)"


def count_of(text: str, term: str) -> str:
    """Occurrences of a term in a text that don't overlap."""
    return f"CAST((length({text}) - length(replace({text}, {term}, ''))) / length({term}) AS BIGINT)"


#: A page's answer to the query "the on": the full query counts eightfold, each of its terms five times at most.
SCORED = f"""
SELECT doc, page, text, lower(text) AS low, 8 * {count_of('lower(text)', "'the on'")} + least({count_of('lower(text)', "'the'")}, 5) + least({count_of('lower(text)', "'on'")}, 5) AS score,
  {tokens('text')} AS tokens
FROM {{pages}}"""

ISLANDS = """
SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS island FROM (SELECT DISTINCT doc, page FROM {{pages}} WHERE {where})"""

CLASSES = """
SELECT k.class, count_if(g.gold = k.class) AS support, count_if(g.pred = k.class) AS predicted, count_if(g.gold = k.class AND g.pred = k.class) AS tp
FROM {judged} g CROSS JOIN (SELECT CAST(0 AS BIGINT) AS class UNION ALL SELECT CAST(1 AS BIGINT)) k GROUP BY k.class"""

MODEL = "CASE WHEN feature % 7 = label_class THEN CAST(0.5 AS DOUBLE) WHEN (feature + label_class) % 5 = 0 THEN CAST(-0.25 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END"
SCORES = f"""
SELECT c.vec_id, k.label_class, sum(c.x * {MODEL}) AS z
FROM {{components}} c JOIN (SELECT CAST(column0 AS BIGINT) AS label_class FROM (SELECT 0 AS column0 UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)) k ON k.label_class >= 0
GROUP BY c.vec_id, k.label_class"""
SOFTMAX = f"""
SELECT vec_id, label_class, exp(greatest(z - m, -745)) / sum(exp(greatest(z - m, -745))) OVER (PARTITION BY vec_id) AS p
FROM (SELECT vec_id, label_class, z / CAST(1.5 AS DOUBLE) AS z, max(z / CAST(1.5 AS DOUBLE)) OVER (PARTITION BY vec_id) AS m FROM ({SCORES}) s) t"""
TOP2 = f"""
SELECT vec_id, max(CASE WHEN r = 1 THEN label_class END) AS top, max(CASE WHEN r = 1 THEN p END) AS p1, coalesce(max(CASE WHEN r = 2 THEN p END), 0) AS p2
FROM (SELECT vec_id, label_class, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label_class) AS r FROM ({SOFTMAX}) x) y GROUP BY vec_id"""

NAV = "length(trim(line)) BETWEEN 4 AND 180 AND @RLIKE(trim(line), '([.][.]+|…+|  +)[ ]*([ivxlcdmIVXLCDM]+|[A-Za-z]?[ ]*-?[0-9]+)$') AND @RLIKE(line, '[A-Za-z㐀-鿿]')"
#: Lines of a contents page, made from the first words of document lines; every fifth has no page number.
ENTRIES = """
SELECT doc_id, pos, CAST(doc_id % 9 + 1 AS @STR) || '.' || CAST(pos + 1 AS @STR) || ' ' || substring(line, 1, 24) || CASE WHEN pos % 5 = 4 THEN '' ELSE ' ..... ' || CAST(doc_id % 90 + pos AS @STR) END AS line
FROM {lines} WHERE length(line) > 20 AND pos < 12"""

#: 81 temperatures from 0.35 to 4 in equal ratios, to six places.
TEMPERATURES = " UNION ALL ".join(f"SELECT CAST({0.35 * (4 / 0.35) ** (i / 80):.6f} AS DOUBLE) AS temperature" for i in range(81))

SHA = "'00' || md5(CAST(doc_id % 40 AS @STR))"
SELECTIONS = "SELECT doc_id % 40 AS source, doc_id AS idx, 1 + doc_id % 30 AS first, 1 + doc_id % 30 + doc_id % 11 AS last FROM {pages}"
LABELLED = "SELECT doc_id, doc_id % 40 AS source, 1 + (doc_id * 7) % 36 AS page, gold FROM {judged}"

P = {
    # pages, search, ranges
    "token_estimate": (["A07", "F31"], ["pages"], f"SELECT doc_id, {tokens('text')} AS tokens FROM {{pages}}"),
    "page_index_records": (["D21", "S13", "S19"], ["pages"], f"SELECT doc, page AS pdf_page, CAST(length(text) AS BIGINT) AS characters, {tokens('text')} AS estimated_tokens FROM {{pages}}"),
    "page_search_topk": (["A09", "T01", "M25"], ["pages"], f"SELECT doc, page, score, tokens FROM (SELECT doc, page, score, tokens, row_number() OVER (PARTITION BY doc ORDER BY score DESC, page) AS r FROM ({SCORED}) s WHERE score > 0) t WHERE r <= 8"),
    "page_search_snippets": (
        ["F16", "F15"], ["pages"],
        f"""SELECT doc, page, CASE WHEN start > 1 THEN '…' ELSE '' END || substring(flat, start, 260) || CASE WHEN start + 259 < length(flat) THEN '…' ELSE '' END AS snippet
        FROM (SELECT doc, page, flat, CAST(greatest(1, least(CASE WHEN a > 0 THEN a ELSE 1000000 END, CASE WHEN b > 0 THEN b ELSE 1000000 END) - 86) AS INT) AS start
          FROM (SELECT doc, page, flat, instr(lower(flat), 'the') AS a, instr(lower(flat), 'on') AS b FROM (SELECT doc, page, trim(regexp_replace(translate(text, chr(10), ' '), ' +', ' '@G)) AS flat FROM ({SCORED}) s WHERE score > 0) f) g WHERE a > 0 OR b > 0) h""",
    ),
    "benchmark_term_search": (
        ["A09"], ["pages", "words", "benchmark"],
        """SELECT item_id, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM (
          SELECT q.item_id, w.doc_id, CAST(sum(least(w.n, 5)) AS BIGINT) AS score FROM (SELECT DISTINCT item_id, word FROM (SELECT item_id, @WORDS AS word FROM {benchmark}) u WHERE word <> '') q
          JOIN (SELECT doc_id, word, count(*) AS n FROM {words} GROUP BY doc_id, word) w ON q.word = w.word GROUP BY q.item_id, w.doc_id) s) t WHERE r <= 8""",
    ),
    "source_inspect": (
        ["A08", "T05", "D22", "P31"], ["pages"],
        f"""SELECT doc, page_count, sampled, avg_chars, CASE WHEN avg_chars < 20 AND nonempty = 0 THEN 'scanned' WHEN nonempty >= greatest(1, @EVEN(sampled * CAST(0.7 AS DOUBLE), 0)) THEN 'text' ELSE 'mixed' END AS pdf_kind,
          CAST(@EVEN(avg_chars * page_count, 0) AS BIGINT) AS full_characters
        FROM (SELECT doc, max(n) AS page_count, count(*) AS sampled, avg(chars) AS avg_chars, count_if(chars >= 40) AS nonempty
          FROM (SELECT doc, page, CAST(length(trim(text)) AS DOUBLE) AS chars, count(*) OVER (PARTITION BY doc) AS n FROM {{pages}}) a
          WHERE n <= 14 OR page <= 10 OR page > n - 2 OR page = CAST(@EVEN(n / CAST(3 AS DOUBLE), 0) AS BIGINT) OR page = CAST(@EVEN(2 * n / CAST(3 AS DOUBLE), 0) AS BIGINT) GROUP BY doc) b""",
    ),
    "page_range_merge": (["P01", "U01", "D03"], ["pages"], f"SELECT doc, min(page) AS first, max(page) AS last FROM ({ISLANDS.format(where="length(text) > 1500")}) i GROUP BY doc, island"),
    "selection_single_range": (
        ["P05"], ["pages"],
        f"SELECT doc, min(first) AS first, max(last) AS last, count(*) = 1 AS single FROM (SELECT doc, min(page) AS first, max(page) AS last FROM ({ISLANDS.format(where="length(text) > 400")}) i GROUP BY doc, island) r GROUP BY doc",
    ),
    "page_choice_short_document": (["T06", "C16"], ["pages"], f"SELECT doc, count(*) AS pages, CAST(sum({tokens('text')}) AS BIGINT) AS tokens, count(*) <= 25 AND sum({tokens('text')}) <= 30000 AS whole FROM {{pages}} GROUP BY doc"),
    "page_slice": (["P13"], ["pages"], "SELECT doc, page, 100 + page - 1 AS physical_page FROM {pages} WHERE page <= 5"),
    "text_kinds": (["P14", "A03"], ["lines"], "SELECT doc_id, count_if(trim(line) = '') AS blank, count_if(length(line) BETWEEN 1 AND 80) AS short, count_if(length(line) > 80) AS prose, CAST(sum(length(line)) AS BIGINT) AS text_chars, count_if(@RLIKE(line, '[|]')) AS tabular FROM {lines} GROUP BY doc_id"),
    # caches and keys
    "task_keys": (["F18", "D04"], ["pages"], f"SELECT doc_id, substring(@SHA256({SHA} || '|' || CAST(page AS @STR) || '|balanced|auto|ch|2.0.0'), 1, 16) AS task_key FROM {{pages}}"),
    "cache_hits": (["J01", "J27", "S06", "D05"], ["judged", "pages"], "SELECT p.doc_id, c.doc_id IS NOT NULL AND c.accepted AND p.n_chars > 200 AS hit FROM {pages} p LEFT JOIN {judged} c ON p.doc_id = c.doc_id"),
    "cache_misses": (["J02"], ["judged", "pages"], "SELECT p.doc_id, p.page FROM {pages} p @ANTI {judged} c ON p.doc_id = c.doc_id"),
    "manifest_upsert": (["J03", "S24"], ["judged", "pages"], "SELECT doc_id, 'new' AS version, prob AS value FROM {judged} UNION ALL SELECT p.doc_id, 'old', CAST(p.n_chars AS DOUBLE) FROM {pages} p @ANTI {judged} j ON p.doc_id = j.doc_id"),
    "source_change": (["J04", "J25", "P32"], ["pages", "judged"], "SELECT p.doc_id, CASE WHEN j.doc_id IS NULL THEN 'new' WHEN md5(p.lang) = md5(CASE WHEN j.gold = 1 THEN p.lang ELSE 'en' END) THEN 'same' ELSE 'changed' END AS state FROM {pages} p LEFT JOIN {judged} j ON p.doc_id = j.doc_id"),
    "newest_version": (["T08", "W16"], ["turns"], "SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM {turns}) t WHERE r = 1"),
    "dedupe_first_seen": (["T04", "M24"], ["pages"], "SELECT digest, doc_id AS first_doc, copies FROM (SELECT md5(text) AS digest, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY md5(text)) AS copies FROM {pages}) t WHERE r = 1"),
    "cached_selection_status": (["A34", "A32"], ["judged"], "SELECT doc, count(*) AS total, count_if(accepted) AS succeeded, count_if(NOT accepted AND gold = 1) AS failed, count_if(NOT accepted AND gold = 0) AS skipped FROM {judged} GROUP BY doc"),
    "download_budget": (["A35", "S23"], ["pages"], "SELECT doc, page, running, running <= 60000 AS within FROM (SELECT doc, page, CAST(sum(n_chars) OVER (PARTITION BY doc ORDER BY page) AS BIGINT) AS running FROM {pages}) t"),
    # links and images
    "link_numbers": (["F17", "T09"], ["links"], "SELECT page_id, href, first_pos, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) * CAST(1 AS BIGINT) AS number FROM (SELECT page_id, lower(href) AS href, min(pos) AS first_pos FROM {links} GROUP BY page_id, lower(href)) t"),
    "link_anchor_missing": (["J20", "U04"], ["links"], "SELECT a.page_id, a.href FROM (SELECT DISTINCT page_id, href FROM {links}) a @ANTI (SELECT DISTINCT page_id + 1 AS page_id, href FROM {links}) b ON a.page_id = b.page_id AND a.href = b.href"),
    "backlink_range": (["J21", "W09"], ["links"], "SELECT a.page_id, a.pos, a.href, count(b.pos) AS backlinks FROM {links} a LEFT JOIN {links} b ON a.page_id = b.page_id AND a.href = b.href AND b.pos BETWEEN a.pos + 1 AND a.pos + 8 GROUP BY a.page_id, a.pos, a.href"),
    "anchor_duplicates": (["A30"], ["links"], "SELECT page_id, href, count(*) AS copies FROM {links} GROUP BY page_id, href HAVING count(*) > 1"),
    "anchor_numbering": (["T10", "T11"], ["links"], "SELECT page_id, pos, CASE WHEN r = 1 THEN href ELSE href || '-' || CAST(r AS @STR) END AS anchor FROM (SELECT page_id, pos, href, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS r FROM {links}) t"),
    "link_hosts": (["F28", "P28"], ["webpages"], "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, @RLIKE(url, '^https://') AS secure, @RLIKE(url, '[?#]') AS has_suffix FROM {webpages}"),
    "url_checks": (["F29", "P25"], ["webpages"], "SELECT page_id, @RLIKE(url, '^https://[a-z0-9.-]+(:443)?(/.*)?$') AS valid, @RLIKE(url, '@') AS has_user, @RLIKE(url, '^[a-z]+://(10|127|192[.]168)[.]') AS is_private FROM {webpages}"),
    # evidence and features
    "block_counts": (["A03", "P11", "P12"], ["blocks"], "SELECT page_id, type, count(*) AS blocks, CAST(sum(length(body)) AS BIGINT) AS chars FROM {blocks} GROUP BY page_id, type"),
    "layout_features": (
        ["A01", "P09", "D07", "D08"], ["blocks"],
        """SELECT page_id, type, round(n / CAST(total AS DOUBLE), 6) AS share, round(area / total, 6) AS area, round(cy / total, 6) AS center_y, round(ln(1 + CAST(total AS DOUBLE)), 6) AS log_blocks
        FROM (SELECT page_id, type, count(*) AS n, sum(w * h) AS area, sum(y + h / 2) AS cy, max(total) AS total
          FROM (SELECT page_id, type, CAST(pos AS DOUBLE) / total AS y, CAST(1 AS DOUBLE) / total AS h, least(CAST(1 AS DOUBLE), length(body) / CAST(500 AS DOUBLE)) AS w, total
            FROM (SELECT page_id, type, pos, body, count(*) OVER (PARTITION BY page_id) AS total FROM {blocks}) a) b GROUP BY page_id, type) c""",
    ),
    "layout_grid": (["A01", "P10"], ["blocks"], "SELECT page_id, least(3, CAST(floor(4 * CAST(pos AS DOUBLE) / total) AS BIGINT)) AS grid_row, type, count(*) AS blocks FROM (SELECT page_id, type, pos, count(*) OVER (PARTITION BY page_id) AS total FROM {blocks}) a GROUP BY 1, 2, 3"),
    "feature_tokens": (["F26"], ["blocks"], "SELECT page_id, pos, CASE WHEN t = '' THEN 'unknown' ELSE t END AS token FROM (SELECT page_id, pos, substring(regexp_replace(lower(body), '[^a-z0-9_]+', '_'@G), 1, 80) AS t FROM {blocks}) a"),
    "evidence_redaction": (["P35"], ["blocks"], "SELECT page_id, pos, type, CAST(length(body) AS BIGINT) AS characters, substring(body, 1, 160) AS preview FROM {blocks}"),
    "evidence_hash": (["C01", "D27"], ["webpages"], "SELECT page_id, @SHA256(html) AS content_sha256, CAST(length(html) AS BIGINT) AS size FROM {webpages}"),
    "replacement_characters": (["F22"], ["pages"], "SELECT doc_id, CAST(length(text) - length(replace(text, '�', '')) AS BIGINT) AS replaced FROM {pages}"),
    "feature_standardise": (["A22"], ["components"], "SELECT feature, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-8 THEN CAST(1 AS DOUBLE) ELSE stddev_pop(x) END, 6) AS std FROM {components} GROUP BY feature"),
    "class_weights": (["A23"], ["components"], "SELECT label, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT label, CAST(1 AS DOUBLE) / count(*) AS w FROM {components} WHERE feature = 0 GROUP BY label) t"),
    "ood_bounds": (["A26", "A06"], ["components"], "SELECT label, round(CAST(0.25 AS DOUBLE) * @QUANTILE(l1, 0.005), 6) AS low, round(CAST(4 AS DOUBLE) * @QUANTILE(l1, 0.995) + CAST(1e-9 AS DOUBLE), 6) AS high FROM (SELECT vec_id, label, sum(abs(x)) AS l1 FROM {components} GROUP BY vec_id, label) t GROUP BY label"),
    "ood_gate": (["A06"], ["components"], "SELECT vec_id, round(count_if(x <> 0 AND feature < 48) / CAST(count_if(x <> 0) AS DOUBLE), 6) AS known_fraction, round(sum(abs(x)), 5) AS l1, sum(abs(x)) NOT BETWEEN 4 AND 9 AS ood FROM {components} GROUP BY vec_id"),
    "dense_pivot": (["A36"], ["components"], "SELECT vec_id, " + ", ".join(f"round(coalesce(max(CASE WHEN feature = {i} THEN x END), 0), 6) AS f{i}" for i in (0, 7, 31, 99)) + " FROM {components} GROUP BY vec_id"),
    # classification
    "linear_scores": (["J07", "D12"], ["components"], f"SELECT vec_id, label_class, round(z, 6) AS z FROM ({SCORES}) s"),
    "softmax_probabilities": (["A05", "D13"], ["components"], f"SELECT vec_id, label_class, round(p, 6) AS p FROM ({SOFTMAX}) s"),
    "softmax_top2_margin": (["W05", "T02"], ["components"], f"SELECT vec_id, top, round(p1, 6) AS p1, round(p1 - p2, 6) AS margin FROM ({TOP2}) s"),
    "acceptance": (["P20", "P21"], ["components"], f"SELECT vec_id, top, p1 >= greatest(CAST(0.3 AS DOUBLE), CASE top WHEN 0 THEN 0.32 WHEN 1 THEN 0.28 ELSE 0.3 END) AND p1 - p2 >= 0.05 AS accepted FROM ({TOP2}) s"),
    "cascade_decision": (
        ["C10", "P19", "A33", "C09"], ["components"],
        f"SELECT decision, count(*) AS vectors FROM (SELECT CASE WHEN p1 >= 0.5 THEN 'rule' WHEN p1 >= 0.35 AND p1 - p2 >= 0.05 THEN 'layout' WHEN p1 >= 0.3 AND p1 - p2 >= 0.02 THEN 'text' WHEN p1 - p2 < 0.02 THEN 'abstain_margin' ELSE 'abstain_probability' END AS decision FROM ({TOP2}) s) t GROUP BY decision",
    ),
    "entropy_margin": (["A29", "C20"], ["components"], f"SELECT vec_id, round(-sum(p * ln(p)) / ln(CAST(4 AS DOUBLE)), 6) AS entropy, -sum(p * ln(p)) / ln(CAST(4 AS DOUBLE)) >= 0.65 AS eligible FROM ({SOFTMAX}) s GROUP BY vec_id"),
    "region_runs": (["A04", "D16", "W13"], ["pages"], "SELECT doc, lang, min(page) AS first, max(page) AS last, count(*) AS pages FROM (SELECT doc, page, lang, page - row_number() OVER (PARTITION BY doc, lang ORDER BY page) AS island FROM {pages}) t GROUP BY doc, lang, island"),
    "first_body_page": (["W02", "W04", "C12"], ["pages"], "SELECT doc, page, lang FROM (SELECT doc, page, lang, coalesce(sum(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {pages}) t WHERE before = 0"),
    "separated_runs": (["W12", "J22"], ["pages"], "SELECT doc, lang, count(*) AS runs FROM (SELECT doc, lang, island, count(*) AS n FROM (SELECT doc, page, lang, page - row_number() OVER (PARTITION BY doc, lang ORDER BY page) AS island FROM {pages}) t GROUP BY doc, lang, island) u WHERE n >= 2 GROUP BY doc, lang HAVING count(*) >= 2"),
    "structured_runs": (["W14"], ["turns"], "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM {turns}"),
    "monotone_pages": (["W07"], ["pages"], "SELECT doc, bool_and(previous IS NULL OR previous <= n_chars) AS monotone, count_if(previous > n_chars) AS breaks FROM (SELECT doc, n_chars, lag(n_chars) OVER (PARTITION BY doc ORDER BY page) AS previous FROM {pages}) t GROUP BY doc"),
    "isolated_unsupported": (["W08"], ["judged"], "SELECT doc, doc_id FROM (SELECT doc, doc_id, accepted, lag(accepted) OVER (PARTITION BY doc ORDER BY doc_id) AS a, lead(accepted) OVER (PARTITION BY doc ORDER BY doc_id) AS b FROM {judged}) t WHERE NOT accepted AND a AND b"),
    "previous_heading": (["W10"], ["lines"], "SELECT doc_id, pos, max(CASE WHEN length(line) < 80 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading_pos FROM {lines}"),
    # navigation
    "navigation_lines": (["P15", "P16", "P17"], ["lines"], f"SELECT doc_id, pos, line FROM ({ENTRIES}) e WHERE {NAV}"),
    "entry_split": (["F08", "D17"], ["lines"], f"SELECT doc_id, pos, trim(regexp_replace(regexp_replace(line, '[ ]*[0-9]+$', ''), '[ .…]+$', '')) AS title, CASE WHEN {NAV} THEN regexp_extract(line, '([0-9]+)$', 1) ELSE '' END AS page FROM ({ENTRIES}) e"),
    "entry_identifiers": (["F06", "F07", "F12"], ["lines"], f"SELECT doc_id, pos, identifier, CAST(least(5, length(identifier) - length(replace(identifier, '.', ''))) AS BIGINT) AS depth FROM (SELECT doc_id, pos, replace(upper(regexp_extract(line, '^([0-9A-Za-z]+([.-][0-9]+)*)', 1)), '-', '.') AS identifier FROM ({ENTRIES}) e) t"),
    "section_metrics": (["A31", "A28"], ["lines"], f"SELECT doc_id, count(*) AS entries, count_if({NAV}) AS linked, count(*) - count_if({NAV}) AS unlinked, CAST(max(length(line)) AS BIGINT) AS max_line, count_if(length(line) > 240) AS long_lines FROM ({ENTRIES}) e GROUP BY doc_id"),
    "duplicate_entries": (["A28"], ["lines"], "SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) AS entries FROM (SELECT doc_id, lower(trim(line)) AS line, count(*) AS n FROM {lines} WHERE trim(line) <> '' GROUP BY doc_id, lower(trim(line))) t GROUP BY doc_id"),
    "heading_match_exact": (["J14", "J15", "J16"], ["lines"], "SELECT a.doc_id, a.pos, b.doc_id AS target_doc, b.pos AS target_pos FROM (SELECT doc_id, pos, lower(trim(line)) AS k FROM {lines} WHERE pos = 0 AND trim(line) <> '') a JOIN (SELECT k, min(doc_id) AS doc_id, min(pos) AS pos FROM (SELECT doc_id, pos, lower(trim(line)) AS k FROM {lines} WHERE trim(line) <> '') u GROUP BY k HAVING count(*) = 1) b ON a.k = b.k"),
    "native_tail_match": (["J17", "J18"], ["lines"], "SELECT a.doc_id, a.pos FROM (SELECT doc_id, pos, line || ' ' || coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '') AS window_text FROM {lines}) a @SEMI (SELECT DISTINCT doc_id, substring(line, 1, 12) AS head FROM {lines} WHERE length(line) >= 12 AND pos = 0) b ON a.doc_id = b.doc_id AND substring(a.window_text, 1, 12) = b.head"),
    "residue_anti": (["J23"], ["lines"], "SELECT a.doc_id, a.pos FROM {lines} a @ANTI (SELECT doc_id, substring(line, 1, 12) AS head FROM {lines} WHERE pos <= 2 AND length(line) >= 12) b ON a.doc_id = b.doc_id AND substring(a.line, 1, 12) = b.head"),
    "section_run_alignment": (["J19", "W05"], ["turns"], "SELECT conv_id, role, overlap FROM (SELECT conv_id, role, count(*) AS overlap, rank() OVER (PARTITION BY conv_id ORDER BY count(*) DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS k FROM {turns} GROUP BY conv_id, role) t WHERE r = 1"),
    "strip_markdown": (["F01", "F14"], ["webpages"], "SELECT page_id, trim(replace(replace(regexp_replace(html, '<[^>]+>', ''@G), '**', ''), '`', '')) AS plain FROM {webpages}"),
    "ansi_strip": (["F24", "X01"], ["lines"], "SELECT doc_id, pos, regexp_replace(chr(27) || '[1m' || line || chr(27) || '[0m', chr(27) || '.[0-9;]*m', ''@G) AS line FROM {lines}"),
    "navigation_kind": (["F05", "P18"], ["lines"], "SELECT doc_id, pos, CASE WHEN k IN ('contents', 'tableofcontents', 'sommaire', 'inhalt', 'indice') THEN 'contents' WHEN k IN ('listoffigures', 'listofillustrations') THEN 'figures' WHEN k = 'listoftables' THEN 'tables' END AS kind FROM (SELECT doc_id, pos, regexp_replace(regexp_replace(lower(CASE WHEN pos = 0 THEN 'List of Figures (continued)' WHEN pos = 1 THEN 'Contents' ELSE line END), '[ ]*[(]cont[.a-z]*[)]$', ''), '[^a-z]+', ''@G) AS k FROM {lines} WHERE pos < 4) t"),
    "debris_lines": (["F13", "C07", "C03", "C06"], ["lines"], "SELECT doc_id, count_if(length(line) > 500 AND @RLIKE(line, '[.] ?[.]')) AS debris, bool_and(length(line) > 500) AS all_long, 5 * count_if(length(line) < 80) >= 3 * count(*) AS dense FROM {lines} GROUP BY doc_id"),
    # metrics
    "class_metrics": (["A10", "D14"], ["judged"], f"SELECT class, support, predicted, tp, round(tp / CAST(nullif(predicted, 0) AS DOUBLE), 6) AS precision_, round(tp / CAST(nullif(support, 0) AS DOUBLE), 6) AS recall_, round(2 * tp / CAST(nullif(support + predicted, 0) AS DOUBLE), 6) AS f1 FROM ({CLASSES}) c"),
    "confusion": (["A11"], ["judged"], "SELECT gold, pred, count(*) AS n FROM {judged} GROUP BY gold, pred"),
    "abstention_summary": (["A12", "A33"], ["judged"], "SELECT count(*) AS total, count_if(accepted) AS accepted_n, round(count_if(accepted) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(count_if(accepted AND gold = pred) / CAST(nullif(count_if(accepted), 0) AS DOUBLE), 6) AS accepted_accuracy, round(count_if(accepted AND gold = pred) / CAST(count(*) AS DOUBLE), 6) AS overall_accuracy FROM {judged}"),
    "binary_metrics_sets": (["A13", "A15", "A18"], ["judged"], "SELECT quality, doc, count_if(gold = 1) AS present, count_if(gold = 0) AS absent, count_if(NOT accepted) AS abstained, round(count_if(gold = 1 AND pred = 1 AND accepted) / CAST(nullif(count_if(gold = 1), 0) AS DOUBLE), 6) AS recall_present, round(count_if(gold = 0 AND pred = 1 AND accepted) / CAST(nullif(count_if(gold = 0), 0) AS DOUBLE), 6) AS fpr, count(DISTINCT doc_id) AS documents FROM {judged} GROUP BY GROUPING SETS ((quality), (quality, doc), ())"),
    "macro_average": (["A15"], ["judged"], f"SELECT round(avg(tp / CAST(nullif(predicted, 0) AS DOUBLE)), 6) AS macro_precision, round(avg(tp / CAST(nullif(support, 0) AS DOUBLE)), 6) AS macro_recall, min(support) >= 20 AS gate FROM ({CLASSES}) c"),
    "exact_set_accuracy": (["A14"], ["judged"], "SELECT count(*) AS docs, count_if(right_n = n) AS exact, round(count_if(right_n = n) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM (SELECT doc, count(*) AS n, count_if(gold = pred AND accepted) AS right_n FROM {judged} GROUP BY doc HAVING count(*) >= 3) t"),
    "label_coverage": (["A16", "J09"], ["judged"], "SELECT gold, count(*) AS labels, count(DISTINCT doc) AS docs, count(DISTINCT doc_id) AS pages FROM {judged} GROUP BY gold"),
    "first_page_error": (["A17"], ["judged"], "SELECT count_if(g = p) AS exact, count_if(p IS NULL) AS missing, round(avg(abs(g - p)), 6) AS mae FROM (SELECT doc, min(CASE WHEN gold = 1 THEN doc_id END) AS g, min(CASE WHEN pred = 1 AND accepted THEN doc_id END) AS p FROM {judged} GROUP BY doc) t WHERE g IS NOT NULL"),
    "roc_auc": (["A20", "W17"], ["judged"], "SELECT round((sum(CASE WHEN gold = 1 THEN r END) - CAST(count_if(gold = 1) AS DOUBLE) * (count_if(gold = 1) + 1) / 2) / (CAST(count_if(gold = 1) AS DOUBLE) * count_if(gold = 0)), 6) AS auc FROM (SELECT j.gold, b.below + (b.ties + 1) / CAST(2 AS DOUBLE) AS r FROM {judged} j JOIN (SELECT prob, ties, CAST(coalesce(sum(ties) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS below FROM (SELECT prob, count(*) AS ties FROM {judged} GROUP BY prob) t) b ON j.prob = b.prob) u"),
    "average_precision": (["A20"], ["judged"], "SELECT round(sum(pos * (tp / CAST(n AS DOUBLE))) / sum(pos), 6) AS ap FROM (SELECT pos, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(ties) OVER (ORDER BY prob DESC) AS n FROM (SELECT prob, count(*) AS ties, CAST(sum(gold) AS DOUBLE) AS pos FROM {judged} GROUP BY prob) t) u"),
    "brier": (["A19", "A20"], ["judged"], "SELECT round(avg((prob - gold) * (prob - gold)), 6) AS brier FROM {judged}"),
    "ece": (["A19"], ["judged"], "SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM (SELECT least(9, floor(prob * CAST(10 AS DOUBLE))) AS bin, CAST(count(*) AS DOUBLE) AS n, avg(CAST(gold AS DOUBLE)) AS acc, avg(prob) AS conf FROM {judged} GROUP BY least(9, floor(prob * CAST(10 AS DOUBLE)))) t"),
    "coverage_risk": (["A19"], ["judged"], "SELECT t.threshold, count_if(conf >= t.threshold) AS accepted, round(count_if(conf >= t.threshold AND gold <> pred) / CAST(nullif(count_if(conf >= t.threshold), 0) AS DOUBLE), 6) AS risk FROM (SELECT gold, pred, greatest(prob, 1 - prob) AS conf FROM {judged}) j JOIN (SELECT CAST(0.5 AS DOUBLE) AS threshold UNION ALL SELECT CAST(0.6 AS DOUBLE) UNION ALL SELECT CAST(0.7 AS DOUBLE) UNION ALL SELECT CAST(0.8 AS DOUBLE) UNION ALL SELECT CAST(0.9 AS DOUBLE)) t ON t.threshold > 0 GROUP BY t.threshold"),
    "threshold_policy": (["A21"], ["judged"], "SELECT min(prob) AS threshold, max(n) AS accepted FROM (SELECT prob, n, tp / CAST(n AS DOUBLE) AS precision_ FROM (SELECT prob, sum(ties) OVER (ORDER BY prob DESC) AS n, sum(pos) OVER (ORDER BY prob DESC) AS tp FROM (SELECT prob, count(*) AS ties, CAST(sum(gold) AS BIGINT) AS pos FROM {judged} GROUP BY prob) t) u) v WHERE n >= 5 AND precision_ >= 0.995".replace("max(n) AS accepted", "CAST(max(n) AS BIGINT) AS accepted")),
    "temperature_grid": (["A25"], ["judged"], f"SELECT temperature, round(nll, 6) AS nll, rank_ = 1 AS best FROM (SELECT temperature, nll, row_number() OVER (ORDER BY round(nll, 9), temperature) AS rank_ FROM (SELECT g.temperature, avg(ln(1 + exp(CASE WHEN gold = 1 THEN -z ELSE z END / g.temperature))) AS nll FROM (SELECT gold, ln(greatest(prob, CAST(1e-6 AS DOUBLE)) / greatest(1 - prob, CAST(1e-6 AS DOUBLE))) AS z FROM {{judged}}) j JOIN ({TEMPERATURES}) g ON g.temperature > 0 GROUP BY g.temperature) t) u"),
    "split_summary": (["A27", "F20"], ["judged"], "SELECT split, count(*) AS labels, count(DISTINCT doc) AS docs, count_if(gold = 1) AS positive FROM (SELECT *, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT *, @SPLITHASH AS h FROM {judged}) a) b GROUP BY split"),
    "review_rank": (["T03", "T07"], ["judged"], "SELECT doc_id, doc, prob, rank_ FROM (SELECT doc_id, doc, prob, row_number() OVER (ORDER BY abs(prob - CAST(0.5 AS DOUBLE)), doc, doc_id) * CAST(1 AS BIGINT) AS rank_ FROM {judged} WHERE NOT accepted OR abs(prob - 0.5) <= 0.2) t WHERE rank_ <= 500"),
    "priority_pick": (["T07", "D24"], ["judged"], "SELECT doc, doc_id, priority FROM (SELECT doc, doc_id, priority, row_number() OVER (PARTITION BY doc ORDER BY priority DESC, doc_id) AS r FROM (SELECT doc, doc_id, CASE WHEN gold = 1 AND accepted THEN CAST(100 AS BIGINT) WHEN accepted THEN CAST(90 AS BIGINT) ELSE CAST(80 AS BIGINT) END AS priority FROM {judged}) a) t WHERE r = 1"),
    # governance
    "annotation_violations": (["P24", "D23"], ["judged", "pages"], "SELECT j.doc_id, p.doc_id IS NULL AS unknown_doc, j.prob NOT BETWEEN 0 AND 1 AS bad_prob, count(*) OVER (PARTITION BY j.doc_id) > 1 AS duplicate FROM {judged} j LEFT JOIN {pages} p ON j.doc_id = p.doc_id"),
    "manifest_violations": (["P26", "P27", "P28", "D24"], ["webpages"], "SELECT page_id, NOT @RLIKE(url, '^https://') AS not_https, @RLIKE(url, '[.][.]') AS escapes, copies > 1 AS duplicate_url FROM (SELECT page_id, url, count(*) OVER (PARTITION BY url) AS copies FROM {webpages}) t"),
    "corpus_select": (["P30", "J11"], ["pages"], "SELECT doc_id, doc, lang FROM {pages} WHERE lang IN ('en', 'de') OR doc_id % 50 = 7"),
    "selection_cover": (["J08", "J05"], ["pages", "judged"], f"SELECT doc_id, idx, first, last FROM (SELECT l.doc_id, s.idx, s.first, s.last, row_number() OVER (PARTITION BY l.doc_id ORDER BY s.last - s.first, s.idx) AS r FROM ({LABELLED}) l JOIN ({SELECTIONS}) s ON l.source = s.source AND l.page BETWEEN s.first AND s.last) t WHERE r = 1"),
    "context_selection": (["J10"], ["pages", "judged"], f"SELECT source, idx, CASE WHEN idx IS NULL THEN 'unavailable' WHEN last > first THEN 'context' ELSE 'isolated_fallback' END AS state FROM (SELECT l.source, s.idx, s.first, s.last, row_number() OVER (PARTITION BY l.source ORDER BY CASE WHEN s.last > s.first THEN 0 ELSE 1 END, s.last - s.first, s.idx) AS r FROM (SELECT source, min(page) AS lo, min(page) + 1 AS hi FROM ({LABELLED}) a GROUP BY source) l LEFT JOIN ({SELECTIONS}) s ON l.source = s.source AND s.first <= l.lo AND s.last >= l.hi) t WHERE r = 1"),
    "bootstrap_anti": (["J12"], ["pages", "judged"], "SELECT p.doc_id, p.page FROM {pages} p @ANTI (SELECT doc_id FROM {judged} WHERE accepted) o ON p.doc_id = o.doc_id"),
    "review_export": (["J13"], ["pages", "judged"], "SELECT DISTINCT j.doc, p.lang, j.gold FROM {judged} j JOIN {pages} p ON j.doc_id = p.doc_id WHERE NOT j.accepted"),
    "schema_union": (["J26", "U05"], ["pages", "webpages"], "SELECT 'document' AS source_kind, doc_id AS id, n_chars AS size FROM {pages} UNION ALL SELECT 'page', page_id, CAST(length(html) AS BIGINT) FROM {webpages}"),
    "detector_block_match": (["J24"], ["blocks"], "SELECT a.page_id, a.pos, b.pos AS detection FROM (SELECT page_id, pos, type, length(body) AS n, row_number() OVER (PARTITION BY page_id, type, length(body) ORDER BY pos) AS k FROM {blocks}) a JOIN (SELECT page_id, pos, type, length(body) AS n, row_number() OVER (PARTITION BY page_id, type, length(body) ORDER BY pos) AS k FROM {blocks} WHERE pos % 3 <> 1) b ON a.page_id = b.page_id AND a.type = b.type AND a.n = b.n AND a.k = b.k"),
    "front_eval_rule": (["C16", "J11"], ["pages"], "SELECT doc, n, CASE WHEN toc IS NOT NULL THEN least(greatest(toc + 8, 12), 40, n) WHEN n > 30 THEN least(24, n) ELSE least(12, n) END AS last_page FROM (SELECT doc, count(*) AS n, max(CASE WHEN n_chars < 300 AND page <= 32 THEN page END) AS toc FROM {pages} GROUP BY doc) t"),
    "navigation_state": (["C17", "C13", "C14"], ["judged"], "SELECT j.doc_id, k.kind, CASE WHEN NOT j.accepted THEN 'abstain' WHEN (j.doc_id + k.kind) % 3 = 0 AND j.pred = 1 THEN 'present' ELSE 'absent' END AS state FROM {judged} j CROSS JOIN (SELECT CAST(0 AS BIGINT) AS kind UNION ALL SELECT CAST(1 AS BIGINT) UNION ALL SELECT CAST(2 AS BIGINT)) k"),
    "path_collisions": (["P27"], ["webpages"], "SELECT a.page_id, b.page_id AS other FROM {webpages} a JOIN {webpages} b ON regexp_extract(a.url, '^([^?#]+)', 1) = regexp_extract(b.url, '^([^?#]+)', 1) AND a.page_id < b.page_id"),
    "run_similarity": (["U03"], ["words"], "SELECT a.doc_id, b.doc_id AS other, count(*) AS overlap FROM (SELECT DISTINCT doc_id, word FROM {words} WHERE length(word) > 14) a JOIN (SELECT DISTINCT doc_id, word FROM {words} WHERE length(word) > 14) b ON a.word = b.word AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 4"),
    "profile_mapping": (["P07", "D02"], ["judged"], "SELECT doc_id, CASE gold WHEN 1 THEN 'hybrid' ELSE 'pipeline' END AS backend, CASE WHEN prob > 0.7 THEN 'high' WHEN prob > 0.3 THEN 'medium' ELSE 'low' END AS effort, accepted AND gold = 1 AS image_analysis FROM {judged}"),
    "error_taxonomy": (["P37"], ["judged"], "SELECT doc_id, code, code IN ('TIMEOUT', 'SERVICE') AS retryable FROM (SELECT doc_id, CASE WHEN accepted THEN 'OK' WHEN gold = 1 THEN 'TIMEOUT' ELSE 'INVALID_PAGES' END AS code FROM {judged}) t"),
    "finite_checks": (["P08", "P29"], ["components"], "SELECT vec_id, count_if(x BETWEEN 0 AND 1) AS probabilities, bool_and(abs(x) <= 1e7) AS bounded FROM {components} GROUP BY vec_id"),
    "model_approval": ([], ["judged"], "SELECT doc, length(digest) = 64 AND digest = expected AND bool_and_ok AS approved FROM (SELECT doc, @SHA256(doc || '|' || CAST(sum(gold) AS @STR)) AS digest, @SHA256(doc || '|' || CAST(sum(pred) AS @STR)) AS expected, count_if(accepted) * 2 >= count(*) AS bool_and_ok FROM {judged} GROUP BY doc) t"),
    "artifact_validation": (["P23"], ["components"], "SELECT label, count(DISTINCT feature) AS features, count(*) = count(DISTINCT feature) * count(DISTINCT vec_id) AS complete, max(abs(x)) < 1e6 AS finite, round(min(x), 6) AS low, round(max(x), 6) AS high FROM {components} GROUP BY label"),
    "provenance_binding": ([], ["judged", "pages"], "SELECT p.doc, count(*) AS pages, count(j.doc_id) AS labels, count(j.doc_id) <= count(*) * 3 AS bounded, count_if(j.gold = 1) AS present FROM {pages} p LEFT JOIN {judged} j ON p.doc_id = j.doc_id GROUP BY p.doc"),
    "result_fields": (["P34"], ["pages"], "SELECT doc_id, text AS markdown, CAST(n_chars AS BIGINT) AS characters FROM {pages} WHERE n_chars > 0"),
    "display_labels": (["P36"], ["lines"], "SELECT doc_id, pos, replace(replace(substring(trim(line), 1, 60), '[', '('), ']', ')') || CASE WHEN length(trim(line)) > 60 THEN '…' ELSE '' END AS label FROM {lines} WHERE trim(line) <> ''"),
    "navigation_by_page": (["J06", "D15"], ["links"], "SELECT page_id, kind, count(*) AS blocks, bool_and(length(href) <= 120) AS valid FROM (SELECT page_id, href, CASE WHEN length(href) < 5 THEN 'short' WHEN length(href) < 9 THEN 'middle' ELSE 'long' END AS kind FROM {links}) t GROUP BY page_id, kind"),
    "candidate_fields": (["F27", "D13"], ["judged"], "SELECT doc_id, CASE WHEN accepted THEN 'rule' WHEN gold = 1 THEN 'layout' ELSE 'text' END AS stage, coalesce(CASE WHEN accepted THEN prob END, 1 - prob) AS score, CASE WHEN @RLIKE('low_probability', '^[a-z_]{{1,40}}$') AND NOT accepted THEN 'low_probability' END AS reason FROM {judged}"),
    "candidate_blocks_added": (["C11"], ["lines"], "SELECT doc_id, count(*) AS blocks FROM (SELECT doc_id, line FROM {lines} WHERE pos <= 3 UNION SELECT doc_id, line FROM {lines} WHERE pos BETWEEN 2 AND 6) t GROUP BY doc_id"),
    "report_cache": (["C15"], ["pages", "judged"], "SELECT p.doc_id, CASE WHEN j.doc_id IS NULL THEN 'miss' WHEN md5(p.text) = md5(p.text || CASE WHEN j.accepted THEN '' ELSE '!' END) THEN 'hit' ELSE 'stale' END AS state FROM {pages} p LEFT JOIN {judged} j ON p.doc_id = j.doc_id"),
    "outline_hints": ([], ["lines"], "SELECT doc_id, pos, CASE WHEN @RLIKE(lower(line), '^(chapter|part|1[. ])') THEN 'body_start' WHEN @RLIKE(lower(line), '^(the|der|le|el) ') THEN 'preface' WHEN pos = 0 THEN 'cover' END AS hint FROM {lines} WHERE pos <= 2"),
    "structured_entries": ([], ["lines"], f"SELECT doc_id, count(*) AS entries, count_if({NAV}) AS paged, 5 * count_if({NAV}) >= 3 * count(*) AND count(*) >= 3 AS trusted FROM ({ENTRIES}) e GROUP BY doc_id"),
    "caption_targets": ([], ["lines"], "SELECT a.doc_id, a.pos AS entry_pos, min(b.pos) AS caption_pos FROM (SELECT doc_id, pos, split_part(line, ' ', 1) AS k FROM {lines} WHERE pos < 3) a JOIN (SELECT doc_id, pos, split_part(line, ' ', 1) AS k FROM {lines} WHERE pos >= 3) b ON a.doc_id = b.doc_id AND a.k = b.k WHERE a.k <> '' GROUP BY a.doc_id, a.pos"),
    "range_ownership": ([], ["lines"], "SELECT doc_id, count(*) AS records, count_if(backed) AS supported, count(*) >= 3 AND 4 * count_if(backed) >= 3 * count(*) AS owned FROM (SELECT a.doc_id, a.pos, b.doc_id IS NOT NULL AS backed FROM {lines} a LEFT JOIN (SELECT doc_id, substring(line, 1, 10) AS k, min(pos) AS pos FROM {lines} WHERE length(line) >= 10 GROUP BY doc_id, substring(line, 1, 10)) b ON a.doc_id = b.doc_id AND substring(a.line, 1, 10) = b.k AND b.pos < a.pos WHERE length(a.line) >= 10) t GROUP BY doc_id"),
    "section_notes": ([], ["lines"], "SELECT doc_id, pos, line FROM {lines} WHERE length(trim(line)) BETWEEN 40 AND 240 AND NOT @RLIKE(line, '[0-9]$') AND @RLIKE(line, '[.]$')"),
    "published_pages": (["U05"], ["pages"], "SELECT doc, page, CASE WHEN count(*) OVER (PARTITION BY doc) > 1 THEN '## Pages ' || CAST(page AS @STR) || chr(10) ELSE '' END || text AS markdown FROM {pages}"),
    "bounded_log": (["X02"], ["events"], "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM {events}) t WHERE r <= 40"),
    "event_progress": (["X03", "X07", "D26"], ["events"], "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {events}) t WHERE value IS NOT NULL AND (top IS NULL OR value > top)"),
    "event_terminal": (["X04"], ["events"], "SELECT user_id, event_type, count(*) AS events, round(max(value), 6) AS highest FROM {events} GROUP BY user_id, event_type"),
    "entry_digits": (["F09", "F11", "F33"], ["lines"], f"SELECT doc_id, pos, regexp_replace(regexp_extract(line, '([0-9 ]+)$', 1), ' ', ''@G) AS page, upper(regexp_extract(line, '^([0-9]+)', 1)) AS prefix FROM ({ENTRIES}) e"),
    "repeated_sections": (["W13"], ["turns"], "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM {turns}) t WHERE before IS NULL OR before <> role"),
    "leading_window": ([], ["pages"], "SELECT doc, page, count_if(lang = 'en') OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead8, count_if(lang = 'en') OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS behind12 FROM {pages}".replace("count_if(lang = 'en') OVER", "count(CASE WHEN lang = 'en' THEN 1 END) OVER")),
}
