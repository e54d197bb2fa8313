"""The same results as DuckDB SQL, derived another way: RE2 scans over marked digit runs instead of Python's."""

from __future__ import annotations

import re

from ..functions import scan
from ..sources import sinks

M = "¦"  # put after each run of digits: RE2 has no look-ahead
_FRACTION = rf"(?:[.,][0-9]{{1,9}}{M})?"
BODY = "|".join(rf"[0-9]{{1,3}}{M}(?:[{s}][0-9]{{3}}{M}){{1,8}}{_FRACTION}" for s in (" ", "''’", ".,")) + rf"|[0-9]+{M}{_FRACTION}"
NUMERAL = rf"\(?[-−–+]?(?:[$€£¥₹]\s?)?(?:{BODY})(?:\s?%)?\)?"
WORD = r"[\p{L}\p{Nl}\p{No}](?:[\p{L}\p{N}_''’-]*[\p{L}\p{N}])?"
STOP = ", ".join(f"'{w}'" for w in sorted(scan.STOPWORDS))


def _count(text: str, c: str) -> str:
    return f"(length({text}) - length(replace({text}, '{c}', '')))"


def canonical(s: str) -> str:
    whole, part = f"ltrim(split_part({s}, '.', 1), '0')", f"rtrim(split_part({s}, '.', 2), '0')"
    return f"(CASE WHEN {whole} = '' THEN '0' ELSE {whole} END || CASE WHEN {part} = '' THEN '' ELSE '.' || {part} END)"


def hits(src: str, key: str, pattern: str, marked: bool) -> str:
    """key, i, hit, start, fin of a pattern's matches; src: key, t."""
    m = f"regexp_replace(t, '([0-9]+)', '\\1{M}', 'g')" if marked else "t"
    size = f"length(replace({{}}, '{M}', ''))" if marked else "length({})"
    return f"""SELECT {key}, i, hit, fin - {size.format("hit")} AS start, fin FROM (
        SELECT {key}, i, hit, sum({size.format("gap")} + {size.format("hit")}) OVER (PARTITION BY {key} ORDER BY i) AS fin FROM (
            SELECT {key}, unnest(range(1, len(h) + 1)) AS i, unnest(g) AS gap, unnest(h) AS hit FROM (
                SELECT {key}, regexp_extract_all(m, '(?s)(.*?)({pattern}|$)', 1) AS g, regexp_extract_all(m, '(?s)(.*?)({pattern}|$)', 2) AS h
                FROM (SELECT {key}, {m} AS m FROM ({src}))))) WHERE hit <> ''"""


def numerals(src: str, key: str, locale: str = "und") -> str:
    """key, num_pos, text, start, fin, readings, note; src: key, t."""
    b = f"replace(replace(replace(replace(body, ' ', ''), '''', ''), '’', ''), '{M}', '')"
    dots, commas = _count("b", "."), _count("b", ",")
    if locale == "und":
        sep = "CASE WHEN instr(b, '.') > 0 THEN '.' ELSE ',' END"
        raw = f"""CASE WHEN {dots} + {commas} = 0 THEN [b]
            WHEN {dots} > 0 AND {commas} > 0 THEN CASE
                WHEN instr(reverse(b), '.') < instr(reverse(b), ',') THEN CASE WHEN {dots} = 1 THEN [replace(b, ',', '')] ELSE [] END
                ELSE CASE WHEN {commas} = 1 THEN [replace(replace(b, '.', ''), ',', '.')] ELSE [] END END
            WHEN {dots} + {commas} > 1 THEN [replace(b, {sep}, '')]
            WHEN length(split_part(b, {sep}, 2)) <> 3 THEN [replace(b, {sep}, '.')]
            ELSE [replace(b, {sep}, ''), replace(b, {sep}, '.')] END"""
        note = f"CASE WHEN {dots} + {commas} > 1 AND ({dots} = 0 OR {commas} = 0) THEN 'separator_repeated' WHEN {dots} + {commas} = 1 AND length(split_part(b, {sep}, 2)) = 3 THEN 'grouping_vs_decimal' ELSE '' END"
    else:
        decimal, group = scan.LOCALES[locale]
        plain = f"replace(replace(b, '{group}', ''), '{decimal}', '.')"
        raw = f"CASE WHEN {_count('b', decimal)} <= 1 THEN [{plain}] ELSE [] END"
        note = "''"
    signed = f"list_transform(raw, lambda x: CASE WHEN negative AND {canonical('x')} <> '0' THEN '-' ELSE '' END || {canonical('x')})"
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS num_pos, replace(hit, '{M}', '') AS text, start, fin, {signed} AS readings, note FROM (
        SELECT *, {raw} AS raw, {note} AS note FROM (
            SELECT *, {b} AS b, regexp_matches(hit, '^\\(?[-−–]') OR (starts_with(hit, '(') AND ends_with(hit, ')')) AS negative FROM (
                SELECT *, regexp_extract(hit, '({BODY})', 1) AS body FROM ({hits(src, key, NUMERAL, True)})))
        WHERE length(regexp_replace(b, '[^0-9]', '', 'g')) >= 2) WHERE len(raw) > 0"""


DOCS = "SELECT doc_id, text AS t FROM documents"
_SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normalised(t: str) -> str:
    """For texts that are composed already."""
    out = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '[\\x{{AD}}\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t\\x0B\\f]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^{_SPACES}|{_SPACES}$', '', 'g')"


def words(src: str, key: str) -> str:
    """key, start, fin, word, kind of words that share no character with a numeral; src: key, t."""
    return f"""WITH n AS ({numerals(src, key)}), w AS ({hits(src, key, WORD, False)}),
        spans AS (SELECT {key}, list(struct_pack(a := start, z := fin)) AS s FROM n GROUP BY {key})
        SELECT w.{key}, w.start, w.fin, w.hit AS word, CASE WHEN lower(w.hit) IN ({STOP}) THEN 'skipped' ELSE 'lexical' END AS kind
        FROM w LEFT JOIN spans ON w.{key} = spans.{key}
        WHERE spans.s IS NULL OR len(list_filter(spans.s, lambda x: x.a < w.fin AND x.z > w.start)) = 0"""


_KEYED = "SELECT conv_id * 100000 + turn AS k, text AS t FROM conversations"
_CLAIMS = """SELECT o_orderkey, o_orderkey::VARCHAR AS case_id, o_orderkey % 7 = 0 AS is_defect, format('{:,.2f}', o_totalprice) AS total,
    CASE WHEN o_orderkey % 7 = 0 THEN format('{:.2f}', o_totalprice + 1000) WHEN o_orderkey % 7 <= 3 THEN format('{:,.2f}', o_totalprice) ELSE format('{:.2f}', o_totalprice) END AS claim FROM orders"""
_INVOICE_ANSWER = f"SELECT case_id, 'The order ' || case_id || ' total amount due is ' || claim || ' dollars payable within 30 days' AS t FROM ({_CLAIMS})"
_INVOICE_SOURCE = f"SELECT case_id, 'Order ' || case_id || ': total amount due ' || total || ' dollars, payable within 30 days' AS t FROM ({_CLAIMS})"
_NUMBER_ANSWER = f"SELECT case_id, concat_ws('; ', case_id, claim, '30', '45', '12.50') AS t FROM ({_CLAIMS})"
_NUMBER_SOURCE = f"SELECT case_id, concat_ws('; ', case_id, total, '30', '12.5') AS t FROM ({_CLAIMS})"


def _channels(answer: str, source: str) -> str:
    """CTEs a (answers' numerals with support), s (sources'), near (first nearest source numeral), carry (first with a value in common)."""
    far = "abs(r.r - v) / greatest(abs(r.r), abs(v), 1.0)"
    return f"""a0 AS MATERIALIZED ({numerals(answer, "case_id")}), s AS MATERIALIZED ({numerals(source, "case_id")}),
        sr AS (SELECT case_id, num_pos AS src_num, text, unnest(readings) AS reading FROM s),
        carry AS MATERIALIZED (SELECT case_id, x.num_pos, arg_min(sr.text, src_num) AS evidence_text FROM (SELECT case_id, num_pos, unnest(readings) AS reading FROM a0) x JOIN sr USING (case_id, reading) GROUP BY 1, 2),
        a AS MATERIALIZED (SELECT a0.*, CASE WHEN carry.case_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS support FROM a0 LEFT JOIN carry USING (case_id, num_pos)),
        r AS (SELECT case_id, num_pos AS src_num, text AS evidence_text, unnest(range(1, len(readings) + 1)) AS rd, unnest(readings)::DOUBLE AS r FROM s),
        near AS MATERIALIZED (SELECT case_id, num_pos, n.t AS evidence_text, n.d AS distance FROM (SELECT a.case_id, a.num_pos, min(struct_pack(d := {far}, i := src_num, rd := rd, t := r.evidence_text)) AS n
            FROM (SELECT case_id, num_pos, readings[1]::DOUBLE AS v FROM a) a JOIN r ON r.case_id = a.case_id GROUP BY 1, 2))"""


def _lexical(answers: str, sources: str, links: str) -> str:
    """CTEs up to lex: key, start, fin, word, support, evidence_id, evidence_text, exact of each word of the answers.

    answers: key, t; sources: sid, src_id, t; links: key, pos, sid. Ties go to the earlier
    source, then to the answer's earlier token, then to the source's.
    """
    token = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

    def tokens(src: str, key: str) -> str:
        return f"SELECT {key}, start + j AS start, least(start + j + 4, fin) AS fin, substr(hit, j + 1, 4) AS piece FROM (SELECT *, unnest(range(0, length(hit), 4)) AS j FROM ({hits(src, key, token, False)}))"

    edges = f"[{re.escape(scan.EDGES)}]".replace("'", "''")
    return rf"""ans AS MATERIALIZED ({answers}), src AS MATERIALIZED ({sources}), links AS MATERIALIZED ({links}),
        words AS MATERIALIZED ({words("SELECT key, t FROM ans", "key")}),
        atok AS MATERIALIZED ({tokens("SELECT key, t FROM ans", "key")}),
        every AS MATERIALIZED (SELECT *, regexp_matches(piece, '[\p{{L}}\p{{N}}]') AS lettered FROM ({tokens("SELECT sid, t FROM src", "sid")})),
        stok AS MATERIALIZED (SELECT * FROM every WHERE lettered OR sid NOT IN (SELECT sid FROM every WHERE lettered)),
        pieces AS MATERIALIZED (SELECT piece, row_number() OVER () AS pid FROM (SELECT piece FROM atok UNION SELECT piece FROM stok)),
        grams AS (SELECT pid, sha256(unnest(list_transform(range(1, length(piece) + 1), lambda i: substr(' ' || lower(piece) || ' ', i, 3)))) AS h FROM pieces),
        coordinates AS (SELECT pid, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS x FROM grams GROUP BY 1, 2),
        vectors AS MATERIALIZED (SELECT p.pid, list(coalesce(x, 0)::DOUBLE ORDER BY d.i) AS v FROM (pieces p CROSS JOIN (SELECT unnest(range(64)) AS i) d) LEFT JOIN coordinates c ON c.pid = p.pid AND c.i = d.i GROUP BY 1),
        wtok AS MATERIALIZED (SELECT w.key, w.start AS word_start, t.start, pid FROM words w JOIN atok t ON t.key = w.key AND t.start < w.fin AND t.fin > w.start JOIN pieces USING (piece) WHERE w.kind = 'lexical'),
        pairs AS MATERIALIZED (SELECT w.key, w.word_start, l.pos, l.sid, w.pid AS p, q.pid AS q, w.start AS a, s.start AS b, s.fin AS z FROM wtok w JOIN links l ON l.key = w.key JOIN stok s ON s.sid = l.sid JOIN pieces q ON q.piece = s.piece),
        near_pairs AS MATERIALIZED (SELECT p, q, round(list_inner_product(x.v, y.v) / greatest(sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)), 1e-9), 9) AS c FROM (SELECT DISTINCT p, q FROM pairs) JOIN vectors x ON x.pid = p JOIN vectors y ON y.pid = q),
        by_source AS (SELECT key, word_start, pos, sid, max(struct_pack(c := c, a := -a, b := -b, z := z)) AS m FROM pairs JOIN near_pairs USING (p, q) GROUP BY 1, 2, 3, 4),
        best AS (SELECT key, word_start, max(struct_pack(c := least(1.0::DOUBLE, greatest(0.0::DOUBLE, m.c)), pos := -pos, sid := sid, b := -m.b, z := m.z)) AS m FROM by_source GROUP BY 1, 2),
        runs AS (SELECT * FROM ({hits("SELECT sid, t FROM src", "sid", r"[^\s]+", False)})),
        placed AS (SELECT best.key, word_start, m, src_id, t, regexp_replace(regexp_replace(hit, '^{edges}+', ''), '{edges}+$', '') AS core FROM best JOIN src ON src.sid = m.sid JOIN runs r ON r.sid = m.sid AND r.start <= m.b AND r.fin > m.b),
        lex AS MATERIALIZED (SELECT w.key, w.start, w.fin, w.word, coalesce(m.c, 0.0) AS support, src_id AS evidence_id, CASE WHEN core = '' THEN substr(t, m.b::BIGINT + 1, (m.z - m.b)::BIGINT) ELSE core END AS evidence_text,
            coalesce(regexp_matches(' ' || lower(t) || ' ', '[^\p{{L}}\p{{N}}_]' || regexp_escape(lower(w.word)) || '[^\p{{L}}\p{{N}}_]'), false) AS exact
            FROM words w LEFT JOIN placed p ON p.key = w.key AND p.word_start = w.start WHERE w.kind = 'lexical')"""


_INVOICES = f"WITH {_channels(_INVOICE_ANSWER, _INVOICE_SOURCE)}"
_NUMBERS = f"""WITH {_channels(_NUMBER_ANSWER, _NUMBER_SOURCE)},
    anchors AS (SELECT a.case_id, a.num_pos, a.text, a.start, a.fin, a.support, a.note, len(a.readings) AS n_readings, a.readings, coalesce(carry.evidence_text, near.evidence_text) AS evidence_text
        FROM a LEFT JOIN near USING (case_id, num_pos) LEFT JOIN carry USING (case_id, num_pos)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY support, start, fin) AS r, count(*) OVER (PARTITION BY case_id) AS n FROM anchors)"""
_NOTES = "concat_ws(' | ', nullif(note, ''), CASE WHEN n_readings > 1 THEN 'numeral_ambiguous' END)"
_FLOORS = "SELECT case_id, sum(support) / count(*) AS floor, {k} AS k, max(n) AS n_marked FROM ranked WHERE r <= {k} GROUP BY case_id"
_LABELLED = f"{_NUMBERS}, f AS ({_FLOORS.format(k=3)}), l AS (SELECT f.case_id, f.floor, c.is_defect, right(f.case_id, 1) AS digit FROM f JOIN ({_CLAIMS}) c USING (case_id))"


def _point(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""o AS (SELECT {cols}floor, row_number() OVER ({part} ORDER BY floor) AS i, count(*) OVER ({part}) AS p FROM l WHERE is_defect),
        t AS (SELECT {cols}min(floor) AS threshold FROM o WHERE i = least(greatest(round_even(0.95 * p, 0), 1), p) {group})
        SELECT {cols}threshold, avg(CASE WHEN is_defect THEN (floor <= threshold)::INT END) AS achieved_recall, avg(CASE WHEN NOT is_defect THEN (floor <= threshold)::INT END) AS fpr, count(*) AS n, count(*) FILTER (is_defect) AS n_positive
        FROM l JOIN t {on} GROUP BY {cols}threshold"""


_PIECES = "SELECT {keys}, unnest(flatten(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'), lambda w: list_transform(range(1, length(w) + 1, 4), lambda i: substr(w, i, 4))))) AS piece FROM {table}"
_ID = "'invoice#' || case_id"
_TURNS = f"SELECT conv_id, turn, role, conv_id * 100000 + turn AS k, conv_id || '#' || turn AS id, {normalised('text')} AS t FROM conversations"
_TALK = f"""WITH turns AS MATERIALIZED ({_TURNS}),
    {_lexical("SELECT k AS key, t FROM turns WHERE role = 'assistant'", "SELECT k AS sid, id AS src_id, t FROM turns", "SELECT a.k AS key, b.turn AS pos, b.k AS sid FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'assistant'")},
    placed_units AS (SELECT key, start, row_number() OVER (PARTITION BY key ORDER BY start) - 1 AS ordinal FROM (SELECT key, start FROM words UNION ALL SELECT key, start FROM ({numerals("SELECT key, t FROM ans", "key")}))),
    talk AS (SELECT (key // 100000) || '#' || (key % 100000) AS case_id, ordinal, word AS text, round(support, 6) AS support, evidence_id, evidence_text, CASE WHEN exact THEN 'exact_string_in_span' ELSE '' END AS notes FROM lex JOIN placed_units USING (key, start))"""
_WORDS_AND_NUMBERS = f"""{_INVOICES}, {_lexical(f"SELECT case_id AS key, t FROM ({_INVOICE_ANSWER})", f"SELECT case_id AS sid, {_ID} AS src_id, t FROM ({_INVOICE_SOURCE})", f"SELECT case_id AS key, 0 AS pos, case_id AS sid FROM ({_CLAIMS})")},
    both_kinds AS (SELECT key AS case_id, start, word AS text, support, evidence_id, evidence_text, exact AND support < 0.75 AS explained, 1 AS is_word FROM lex
        UNION ALL SELECT a.case_id, a.start, a.text, a.support, 'invoice#' || a.case_id, coalesce(carry.evidence_text, near.evidence_text), false, 0 FROM a LEFT JOIN near USING (case_id, num_pos) LEFT JOIN carry USING (case_id, num_pos)),
    placed_kinds AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY support, is_word, start) AS r, count(*) OVER (PARTITION BY case_id) AS n, sum(1 - is_word) OVER (PARTITION BY case_id) AS numbers FROM both_kinds),
    sized AS (SELECT *, greatest(1, least(4, ceil(0.15::DOUBLE * n)))::INT AS k FROM placed_kinds)
    SELECT case_id, round(sum(support ORDER BY r) / count(*), 6) AS floor, k, n::INT AS n_marked, numbers::INT AS n_numeral, 'trigram-64@v1' AS encoder_id, '' AS warnings,
        string_agg(rpad(text, greatest(length(text), 14)::INT, ' ') || '  support ' || round(support::DECIMAL(18, 9), 2)::DECIMAL(4, 2) || '   nearest in ' || evidence_id || ': ''' || evidence_text || '''' || CASE WHEN explained THEN '{sinks.EXPLAIN}' ELSE '' END, chr(10) ORDER BY r) AS report
    FROM sized WHERE r <= k GROUP BY case_id, k, n, numbers"""
_WARNING, _BARE = scan.UNSEGMENTED_WARNING, scan.NO_CONTEXT_WARNING

ORACLES: dict[str, str] = {
    "normalise_text": f"SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, {normalised("chr(32) || chr(9) || replace(replace(text, chr(10), chr(13) || chr(10) || chr(10) || chr(13) || chr(10)), ' ', ' ' || chr(8203) || chr(9) || ' ') || chr(65279) || ' ' || chr(10)")} AS t FROM documents)",
    "numeral_scan": f"SELECT doc_id, num_pos, text, start, fin AS end_pos FROM ({numerals(DOCS, 'doc_id')})",
    **{f"numeral_readings_{x}": f"SELECT doc_id, start, text, array_to_string(readings, ' | ') AS readings FROM ({numerals(DOCS, 'doc_id', x)})" for x in ("und", "en", "es")},
    "page_numerals": f"SELECT page_id, start, text, array_to_string(readings, ' | ') AS readings FROM ({numerals(f'SELECT page_id, {normalised("html")} AS t FROM pages', 'page_id')})",
    "numeral_canonical": f"SELECT array_to_string(readings, ' | ') AS canonical, count(*) AS n FROM ({numerals(DOCS, 'doc_id')}) GROUP BY 1",
    "ambiguous_numerals": f"SELECT doc_id, start, text, note AS notes FROM ({numerals(DOCS, 'doc_id')}) WHERE note <> ''",
    "value_set_distinct": f"SELECT DISTINCT unnest(readings) AS reading FROM ({numerals(DOCS, 'doc_id')})",
    "word_scan": f"SELECT doc_id, start, fin AS end_pos, word, kind FROM ({words(DOCS, 'doc_id')})",
    "stopword_split": f"SELECT lower(word) AS word, kind, count(*) AS n FROM ({words(_KEYED, 'k')}) GROUP BY 1, 2",
    "unit_counts": f"""WITH u AS ({words(DOCS, "doc_id")}), m AS ({numerals(DOCS, "doc_id")}), every AS ({hits(DOCS, "doc_id", WORD, False)}),
        x AS (SELECT doc_id, count(*) AS w, count(*) FILTER (kind = 'lexical') AS c FROM u GROUP BY 1), y AS (SELECT doc_id, count(*) AS m FROM m GROUP BY 1), z AS (SELECT doc_id, count(*) AS e FROM every GROUP BY 1)
        SELECT d.doc_id, coalesce(w, 0) + coalesce(m, 0) AS n_units, coalesce(c, 0) + coalesce(m, 0) AS n_content, coalesce(e, 0) - coalesce(w, 0) AS n_dropped FROM documents d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "unsegmented_warning": f"SELECT doc_id, CASE WHEN length(regexp_replace(t, '[^\\x{{3000}}-\\x{{9FFF}}\\x{{0E00}}-\\x{{0E7F}}\\x{{AC00}}-\\x{{D7AF}}]', '', 'g')) > 0.3 * length(t) THEN '{_WARNING}' ELSE '' END AS warnings FROM (SELECT doc_id, text || CASE WHEN doc_id % 9 = 0 THEN repeat('漢', length(text) // 3) WHEN doc_id % 3 = 0 THEN repeat('漢', length(text)) ELSE '' END AS t FROM documents)",
    "numeral_support": f"{_INVOICES} SELECT case_id, text, start, support FROM a",
    "nearest_numeral": f"{_INVOICES} SELECT case_id, num_pos, {_ID} AS evidence_id, evidence_text, round(distance, 6) AS distance FROM near",
    "supported_evidence": f"{_INVOICES} SELECT case_id, num_pos, {_ID} AS evidence_id, evidence_text FROM carry",
    "subword_tokens": f"SELECT piece, count(*) AS n FROM ({_PIECES.format(keys='conv_id', table='conversations')}) GROUP BY 1",
    "token_windows": f"""WITH n AS (SELECT conv_id, turn, count(*) AS n FROM ({_PIECES.format(keys="conv_id, turn", table="conversations")}) GROUP BY 1, 2)
        SELECT conv_id, turn, f AS first_token, least(f + 16, n) AS last_token FROM (SELECT conv_id, turn, n, unnest(range(0, greatest(n - 16, 0) + 8, 8)) AS f FROM n) WHERE f = 0 OR f < n - 8""",
    "trigram_vector": f"""WITH p AS (SELECT DISTINCT piece FROM ({_PIECES.format(keys="item_id", table="benchmark")})),
        g AS (SELECT piece, sha256(unnest(list_transform(range(1, length(piece) + 1), lambda i: substr(' ' || lower(piece) || ' ', i, 3)))) AS h FROM p),
        x AS (SELECT piece, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS x FROM g GROUP BY 1, 2 HAVING x <> 0)
        SELECT piece, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY piece)), 6) AS x FROM x""",
    "max_cosine_anchor": "SELECT vec_id, best_id, round(score, 6) AS score FROM (SELECT q.vec_id, e.vec_id AS best_id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) WHERE r = 1",
    "anchor_union": f"{_NUMBERS} SELECT case_id, num_pos AS ordinal, text, 'numeral' AS kind, support, {_ID} AS evidence_id, evidence_text, {_NOTES} AS notes FROM anchors",
    "weakest_topk": f"{_NUMBERS} SELECT case_id, r, text, support FROM ranked WHERE r <= 2",
    "adaptive_k": f"SELECT k // 100000 AS conv_id, k % 100000 AS turn, n_marked, CASE WHEN n_marked = 0 THEN 0 ELSE greatest(1, least(4, ceil(0.15::DOUBLE * n_marked)))::BIGINT END AS k FROM (SELECT c.k, count(w.word) FILTER (w.kind = 'lexical') AS n_marked FROM ({_KEYED}) c LEFT JOIN ({words(_KEYED, 'k')}) w USING (k) GROUP BY 1)",
    "floor_per_case": f"{_NUMBERS} SELECT case_id, round(floor, 6) AS floor, k, n_marked, n_marked AS n_numeral FROM ({_FLOORS.format(k=2)})",
    "floor_vs_mean": f"{_NUMBERS} SELECT case_id, round(min(support), 6) AS floor, round(avg(support), 6) AS mean FROM ranked GROUP BY 1",
    "receipt_lines": f"{_NUMBERS} SELECT case_id, string_agg(rpad(text, greatest(length(text), 14)::INT, ' ') || '  support ' || format('{{:.2f}}', support) || '   nearest in ' || {_ID} || ': ''' || evidence_text || '''', chr(10) ORDER BY r) AS report FROM ranked WHERE r <= 2 GROUP BY case_id",
    "no_context_warning": f"{_NUMBERS} SELECT case_id, CASE WHEN case_id::BIGINT % 5 = 0 THEN '{_BARE}' ELSE '' END AS warnings, CASE WHEN case_id::BIGINT % 5 = 0 THEN 0.0 ELSE min(support) END AS floor FROM ranked GROUP BY 1",
    "content_hash": f"""{_NUMBERS} SELECT case_id, sha256('{{"anchors":[' || string_agg('{{"evidence_id":"' || {_ID} || '","evidence_span":[' || e.start || ',' || e.fin || '],"evidence_text":"' || evidence_text || '","kind":"numeral","notes":[' || CASE WHEN note <> '' THEN '"' || note || '"' || CASE WHEN n_readings > 1 THEN ',' ELSE '' END ELSE '' END || CASE WHEN n_readings > 1 THEN '"numeral_ambiguous"' ELSE '' END || '],"span":[' || ranked.start || ',' || ranked.fin || '],"support":' || format('{{:.1f}}', support) || ',"text":"' || ranked.text || '","value":"' || array_to_string(ranked.readings, ' | ') || '"}}', ',' ORDER BY ranked.num_pos) || '],"encoder_id":"none","k":1,"version":1,"warnings":[]}}') AS sha256
        FROM ranked JOIN (SELECT case_id, text, min(start) AS start, min(fin) AS fin FROM s GROUP BY 1, 2) e USING (case_id) WHERE e.text = ranked.evidence_text GROUP BY case_id""",
    "calibrate_threshold": f"{_LABELLED}, {_point('')}",
    "calibrate_recall_fpr": f"{_LABELLED}, {_point('digit')}",
    "lexical_support": f"{_TALK} SELECT * FROM talk",
    "exact_string_note": f"{_TALK} SELECT notes <> '' AS exact, count(*) AS n, min(support) AS least FROM talk GROUP BY 1",
    "proofread_invoices": _WORDS_AND_NUMBERS,
    "unaligned_guard": f"""WITH turns AS MATERIALIZED ({_TURNS}), ans AS MATERIALIZED (SELECT k, t FROM turns WHERE role = 'assistant'),
        w AS MATERIALIZED ({words("SELECT k, t FROM ans", "k")}), m AS MATERIALIZED ({hits("SELECT k, t FROM ans", "k", "[\\p{L}\\p{N}_]{4,}", False)})
        SELECT (k // 100000) || '#' || (k % 100000) AS case_id, 'word ''' || arg_min(word, start) || ''' at ' || min(start) || ' meets no token of the answer' AS error, true AS no_floor
        FROM w WHERE kind = 'lexical' AND NOT EXISTS (SELECT 1 FROM m WHERE m.k = w.k AND m.start < w.fin AND m.fin > w.start) GROUP BY k""",
}
ORACLES["floor_exploded"] = ORACLES["floor_per_case"]
ORACLES["calibrate_threshold"] = f"SELECT round(threshold, 6) AS threshold, 0.95::DOUBLE AS target_recall, n, n_positive FROM ({ORACLES['calibrate_threshold']})"
ORACLES["calibrate_recall_fpr"] = f"SELECT digit, round(threshold, 6) AS threshold, round(achieved_recall, 6) AS achieved_recall, round(fpr, 6) AS fpr FROM ({ORACLES['calibrate_recall_fpr']})"
