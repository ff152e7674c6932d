"""SQL of the queries that SQL can express."""

from __future__ import annotations

from tidewell.llm import quality_rules as q

_LEVEL = "least({last}, greatest(0, CAST(floor(({hi} - {v}) / (({hi} - {lo}) / {last})) AS INTEGER) + CASE WHEN {v} <= {hi} THEN 1 ELSE 0 END))"
_SHARES = {
    "symbols": "n_symbols / nullif(n_words, 0)",
    "capitals": "caps / nullif(word_chars, 0)",
    "bangs": "bangs / nullif(n_words, 0)",
    "repeated_lines": "n_dup_lines / nullif(n_lines, 0)",
    "stutter": "same / nullif(n_words, 0)",
}


def _levels() -> str:
    parts = []
    for name, (hi, lo) in q.CUTOFFS.items():
        v = f"({_SHARES[name]})"
        level = _LEVEL.format(v=v, hi=f"CAST({hi!r} AS DOUBLE)", lo=f"CAST({lo!r} AS DOUBLE)", last=q.LEVELS - 1)
        parts.append(f"CASE WHEN {v} > {lo!r} THEN {level} END")
    return "least(" + ",\n    ".join(parts) + ")"


RATED = rf"""t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
wins AS (SELECT doc_id, unnest(range(1, len(ws) - {q.WINDOW_WORDS - 2})) AS i, ws FROM w WHERE len(ws) >= {q.WINDOW_WORDS}),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + {q.WINDOW_WORDS - 1})) AS times FROM wins),
again AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {q.WINDOW_WORDS})) AS pos FROM seen WHERE times > 1) GROUP BY 1),
counted AS (
  SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(text, '\p{{Lu}}')) AS caps, len(regexp_extract_all(text, '!')) AS bangs,
    len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS same
  FROM w LEFT JOIN again a ON w.doc_id = a.doc_id),
rated AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN {_levels()} END AS level FROM counted)"""

VERDICTS = rf"""marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
held AS (SELECT stratum, coalesce(level, {q.LEVELS}) AS level, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS g FROM rated JOIN marks ON rated.doc_id = marks.doc_id WHERE NOT base_failed),
sizes AS (SELECT stratum, sum(g) AS n, sum(1 - g) AS m, (SELECT count(DISTINCT stratum) FROM held) AS strata FROM held GROUP BY 1),
tried AS (SELECT s.stratum, n, m, strata, l, (SELECT coalesce(sum(g), 0) FROM held h WHERE h.stratum = s.stratum AND h.level <= l) AS k,
    (SELECT coalesce(sum(1 - g), 0) FROM held h WHERE h.stratum = s.stratum AND h.level <= l) AS hit FROM sizes s, (SELECT range AS l FROM range({q.LEVELS}))),
tested AS (SELECT *, CASE WHEN k >= n * {q.ALPHA} THEN FALSE ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.ALPHA}) + (n - i) * ln(1 - {q.ALPHA})))) <= CAST({q.DELTA} AS DOUBLE) / strata END AS holds FROM tried),
passed AS (SELECT * FROM (SELECT *, min(CASE WHEN holds THEN 1 ELSE 0 END) OVER (PARTITION BY stratum ORDER BY l) AS so_far FROM tested) WHERE so_far = 1),
chosen AS (SELECT stratum, l AS cutoff_level FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY round(coalesce(hit / nullif(m, 0), 0.0) - k / n, 9) DESC, l) AS rn FROM passed) WHERE rn = 1),
judged AS (SELECT r.*, NOT base_failed AND coalesce(level IS NULL OR level > cutoff_level, TRUE) AS kept FROM rated r LEFT JOIN chosen c ON r.stratum = c.stratum)"""

OP1 = f"WITH {RATED},\n{VERDICTS}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"

#: The reflected polynomial of CRC-32, applied bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(t))), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: list_reduce(range(0, 8), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295))"""

OP4 = f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t, md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, hex(encode(t)) AS hx FROM t),
d AS (SELECT doc_id, source, h, CAST(octet_length(encode(t)) + 8 AS BIGINT) AS size, CAST({_CRC} AS BIGINT) AS text_crc32 FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) AS rn, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total,
  CAST(CAST('0x' || substr(md5('17|' || source), 1, 8) AS BIGINT) + 1 AS DOUBLE) / 4294967296.0 AS u FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (CAST(rn AS DOUBLE) - u) / CAST(n AS DOUBLE), source, h, doc_id, text_crc32, size) - 1 AS p FROM r),
s AS (SELECT *, CAST((p * 24) // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(p - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

OP12 = r"""WITH split AS (SELECT *, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)),
d AS (SELECT row_number() OVER () AS r, id, ws FROM split WHERE kind = 'd'),
i AS (SELECT id, ws, least(len(ws), 10) AS n FROM split WHERE kind = 'i' AND len(ws) > 0),
wins AS (SELECT DISTINCT id, n, array_to_string(list_slice(ws, a, a + n - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS a FROM i)),
tried AS (SELECT r, n, a, array_to_string(list_slice(ws, a, a + n - 1), ' ') AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
hit AS (SELECT r, t.n, a, id FROM tried t JOIN wins w ON t.n = w.n AND t.win = w.win),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS p FROM (SELECT DISTINCT r, n, a FROM hit)) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(id AS VARCHAR) AS id FROM hit WHERE id IS NOT NULL) GROUP BY 1)
SELECT d.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places p ON d.r = p.r LEFT JOIN items ON d.r = items.r"""

ORACLES = {"op12_decontamination": OP12, "op1_quality_rules": OP1, "op4_sharding": OP4}
