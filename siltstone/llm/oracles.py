"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"


def _places(pattern: str, group: int, least: int, kind: str) -> str:
    """Rows (doc_id, kind, s, e, secret) of a pattern's matches: places add up from the
    pieces between matches and the matches before."""
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS e, secret FROM (
 SELECT doc_id, unnest(ms) AS m, unnest(gs) AS secret, unnest(list_transform(range(1, len(ms) + 1), lambda k: coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0) + CASE WHEN k > 1 THEN list_sum(list_transform(ms[1:k-1], lambda x: length(x))) ELSE 0 END))::BIGINT AS s
 FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, regexp_split_to_array(t, '{pattern}') AS ps FROM d)) WHERE length(secret) >= {least}"""


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP6 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat(coalesce(source, ''), '/', coalesce(lang, '')) AS repository FROM documents),
 base AS ({_places(ASSIGN, 2, 6, 'assign')} UNION ALL {_places('AKIA[A-Z0-9]+', 0, 20, 'access')} UNION ALL {_places('[0-9a-f]+', 0, 24, 'hex')}),
 wide AS ({_places('[A-Za-z0-9_-]+', 0, 20, 'owned')}),
 looks AS (SELECT * FROM wide WHERE regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]') AND len(list_distinct(string_split(secret, ''))) >= 10),
 cands AS (SELECT doc_id, e - length(secret) AS s, e, 0 AS own, secret FROM base UNION ALL SELECT doc_id, s, e, CASE WHEN EXISTS (SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b.s < l.e AND b.e > l.s) THEN 2 ELSE 1 END, secret FROM looks l),
 freq AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM cands JOIN d USING (doc_id) GROUP BY secret),
 judged AS (SELECT c.*, owners <= 1 AND repositories <= 3 AS live FROM cands c JOIN freq USING (secret) WHERE own < 2),
 spans AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT DISTINCT doc_id, 'owned', s, e FROM judged WHERE live AND own = 1),
 k AS (SELECT unnest(['assign', 'access', 'hex', 'owned']) AS kind, unnest([1, 2, 3, 4]) AS ord)
 SELECT d.doc_id, (SELECT count(*) FROM base b WHERE b.doc_id = d.doc_id AND kind = 'assign') AS n_assign, (SELECT count(*) FROM base b WHERE b.doc_id = d.doc_id AND kind = 'access') AS n_access, (SELECT count(*) FROM base b WHERE b.doc_id = d.doc_id AND kind = 'hex') AS n_hex,
 sha256(coalesce((SELECT string_agg(concat(b.kind, ':', s, ':', e), ',' ORDER BY s, ord) FROM base b JOIN k ON b.kind = k.kind WHERE b.doc_id = d.doc_id), '')) AS base_sha256,
 coalesce((SELECT string_agg(concat(b.kind, ':', s, ':', e), ',' ORDER BY s, ord) FROM spans b JOIN k ON b.kind = k.kind WHERE b.doc_id = d.doc_id), '') AS spans,
 (SELECT count(*) FROM spans b WHERE b.doc_id = d.doc_id AND kind = 'owned') AS n_owned,
 (SELECT count(DISTINCT (s, e)) FROM judged j WHERE j.doc_id = d.doc_id AND NOT live) AS n_example, (SELECT count(DISTINCT (s, e)) FROM judged j WHERE j.doc_id = d.doc_id AND live) AS n_live FROM d"""

OP7 = f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, k, ls[k + 1] AS line, list_sort(list_distinct({WORDS.format(t='ls[k + 1]')})) AS w FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS k FROM d)),
 f AS (SELECT w, min((doc_id, k)) AS pl FROM l WHERE len(w) > 0 GROUP BY w), n AS (SELECT row_number() OVER () AS id, w, pl FROM f),
 u AS (SELECT id, unnest(w) AS x FROM n), df AS (SELECT x, count(*) AS c FROM u GROUP BY x),
 r AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY c, x) AS r FROM u JOIN df USING (x)),
 p AS (SELECT r.id, x FROM r JOIN n ON r.id = n.id WHERE r <= len(w) - CAST(ceil(0.75 * len(w)) AS BIGINT) + 1),
 pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id WHERE na.pl < nb.pl AND 4 * least(len(na.w), len(nb.w)) >= 3 * greatest(len(na.w), len(nb.w))),
 gone AS (SELECT DISTINCT b FROM pairs JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * len(list_intersect(na.w, nb.w)) >= 75 * (len(na.w) + len(nb.w) - len(list_intersect(na.w, nb.w)))),
 keep AS (SELECT l.doc_id, l.k, l.line, len(l.w) = 0 OR (n.pl = (l.doc_id, l.k) AND n.id NOT IN (SELECT b FROM gone)) AS stays FROM l LEFT JOIN n ON l.w = n.w)
 SELECT d.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce((SELECT count(*) FROM keep WHERE keep.doc_id = d.doc_id AND NOT stays), 0) AS n_removed,
 sha256(coalesce((SELECT string_agg(line, chr(10) ORDER BY k) FROM keep WHERE keep.doc_id = d.doc_id AND stays), '')) AS kept_sha256 FROM d"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(t=f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
 x AS (SELECT doc_id, unnest(g) AS g FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g WHERE a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 75 * (len(sa.g) + len(sb.g) - n)), ed AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, ed.b FROM reach r JOIN ed ON r.b = ed.a)
 SELECT s.doc_id, len(g) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = s.doc_id) AS component_id FROM s"""

RULES = {"symbols": "10 * n_symbols > word_chars", "dup_lines": "n_dup_lines >= 3", "repeats": "100 * n_repeat_words > 20 * n_words", "short": "n_words < 10"}
_RATES = ", ".join(f"avg(f_{r}::INT) AS m_{r}" for r in RULES)
_SPREAD = ", ".join(f"greatest(sum(r_{r} * r_{r} * n) / sum(n) - pow(sum(r_{r} * n) / sum(n), 2), 0.0) AS v_{r}" for r in RULES)
_SHRUNK = ", ".join(f"(r_{r} * n + m_{r} * k_{r}) / (n + k_{r}) AS s_{r}" for r in RULES)
_WEIGHT = ", ".join(f"CASE WHEN v_{r} > m_{r} * (1 - m_{r}) / 1000.0 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE 1000.0 END AS k_{r}" for r in RULES)
OP9 = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {WORDS.format(t='text')} AS w FROM documents),
 g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda k: array_to_string(w[k:k+4], ' '))) AS g, unnest(range(1, greatest(len(w) - 3, 1))) AS k FROM d),
 c AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g), p AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM c, (SELECT unnest([0, 1, 2, 3, 4]) AS j) WHERE c.n > 1 GROUP BY doc_id),
 l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
 m AS (SELECT d.doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN dl ON dl.doc_id = d.doc_id),
 f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {', '.join(f'{v} AS f_{k}' for k, v in RULES.items())} FROM m),
 h AS (SELECT host, count(*) AS n, {', '.join(f'avg(f_{r}::INT) AS r_{r}' for r in RULES)} FROM f GROUP BY host), a AS (SELECT {_RATES} FROM f), v AS (SELECT {_SPREAD} FROM h), k AS (SELECT *, {_WEIGHT} FROM a, v),
 s AS (SELECT host, {_SHRUNK}, {', '.join(f'm_{r}' for r in RULES)} FROM h, k),
 b AS (SELECT host, greatest({', '.join(f's_{r}' for r in RULES)}, 0.0) AS host_rate, greatest({', '.join(f'CASE WHEN m_{r} > 0 THEN s_{r} / m_{r} ELSE 0.0 END' for r in RULES)}, 0.0) AS host_ratio, {' OR '.join(f'(m_{r} > 0 AND s_{r} >= 0.02 AND s_{r} / m_{r} >= 1.5)' for r in RULES)} AS host_bad FROM s)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (host_bad AND ({' OR '.join(f'f_{r}' for r in RULES)})) AS kept, f.host, round(host_rate, 9) AS host_rate, round(host_ratio, 9) AS host_ratio, host_bad FROM f JOIN b ON f.host = b.host"""

ORACLES = {"op6_secret_scans": OP6, "op7_line_dedup": OP7, "op8_ngram_jaccard_join": OP8, "op9_quality_rules": OP9}
