"""SQL that gives the rows of those queries which it can express."""

from __future__ import annotations

#: A-Z in lower case, and nothing else.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = f"regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SPACED = f"regexp_extract_all({LOW}, '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {
    "op6_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM} AS w FROM documents),
 bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM (SELECT item_id, {ALNUM} AS w FROM benchmark) WHERE len(w) > 0)),
 dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
 m AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, s)), h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
 t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m) GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)""",
    "op8_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM (SELECT doc_id, {SPACED} AS w FROM documents)),
 e AS (SELECT doc_id, unnest(s) AS g FROM d), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)), k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 c AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT k.b, c.root FROM c JOIN k ON k.a = c.doc_id)
 SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id FROM d JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY 1) USING (doc_id)""",
    "op11_collocations": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOW}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
 g AS (SELECT lang, k, w[i:i + k - 1] AS ws FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
 f AS (SELECT lang, k, array_to_string(ws, ' ') AS phrase, ws, count(*) AS a FROM g GROUP BY ALL), t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
 c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
 inside AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < k) GROUP BY 1, 2),
 kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
 cuts AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
 scored AS (SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, cut, ((2000000::HUGEINT * x.a) // (l.a + r.a))::BIGINT AS score FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.lp JOIN f r ON r.lang = x.lang AND r.phrase = x.rp),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
 SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN t USING (lang) WHERE rank <= 2000""",
}
