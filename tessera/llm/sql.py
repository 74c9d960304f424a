"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .line_rules import BARS, BOILERPLATE, ENDS, FULL_LINE, LINK, LINK_WORDS, LONG_LINE, MOST_BARS, MOST_LINKS, MOST_LOST, SHOUTS, SYMBOLS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, list_slice(w, k, k + least(len(w), 10) - 1) AS win FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(k) WHERE len(w) > 0),
n AS (SELECT DISTINCT len(win) AS n FROM p),
o AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win FROM d, n, unnest(range(1, len(w) - n + 2)) t(k)),
h AS (SELECT doc_id, k, n, item_id FROM o JOIN p USING (win)),
q AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN q USING (doc_id) LEFT JOIN i USING (doc_id)"""

OP7 = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, k, list_slice(w, k, k + 12) AS v FROM d, unnest(range(1, len(w) - 11)) t(k)),
low AS (SELECT v, min(doc_id) AS m FROM win GROUP BY v),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(k, k + 13)) AS q FROM win JOIN low USING (v) WHERE m < doc_id)),
x AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.q = x.i GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_PHRASES = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
_ENDS = ", ".join("'" + c.replace("'", "''") + "'" for c in ENDS)
_SPACES = "length(x) - length(replace(x, ' ', '')) + 1"
_LINKS = f"(length(x) - length(replace(x, '{LINK}', ''))) // {len(LINK)}"
_FAILS = f"""((length(x) - length(translate(x, '{SYMBOLS}', ''))) * 4 > {_SPACES} OR length(x) - length(translate(x, '{BARS}', '')) >= {MOST_BARS}
OR {_LINKS} >= {MOST_LINKS} OR ({_LINKS} >= 1 AND {_SPACES} <= {LINK_WORDS})
OR ({_SPACES} >= {FULL_LINE} AND right(rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ({_ENDS}))
OR (length(x) - length(replace(x, '!', '')) >= {SHOUTS} AND (length(x) - length(replace(x, '!', ''))) * 2 >= {_SPACES})
OR (length(x) >= {LONG_LINE} AND NOT regexp_matches(x, '[.,;:!?…]')) OR {_PHRASES})"""

OP8 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, k, list_slice(w, k, k + 4) AS v FROM d, unnest(range(1, len(w) - 3)) t(k)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS q FROM win JOIN (SELECT doc_id, v FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, v)) GROUP BY doc_id),
f AS (SELECT doc_id, list_sum([length(x) FOR x IN l IF {_FAILS}]) / nullif(list_sum([length(x) FOR x IN l]), 0)::DOUBLE AS lost FROM d),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(f.lost, 0) AS lost FROM d LEFT JOIN r USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= {MOST_LOST} AS kept FROM b"""


def op11(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Every distance in every round, round after round."""
    out = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, x AS y FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""]
    for i in range(rounds + 1):
        near = f"SELECT r, c, list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(x, y)])::BIGINT AS d FROM v, c{i}"
        out.append(f"a{i} AS MATERIALIZED (SELECT r, c, d FROM ({near}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            sums = f"SELECT c, j, floor(sum(x[j]) / count(*))::BIGINT AS m FROM a{i} JOIN v USING (r), range(1, {dim + 1}) t(j) GROUP BY c, j"
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.y, c{i}.y) AS y FROM c{i} LEFT JOIN (SELECT c, list(m ORDER BY j) AS y FROM ({sums}) GROUP BY c) n USING (c))")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""


_LINES = r"regexp_extract_all(t, '[^\n]*\n|[^\n]+')"
OP13 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, {_LINES} AS l, len({_LINES}) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
c AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

OP12 = """WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT page_id, n, sha256(t) AS d, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to FROM f"""
