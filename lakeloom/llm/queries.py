"""The registered queries of this subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from . import chat, decontaminate, line_dedup, media, mixing, simhash, subword_lm, tokens, toxicity, warc

ORACLE = {
    "op8_chat_snapshots": """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos
                   FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
             p AS (SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
                          string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
             w AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY ALL),
             k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = w.prefix AND p.pos < p.n))
        SELECT conv_id, count(*) AS n_turns, any_value(copies) AS copies,
               string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
        FROM t JOIN k USING (conv_id) GROUP BY conv_id""",
    "op9_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
             i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
             v AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
             p AS (SELECT k, s, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM v))),
             o AS (SELECT k, s, n, item_id FROM p JOIN v USING (n, g)),
             c AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS q FROM o) GROUP BY k),
             t AS (SELECT k, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT k, item_id FROM o) GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)""",
    "op1_warc_transactions": """
        WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             g AS (SELECT d, n, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY ALL)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to, url AS target_uri
        FROM p LEFT JOIN g USING (d, n)""",
}


def queries() -> dict:
    return {f.__name__: f for f in (warc.op1_warc_transactions, toxicity.op2_toxicity_chain, tokens.op3_token_counts, simhash.op5_simhash_components, mixing.op6_entropy_mixing, line_dedup.op4_line_alignment, subword_lm.op7_lattice_scores, chat.op8_chat_snapshots, decontaminate.op9_decontamination, media.op10_avi_clips)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
