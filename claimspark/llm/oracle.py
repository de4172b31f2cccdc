"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
"""

WARC = """
WITH t AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CASE WHEN len(q.vec) = 0 OR len(c.vec) = 0 THEN 0 ELSE list_dot_product(q.vec, c.vec)::BIGINT END AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

CURRICULUM = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM t GROUP BY source
), w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][place + 1] AS weight, 2.0::DOUBLE * source_size / weight AS full_at FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
  FROM w WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, place,
         CASE WHEN full_at > level THEN max(CASE WHEN full_at > level THEN level END) OVER () * weight
              ELSE 2.0::DOUBLE * source_size END AS target
  FROM l
), d AS (
  SELECT t.doc_id, size, source_size, place, target, floor(target)::BIGINT AS demand,
         (sum(size) OVER (PARTITION BY t.source ORDER BY k, doc_id) - size)::BIGINT AS before
  FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS rounds FROM d
), f AS (
  SELECT *, (rounds * size + greatest(0, least(size, demand - rounds * source_size - before)))::BIGINT AS taken,
         (before + least(size, demand - before) / 2.0::DOUBLE) / demand AS u
  FROM e
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken <= 0 THEN NULL
            WHEN place = 0 THEN 0.0::DOUBLE + 2.0 * (u * 1.0 - 0.0)
                 / (1.0 + sqrt(greatest(0.0, 1.0 + 0.0 * (u * 1.0 - 0.0))))
            WHEN place = 1 AND u * 1.125 <= 0.75 THEN 0.0 + 2.0 * (u * 1.125 - 0.0)
                 / (2.0 + sqrt(greatest(0.0, 4.0 + -4.0 * (u * 1.125 - 0.0))))
            WHEN place = 1 THEN 0.5 + 2.0 * (u * 1.125 - 0.75)
                 / (1.0 + sqrt(greatest(0.0, 1.0 + -2.0 * (u * 1.125 - 0.75))))
            WHEN u * 1.0625 <= 0.3125 THEN 0.0 + 2.0 * (u * 1.0625 - 0.0)
                 / (0.25 + sqrt(greatest(0.0, 0.0625 + 3.0 * (u * 1.0625 - 0.0))))
            ELSE 0.5 + 2.0 * (u * 1.0625 - 0.3125) / (1.0 + sqrt(greatest(0.0, 1.0 + 4.0 * (u * 1.0625 - 0.3125))))
       END AS position
FROM f
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), n AS (
  SELECT *, floor(turn / 128.0) AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t
), m AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id, part ORDER BY k) = role, false) AS joined,
         regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS head
  FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + CASE WHEN joined THEN length('<|im_next|>')
                               ELSE length('<|im_start|>') + length(head) + 1 + length('<|im_end|>') + 1 END)::BIGINT
         AS formatted_chars
FROM m GROUP BY conv_id
"""

#: CRC-32 of a text, bit by bit.
CRC32 = """xor(list_reduce([4294967295] || [ascii(c)::BIGINT FOR c IN string_split({0}, '')],
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

MANIFEST = (
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, lang, n_chars, row_number() OVER () AS id,
         CASE WHEN doc_id IS NOT NULL AND """
    + CRC32.format("doc_id::VARCHAR")
    + r""" % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents
), e AS (
  SELECT doc_id, source, id, text, other,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM d
), f AS (
  SELECT doc_id, source, id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed
  FROM e
), l AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM f
), nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS digest, n FROM l
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, n, pos // 3
), top AS (
  SELECT -1::BIGINT AS tree, 100 AS lvl, tree AS pos, digest, (SELECT count(*) FROM nodes WHERE n = 1) AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3
  FROM top WHERE n > 1 GROUP BY tree, lvl, n, pos // 3
), runs AS (
  SELECT tree, lvl, pos // 3 AS run, list(digest ORDER BY pos) AS digests
  FROM (SELECT * FROM nodes UNION ALL SELECT * FROM top) WHERE n > 1 GROUP BY tree, lvl, pos // 3
), ways AS (
  SELECT id, lvl, digests, (pos // (3 ** lvl)::BIGINT) % 3 AS place
  FROM l JOIN runs USING (tree) WHERE runs.run = pos // (3 ** (lvl + 1))::BIGINT
  UNION ALL
  SELECT id, lvl, digests, (l.tree // (3 ** (lvl - 100))::BIGINT) % 3 AS place
  FROM l JOIN runs ON runs.tree = -1 WHERE runs.run = l.tree // (3 ** (lvl - 99))::BIGINT
), steps AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY lvl) AS k,
         array_to_string(digests[1:place], '') AS before, array_to_string(digests[place + 2:], '') AS after
  FROM ways
), fold AS (
  SELECT id, 0 AS k, changed AS digest FROM l
  UNION ALL
  SELECT fold.id, steps.k, sha256(before || digest || after) FROM fold JOIN steps ON steps.id = fold.id AND steps.k = fold.k + 1
), ends AS (SELECT id, arg_max(digest, k) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, string_agg(before || after, '' ORDER BY k) AS proof FROM steps GROUP BY id),
subroots AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN subroots USING (tree) JOIN ends USING (id) LEFT JOIN proofs USING (id)
CROSS JOIN (SELECT digest AS root FROM top WHERE n = 1)
"""
)

ORACLE = {
    "op3_zip_warc": WARC,
    "op4_exact_dedup": EXACT_DEDUP,
    "op5_branch_and_bound": TOP_K,
    "op10_curriculum_mix": CURRICULUM,
    "op12_chat_format": CHAT,
    "op13_merkle_manifest": MANIFEST,
}
