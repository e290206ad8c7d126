"""The registered queries in DuckDB SQL, where SQL can state them."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) > 1
                      THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      ELSE coalesce(w, []) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), smallest AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN smallest ON doc_id = node
"""

MIXTURE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total
  FROM totals
), fill AS (  -- round by round: full sources leave, the rest is shared by weight among the others
  SELECT 0 AS round, source, source_size, weight, cap, total, false AS full_up, total AS lvl_left, NULL::DOUBLE AS target
  FROM weighed
  UNION ALL
  SELECT round + 1, source, source_size, weight, cap, total,
         full_up OR share >= cap,
         lvl_left, CASE WHEN full_up OR share >= cap THEN cap ELSE share END
  FROM (
    SELECT *, (total - coalesce(sum(cap) FILTER (full_up) OVER (), 0))
              / nullif(sum(weight) FILTER (NOT full_up) OVER (), 0) * weight AS share
    FROM fill
  ) WHERE round < 40
), targets AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         floor(target)::BIGINT AS goal
  FROM fill WHERE round = 40
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.whole, t.goal - t.whole * t.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - base)))::BIGINT AS taken
FROM placed
"""

# base32 of the SHA-1: each of its 32 digits is 5 of its 160 bits
WARC = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
              ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
              [instr('0123456789abcdef', hex[i])]), '') AS b
  FROM p
), digests AS (
  SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
             1 + 16 * b[5*i+1]::INT + 8 * b[5*i+2]::INT + 4 * b[5*i+3]::INT + 2 * b[5*i+4]::INT + b[5*i+5]::INT]), '') AS payload_digest
  FROM bits
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts
"""

# turns of a conversation are numbered from 0 in the table and far fewer than a part holds
CHAT = r"""
WITH whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns,
         string_agg('<|im_start|>' || coalesce(nullif(regexp_replace(role, '[^A-Za-z_]', '', 'g'), ''), 'unknown') || chr(10)
                    || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1| >', 'g')
                    || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT turns[:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM whole)
), distinct_ones AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*)::BIGINT AS copies, any_value(rendered) AS rendered
  FROM whole GROUP BY turns, n_turns HAVING turns NOT IN (SELECT turns FROM prefixes)
)
SELECT conv_id, 0::BIGINT AS part, n_turns, copies, rendered FROM distinct_ones
"""


def _tree(name: str, leaves: str, probes: str) -> str:
    """Levels of all trees of ``leaves`` (tree, place, digest), and the way of every probe (tree, place, own, key) to its top."""
    return rf"""
{name}_nodes AS (
  SELECT tree, 0 AS level, place, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
  FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, place // 3, n
), {name}_runs AS (
  SELECT tree, level, place // 3 AS run, list(digest ORDER BY place) AS l FROM {name}_nodes WHERE n > 1
  GROUP BY tree, level, place // 3
), {name}_walk AS (
  SELECT key, tree, 0 AS level, place, own, '' AS proof FROM {probes}
  UNION ALL
  SELECT key, w.tree, w.level + 1, w.place // 3,
         sha256(array_to_string(l[1:w.place % 3], '') || own || array_to_string(l[w.place % 3 + 2:], '')),
         proof || array_to_string(l[1:w.place % 3], '') || array_to_string(l[w.place % 3 + 2:], '')
  FROM {name}_walk w JOIN {name}_runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.place // 3
), {name}_end AS (
  SELECT key, arg_max(own, level) AS own, arg_max(proof, level) AS proof FROM {name}_walk GROUP BY key
)"""


def _fields(text: str) -> str:
    columns = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in columns) + ")"


MERKLE = rf"""
WITH RECURSIVE marked AS (
  SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER () AS key,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i:
             [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, o: CASE WHEN o >= 0 THEN xor(c, o)
                             ELSE xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384 ELSE 0 END) END)) AS crc
  FROM documents
), digests AS (
  SELECT *, {_fields("text")} AS leaf,
         CASE WHEN crc % 2 = 0 THEN {_fields("replace(text, chr(10), '')")} ELSE {_fields("text")} END AS own
  FROM marked
), leaves AS (
  SELECT doc_id, key, tree, leaf, leaf AS digest, own,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM digests
), {_tree("doc", "leaves", "leaves")}, subroots AS (
  SELECT tree, digest FROM doc_nodes WHERE n = 1
), forest AS (
  SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, digest, tree AS source FROM subroots
), probes AS (
  SELECT l.key, '' AS tree, f.place, e.own FROM leaves l JOIN doc_end e USING (key) JOIN forest f ON f.source = l.tree
), {_tree("all", "forest", "probes")}
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(d.proof || a.proof) AS proof_sha256,
       a.own AS folded_root, a.own = r.digest AS verified
FROM leaves l JOIN doc_end d USING (key) JOIN all_end a USING (key) JOIN subroots s ON s.tree = l.tree
CROSS JOIN (SELECT digest FROM all_nodes WHERE n = 1) r
"""


def _rounds(n: int) -> str:
    rounds = []
    for k in range(n + 1):
        rounds.append(rf"""
assigned{k} AS MATERIALIZED (  -- distance and index of the nearest entry in one number: ties go to the lower index
  SELECT r, p, min(away * 16 + e) AS best
  FROM (SELECT r, p, e, sum((x - c) * (x - c))::BIGINT AS away FROM cut JOIN book{k} USING (p, i) GROUP BY r, p, e)
  GROUP BY r, p
)""")
        if k < n:
            rounds.append(rf"""
book{k + 1} AS MATERIALIZED (
  SELECT p, e, i, coalesce((s - ((s % n + n) % n)) // n, c) AS c
  FROM book{k} LEFT JOIN (
    SELECT p, best % 16 AS e, i, sum(x)::BIGINT AS s, count(*) AS n FROM cut JOIN assigned{k} USING (r, p) GROUP BY ALL
  ) USING (p, e, i)
)""")
    return ",".join(rounds)


CODES = rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, len(embedding) // 8 AS width,
         list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT r, (pos - 1) // width AS p, (pos - 1) % width AS i, x
  FROM (SELECT r, width, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, e, i, x AS c FROM cut JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (r) WHERE e < 16
), {_rounds(6)}, coded AS (
  SELECT r, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error FROM assigned6 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM book6) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
