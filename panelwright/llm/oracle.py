"""SQL for the queries that SQL can express."""

from __future__ import annotations

from panelwright.llm.lines import LOWER, UPPER

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingles
  FROM texts
), named AS (
  SELECT doc_id, shingles, len(shingles) AS n, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY shingles) END AS set_id FROM sets
), entry AS (
  SELECT doc_id, n, unnest(shingles) AS shingle FROM named WHERE doc_id = set_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM entry a JOIN entry b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM named WHERE doc_id = set_id
  UNION SELECT r.x, l.v FROM reached r JOIN links l ON r.y = l.u
), least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, n AS n_shingles, set_id, component_id FROM named JOIN least ON set_id = x
"""

OP10 = f"""
WITH line AS (
  SELECT doc_id, p AS pos, string_split(coalesce(text, ''), chr(10))[p] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {_WHITE}), '{UPPER}', '{LOWER}') AS key FROM line
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, coalesce(k.doc_id <> o.keeper, false) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP11 = """
WITH known AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT DISTINCT a.vec_id AS a, a.label AS own, r.vec_id AS r, r.label AS other, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM known a JOIN known r ON len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT a, own, r, score, row_number() OVER (PARTITION BY a, own ORDER BY score DESC, r) AS place
  FROM scored WHERE own = other AND a <> r QUALIFY place <= 5
), negative AS (
  SELECT p.a, p.r AS positive, p.score AS ps, n.r AS negative, n.score AS ns,
         row_number() OVER (PARTITION BY p.a, p.own, p.r ORDER BY n.score DESC, n.r) AS nth
  FROM positive p JOIN scored n ON n.a = p.a AND n.own = p.own AND n.other <> p.own AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
  QUALIFY nth <= 3
)
SELECT a AS anchor_id, positive AS positive_id, nth::INTEGER AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM negative
"""


def _crc_table() -> list[int]:
    """Remainders of the 256 bytes by the reflected CRC-32 polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


OP13 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n, hex(doc_id || ':' || run) AS h FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(
      list_concat([4294967295::UBIGINT], list_transform(range(0, len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::UBIGINT)),
      lambda c, b: xor(({_crc_table()}::UBIGINT[])[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) AS crc
  FROM counted
), spelled AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), without AS (
  SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN without b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN without b ON a.word = b.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, {{'n': -other_n, 'w': other}}) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), up AS (
  SELECT word, word AS root, form AS ahead FROM formed
  UNION ALL SELECT u.word, f.word, f.form FROM up u JOIN formed f ON u.ahead = f.word
)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM formed f JOIN up u ON f.word = u.word AND u.ahead IS NULL
"""

ORACLE: dict[str, str] = {"op1_ngram_join": OP1, "op10_line_dedup": OP10, "op11_hard_negatives": OP11, "op13_spelling": OP13}
