"""SQL for what plain SQL can say of the corpus operators' results, as DuckDB runs it over the given tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"

# Sets of 3-word shingles, pairs that share one and whose sizes allow a link, and what links reach.
SHINGLE_LINKS = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  END AS grams
  FROM worded
),
each AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM each a JOIN each b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL
),
links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other
)
SELECT doc_id, any_value(len(grams)) AS n_shingles, min(other) AS component_id
FROM sets JOIN reached USING (doc_id)
GROUP BY doc_id
"""

# A word is repeated where it stands in an 8-word window that the text holds twice or more.
RULE_COUNTS = rf"""
WITH worded AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS seen
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM worded)
),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, seen) AS c FROM windows) WHERE c > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM worded
),
counted AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM worded JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
"""

DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
LUHN = (
    f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({DIGITS})[i]::BIGINT "
    f"ELSE (2 * reverse({DIGITS})[i]::BIGINT) // 10 + (2 * reverse({DIGITS})[i]::BIGINT) % 10 END))"
)
PERSONAL_COUNTS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT doc_id,
    regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email,
    regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ip,
    regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+') AS card,
    regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') AS phone
  FROM t
)
SELECT doc_id, len(email) AS n_email,
  len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p AS BIGINT), 256) > 255)) = 0)) AS n_ip,
  len(list_filter(card, lambda x: length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN} % 10 = 0)) AS n_card,
  len(list_filter(phone, lambda x: length({DIGITS}) BETWEEN 9 AND 15)) AS n_phone
FROM found
"""

EDITED_TEXTS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
followed AS (
  SELECT *, n_chars // 2 AS half, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM t
)
SELECT doc_id, n_chars, sha256(left(text, n_chars - half) || left(after, half)) AS edited_sha256 FROM followed
"""

# crc32 of the id as text, bit by bit: 3988292384 is the reflected polynomial.
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)
UNIGRAM_SCORES = f"""
WITH worded AS (SELECT doc_id, {CRC32} % 5 = 1 AS held_out, list_append({WORDS.format(LOWER)}, '') AS w FROM documents),
tokens AS (SELECT doc_id, held_out, unnest(w) AS token FROM worded),
counts AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
totals AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM tokens LEFT JOIN counts USING (token), totals
GROUP BY doc_id, held_out, n
"""


def _tree_levels(name: str, tree: str, levels: int) -> str:
    """CTEs {name}1 to {name}{levels} over {name}0 (tree, pos, n, h): each node with the digests beside it, then its parents."""
    made = []
    for k in range(levels):
        run = f"PARTITION BY {tree}, pos // 16 ORDER BY pos"
        made.append(
            f"{name}{k}s AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
        )
        made.append(
            f"{name}{k + 1} AS (SELECT {tree}, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h "
            f"FROM {name}{k} GROUP BY {tree}, pos // 16, n)"
        )
    return ",\n".join(made)


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_DOCUMENT_LEVELS, _SOURCE_LEVELS = 6, 4  # trees of up to 16 ** 6 documents, 16 ** 4 sources


def _merkle_proofs() -> str:
    steps = [("a", k) for k in range(_DOCUMENT_LEVELS)] + [("b", k) for k in range(_SOURCE_LEVELS)]
    joins, beside, columns = [], [], []
    for i, (name, k) in enumerate(steps):
        node = f"{name}{k}s"
        tree, place = (f"{node}.source IS NOT DISTINCT FROM t.source", "t.pos") if name == "a" else ("true", "u.pos")
        joins.append(f"JOIN {node} ON {tree} AND {node}.pos = {place} // {16 ** k}")
        beside.append(f"CASE WHEN {node}.n > 1 THEN {node}.l || {node}.r ELSE '' END")
        columns.append(f"{node}.n AS n{i}, {node}.l AS l{i}, {node}.r AS r{i}")
    # one fold a CTE, so that no expression holds another one twice
    folds = [f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN n{i} > 1 THEN sha256(l{i} || x || r{i}) ELSE x END AS x) FROM f{i})" for i in range(len(steps))]
    lowered = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    return f"""
WITH a0 AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    {_leaf("text")} AS h, CASE WHEN {CRC32} % 5 = 0 THEN {_leaf(lowered)} END AS altered
  FROM documents
),
{_tree_levels("a", "source", _DOCUMENT_LEVELS)},
b0 AS (SELECT 1 AS one, source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM a{_DOCUMENT_LEVELS}),
{_tree_levels("b", "one", _SOURCE_LEVELS)},
f0 AS (
  SELECT t.doc_id, t.h AS leaf, sub.h AS subroot, root.h AS root, sha256({" || ".join(beside)}) AS proof_sha256, coalesce(t.altered, t.h) AS x, {", ".join(columns)}
  FROM a0 t
  JOIN b0 u ON u.source IS NOT DISTINCT FROM t.source
  JOIN a{_DOCUMENT_LEVELS} sub ON sub.source IS NOT DISTINCT FROM t.source
  JOIN b{_SOURCE_LEVELS} root ON true
  {" ".join(joins)}
),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM f{len(steps)}
"""


MERKLE_PROOFS = _merkle_proofs()

_INTEGERS = """ints AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

NEAREST = f"""
WITH {_INTEGERS},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= 5
"""

HARD_NEGATIVES = f"""
WITH {_INTEGERS},
labelled AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ints WHERE label IS NOT NULL),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM labelled a JOIN labelled r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same)
  WHERE place <= 5
),
negative AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM positive JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""
