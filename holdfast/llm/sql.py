"""The operators' results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from holdfast.llm.filter_audit import CAPITAL_PERCENT, DISTINCT_PERCENT, MARKS, WORDS
from holdfast.llm.mixing import MOST, SEED, SHARE, WEIGHTS
from holdfast.llm.tables import UPPER, WORD

MIX = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([{", ".join(map(str, WEIGHTS))}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), levels(turn, level) AS (
  -- The excess of full sources is shared again until no source is above its cap.
  SELECT 0, {SHARE} * sum(source_size) / sum(weight) FROM by_source
  UNION ALL
  SELECT turn + 1, (SELECT ({SHARE} * sum(source_size)
      - coalesce(sum(source_size * {MOST}) FILTER (WHERE weight * level > source_size * {MOST}), 0))
      / (sum(weight) - coalesce(sum(weight) FILTER (WHERE weight * level > source_size * {MOST}), 0)) FROM by_source)
  FROM levels WHERE turn < 60
), targets AS (
  SELECT source, source_size, least(weight * level, source_size * {MOST}) AS target
  FROM by_source, (SELECT level FROM levels WHERE turn = 60)
), placed AS (
  SELECT *, coalesce('=' || source, '') AS key,
    row_number() OVER (PARTITION BY source ORDER BY
      len(bin(size)) * 64 + ((size << 6) >> len(bin(size))),
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2))::INT,
      size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS rank
  FROM sized
), rated AS (
  SELECT p.doc_id, p.source, p.size, t.source_size, t.target, p.rank,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(p.source, chr(0))), 1, 12))::BIGINT / {float(16**12)} AS shift
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, least(floor(rank * rate + shift) - floor((rank - 1) * rate + shift), {MOST})::BIGINT AS copies FROM rated
)
"""

EXACT = f"""
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents
), grouped AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size,
  n.doc_id IS NOT DISTINCT FROM g.keep_id
    AND row_number() OVER (PARTITION BY n.doc_id, n.norm) = 1 AS kept,
  sha256(n.norm) AS text_sha256
FROM norm n JOIN grouped g ON n.norm = g.norm
"""


FILTERS = "ABCDE"


def _bits(letters: str) -> str:
    """The mask of the filters that a string of letters names."""
    return " + ".join(f"contains({letters}, '{x}')::INT * {1 << n}" for n, x in enumerate(FILTERS))


AUDIT = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), marked AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT d.part, coalesce(m.good, false)::INT AS good, coalesce(m.toxic, false)::INT AS toxic,
    (len(words) < {WORDS})::INT
    + (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::INT * 2
    + (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(t))::INT * 4
    + regexp_matches(t, '{MARKS}')::INT * 8
    + coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)::INT * 16 AS mask
  FROM docs d LEFT JOIN marked m ON d.doc_id = m.doc_id
), masks AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask
), orders(chosen, rest) AS (
  SELECT '', '{FILTERS}'
  UNION ALL
  SELECT chosen || x, replace(rest, x, '') FROM orders, (SELECT unnest(string_split('{FILTERS}', '')) AS x)
  WHERE contains(rest, x)
), steps AS (
  SELECT chosen AS filter_order, step, substr(chosen, step, 1) AS letter,
    {_bits("substr(chosen, 1, step - 1)")} AS before, {_bits("substr(chosen, step, 1)")} AS own
  FROM orders, (SELECT unnest(range(1, {len(FILTERS) + 1}))::INT AS step) WHERE rest = ''
), counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, letter
)
SELECT * EXCLUDE letter, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""

VECTORS = """
WITH usable AS (
  SELECT vec_id, label, row_number() OVER () AS row,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), vectors AS (
  SELECT * REPLACE (list_resize(v, (SELECT greatest(max(len(v)), 1) FROM usable), 0.0) AS v) FROM usable
)"""

NEGATIVES = f"""{VECTORS}, labelled AS (
  SELECT row, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM vectors WHERE label IS NOT NULL
), scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM labelled a JOIN labelled b ON a.row <> b.row WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, other) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
  (row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST, n.other))::INT AS rank,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

SEARCH = f"""{VECTORS}
SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score,
  (row_number() OVER (PARTITION BY a.row ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id NULLS LAST, b.row))::INT AS rank
FROM vectors a JOIN vectors b ON a.row <> b.row WHERE a.vec_id % 50 = 0
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": MIX
        + "SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM drawn",
        "op7_exact_dedup": EXACT,
        "op11_filter_audit": AUDIT,
        "op12_hard_negatives": NEGATIVES,
        "op13_exact_search": SEARCH,
    }
