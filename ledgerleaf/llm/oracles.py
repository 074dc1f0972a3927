"""DuckDB SQL for the queries that SQL can express over whole tables."""

from .queries import MIX_DOMAIN, MIX_EPOCHS, MIX_LANG, MIX_SEED, MIX_SHARE

_ESCAPED = r"regexp_replace({}, '(\\|</?turn>|<media )', '\\\1', 'g')"

OP9 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, '<turn>' || replace({_ESCAPED.format("role")}, chr(10), '\n') || chr(10) || {_ESCAPED.format("text")} || chr(10) || '</turn>' || chr(10) AS shaped FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, shaped)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, shaped), '')) AS loss_sha256,
  CAST(sum(length(shaped)) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments,
  CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS n_tokens
FROM f GROUP BY conv_id
"""


def _level(name: str, source: str, parent: list[str], key: str) -> str:
    """One level of water-filling as SQL: ``source`` has the parent's columns, key, cap, weight and budget."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    return f"""
{name}_r AS (SELECT *, cap / weight AS ratio FROM {source} WHERE weight > 0),
{name}_l AS (SELECT *, (budget - coalesce(sum(cap) OVER ({by} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER ({by} ORDER BY ratio, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER ({by} ORDER BY ratio, {key}) AS pos FROM {name}_r),
{name}_f AS (SELECT *, min(CASE WHEN level <= ratio THEN pos END) OVER ({by}) AS first_at FROM {name}_l),
{name}_v AS (SELECT *, max(CASE WHEN pos = first_at THEN level END) OVER ({by}) AS found FROM {name}_f),
{name} AS (SELECT *, coalesce(least(cap, weight * found), cap) AS share FROM {name}_v)"""


_DOMAIN = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_DOMAIN.items())
_LANG = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_LANG.items())
OP10 = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN coalesce(length(source), 0) <= 4 THEN 'small' ELSE 'large' END AS domain, lang AS language, source AS origin,
    CAST(greatest(1, ceil(coalesce(strlen(text), 0) / 4.0)) AS BIGINT) AS n_tokens FROM documents
), leaf AS (SELECT domain, language, origin, CAST(sum(n_tokens) AS BIGINT) AS available FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(available) * {float(MIX_EPOCHS)} AS cap, CASE domain {_DOMAIN} ELSE 1.0 END AS weight,
  (SELECT {MIX_SHARE} * sum(available) FROM leaf) AS budget FROM leaf GROUP BY domain),
{_level("s1", "n1", [], "domain")},
n2 AS (SELECT l.domain, l.language, sum(available) * {float(MIX_EPOCHS)} AS cap, CASE l.language {_LANG} ELSE 1.0 END AS weight, any_value(s1.share) AS budget
  FROM leaf l JOIN s1 USING (domain) GROUP BY l.domain, l.language),
{_level("s2", "n2", ["domain"], "language")},
n3 AS (SELECT l.domain, l.language, l.origin, l.available, l.available * {float(MIX_EPOCHS)} AS cap, 1.0 AS weight, s2.share AS budget
  FROM leaf l JOIN s2 ON l.domain = s2.domain AND l.language IS NOT DISTINCT FROM s2.language),
{_level("s3", "n3", ["domain", "language"], "origin")},
b AS (SELECT domain, language, origin, CAST(floor(share + 1e-6) AS BIGINT) // available AS whole, CAST(floor(share + 1e-6) AS BIGINT) % available AS rest FROM s3),
p AS (SELECT d.*, b.whole, b.rest, sum(n_tokens) OVER (PARTITION BY d.domain, d.language, d.origin
    ORDER BY md5('{MIX_SEED}:' || whole || ':' || doc_id), doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN b ON d.domain = b.domain AND d.language IS NOT DISTINCT FROM b.language AND d.origin IS NOT DISTINCT FROM b.origin),
c AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS times FROM p)
SELECT doc_id, domain, language, origin, n_tokens, CAST(e.epoch AS INTEGER) AS epoch FROM c, LATERAL (SELECT unnest(range(c.times)) AS epoch) AS e
"""

OP12 = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP13 = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM t),
g AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS size, unnest(words) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) FROM w
  ) GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, split_part(phrase, ' ', 1) AS x, split_part(phrase, ' ', 2) AS y, split_part(phrase, ' ', 3) AS z FROM g WHERE size > 1 AND f >= 10),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, x || ' ' || y AS phrase, f FROM c WHERE size = 3 UNION ALL SELECT lang, y || ' ' || z, f FROM c WHERE size = 3) GROUP BY ALL),
k AS (
  SELECT lang, size, phrase, f AS a, 1 AS cut, x AS head, CASE size WHEN 2 THEN y ELSE y || ' ' || z END AS rest FROM c
  UNION ALL SELECT lang, size, phrase, f, 2, x || ' ' || y, z FROM c WHERE size = 3
), s AS (
  SELECT k.lang, k.phrase, k.size, k.a, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.phrase = k.head JOIN g r ON r.lang = k.lang AND r.phrase = k.rest
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, cut) = 1
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n.n, score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN longer ON longer.lang = s.lang AND longer.phrase = s.phrase
WHERE s.size = 3 OR longer.f IS NULL OR 100 * longer.f < 50 * a
QUALIFY rank <= 2000
"""

ORACLES = {"op9_chat_format": OP9, "op10_mixing": OP10, "op12_hard_negatives": OP12, "op13_collocations": OP13}
