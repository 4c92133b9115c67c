"""DuckDB statements for the queries that SQL can express, written apart from
the operators."""

from __future__ import annotations

from tidemark.llm import lattice, mixing, quality

W = r"[^\x20\x09-\x0D]"


def quality_rules() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)
    bullets = " OR ".join(f"starts_with(ltrim(l), '{b}')" for b in quality.BULLETS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  s AS (SELECT doc_id, text, regexp_extract_all(text, '{W}+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{W}')) AS ls FROM d),
  u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
  t AS (SELECT doc_id, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM t WHERE w3 IS NOT NULL) WHERE n > 1),
  c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 3) x(k) GROUP BY doc_id),
  m AS (SELECT s.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(ws, lambda w: length(w) > 1 AND w = upper(w) AND w <> lower(w))) AS n_upper_words, len(list_filter(ws, lambda w: regexp_matches(w, '\\p{{L}}'))) AS n_alpha_words,
    len(list_distinct(ws)) AS n_distinct_words, len(list_filter(ls, lambda l: ends_with(rtrim(l), '...') OR ends_with(rtrim(l), '…'))) AS n_ellipsis_lines,
    len(list_filter(ls, lambda l: {bullets})) AS n_bullet_lines FROM s LEFT JOIN c USING (doc_id)),
  b AS (SELECT *, ({bits})::BIGINT AS bits FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {quality.BASE}) <> 0 AS base_failed, (bits & {quality.POLICIES[quality.CURRENT]}) = 0 AS kept, bits FROM b"""


def source_mixing() -> str:
    """The exponent in closed form: with shares from p to q, the largest ratio
    of epochs is (q / p) to the power of one minus the exponent."""
    draw = lambda *parts: f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"
    limit, grid = mixing.Target().repetition, 1 << (mixing.LEVELS * mixing.PASSES)
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, {draw("'block0'", "doc_id::VARCHAR")} % {mixing.BLOCKS} AS block, len(regexp_extract_all(coalesce(text, ''), '{W}+')) AS n_tokens FROM documents),
  s AS (SELECT source, sum(n_tokens) AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
  p AS (SELECT source, tokens, tokens / sum(tokens) OVER () AS share FROM s),
  x AS (SELECT CASE WHEN max(share) <= {limit} * min(share) THEN 1.0 / {grid} ELSE least(1.0, ceil((1 - ln({limit}) / ln(max(share) / min(share))) * {grid}) / {grid}) END AS x FROM p),
  y AS (SELECT source, tokens, pow(share, x) AS pw, share FROM p, x),
  b AS (SELECT source, tokens::BIGINT AS tokens, round(pw * sum(tokens) OVER () * max(share / pw) OVER ())::BIGINT AS budget FROM y),
  k AS (SELECT source, block, sum(n_tokens)::BIGINT AS n FROM d GROUP BY ALL),
  e AS (SELECT source, block, n, budget // tokens AS whole, budget % tokens AS rest, epoch, {draw("'0'", "epoch::VARCHAR", "source", "block::VARCHAR")} AS o
    FROM k JOIN b USING (source), range(0, 64) t(epoch) WHERE epoch <= budget // tokens),
  q AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WINDOW w AS (PARTITION BY source, epoch ORDER BY o, block)),
  plan AS (SELECT source, block, epoch, rank FROM q WHERE epoch < whole OR rest > 0 AND 2 * before + n <= 2 * rest
    UNION ALL SELECT source, block, 0, 0 FROM k WHERE source NOT IN (SELECT source FROM s))
  SELECT doc_id, source, block, n_tokens::BIGINT AS n_tokens, epoch, rank FROM d JOIN plan USING (source, block)"""


def lattice_near_dedup() -> str:
    """All pairs; components by reachability."""
    return f"""WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM u WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {lattice.THRESHOLD}),
  r(a, b) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
  SELECT u.vec_id, (SELECT count(*) FROM l WHERE l.a = u.vec_id) AS n_links, component_id, component_id = u.vec_id AS kept FROM u JOIN c ON c.a = u.vec_id"""


ORACLES = {"op2_quality_rules": quality_rules(), "op5_source_mixing": source_mixing(), "op10_lattice_near_dedup": lattice_near_dedup()}
