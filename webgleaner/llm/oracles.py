"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _level(nodes: str, name: str) -> str:
    """Posterior of one level from ``n, k, prior``."""
    return f"""
{name}_rho AS (
  SELECT coalesce(CASE WHEN sum(room) > 0 THEN greatest(1e-4, least(0.99, sum(off_by) / sum(room))) END, 0.1) AS rho
  FROM (SELECT CASE WHEN n > 0 THEN n * pow(k / n - prior, 2) - prior * (1 - prior) END AS off_by,
               CASE WHEN n > 0 THEN (n - 1) * prior * (1 - prior) END AS room FROM {nodes})),
{name} AS (
  SELECT *, (k + strength * prior) / (n + strength) AS rate
  FROM (SELECT *, (1 - rho) / rho AS strength FROM {nodes}, {name}_rho))"""


OP1 = rf"""
WITH urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
outcomes AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
named AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k,
         regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.*$', '') AS name
  FROM urls LEFT JOIN outcomes ON doc_id = page_id GROUP BY host),
suffixed AS (
  SELECT *, CASE WHEN regexp_matches(name, '^[0-9.]+$') OR contains(name, ':') THEN name
                 WHEN two <> '' THEN two ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix
  FROM (SELECT *, regexp_extract(name, '(?:^|\.)((?:ac|co|com|edu|gov|net|org)\.[a-z][a-z])$', 1) AS two FROM named)),
hosts AS (
  SELECT host, n, k, suffix,
         CASE WHEN regexp_matches(name, '^[0-9.]+$') OR contains(name, ':') OR label = '' THEN name
              ELSE label || '.' || suffix END AS domain
  FROM (SELECT *, regexp_extract(left(name, greatest(length(name) - length(suffix) - 1, 0)), '([^.]*)$', 1) AS label FROM suffixed)),
by_domain AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
by_suffix AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM hosts) AS prior FROM by_domain GROUP BY suffix),
{_level("by_suffix", "suffix_post")},
domain_in AS (SELECT d.*, s.rate AS prior FROM by_domain d JOIN suffix_post s USING (suffix)),
{_level("domain_in", "domain_post")},
host_in AS (SELECT h.*, d.rate AS prior FROM hosts h JOIN domain_post d ON h.domain = d.domain AND h.suffix = d.suffix),
{_level("host_in", "host_post")},
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ruled AS (
  SELECT u.*, (SELECT r.rule_host || r.rule_path FROM rules r
               WHERE (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
               ORDER BY length(r.rule_host || r.rule_path) DESC, r.rule_host || r.rule_path DESC LIMIT 1) AS rule
  FROM urls u)
SELECT page_id, host, path, rule,
       coalesce((SELECT verdict FROM rules WHERE rule_host || rule_path = rule),
                CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       n AS n_labelled
FROM ruled JOIN host_post USING (host)
"""

OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce((SELECT CASE WHEN max(quality) > 0 THEN 2.0 WHEN max(quality) <= 0 THEN 0.5 END FROM labels l
                   WHERE l.doc_id = d.doc_id AND l.quality IS NOT NULL), 1.0)::DOUBLE AS weight
  FROM documents d),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('0/' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / weight AS key
  FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM totals),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM totals) - coalesce(sum(cap) OVER (
               ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, cap / w) FROM levels WHERE level * w < cap)), cap) AS target
  FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
running AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS part,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN part > 0 AND done + size / 2 <= part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

ORACLES = {"op1_url_reputation": OP1, "op4_source_mix": OP4}
