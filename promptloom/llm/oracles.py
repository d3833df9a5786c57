"""SQL for DuckDB that checks the queries it can express over whole tables."""

from __future__ import annotations

#: Spellings resolved by edit distance, word by word: equal before one slip (two from eight letters on) before a beginning.
_RESOLVED = """
  targets AS (SELECT DISTINCT f, v FROM (SELECT 'category' AS f, category AS v FROM sample_targets UNION ALL SELECT 'urgency', urgency FROM sample_targets UNION ALL SELECT 'domain', domain FROM sample_targets) WHERE v IS NOT NULL),
  parts AS (SELECT f, v, unnest(regexp_extract_all(lower(v), '[\\p{L}\\p{N}]+')) AS part FROM targets),
  records AS (
    SELECT 'run' AS src, run_id AS id, first(classification.category) AS category, first(classification.urgency) AS urgency, NULL AS domain FROM ticket_run WHERE run_id IS NOT NULL GROUP BY run_id
    UNION ALL SELECT 'query', query_id, NULL, NULL, first(domain) FROM routing WHERE query_id IS NOT NULL GROUP BY query_id),
  spellings AS (SELECT DISTINCT f, raw FROM (SELECT 'category' AS f, category AS raw FROM records UNION ALL SELECT 'urgency', urgency FROM records UNION ALL SELECT 'domain', domain FROM records) WHERE raw IS NOT NULL),
  words AS (SELECT f, raw, word FROM (SELECT f, raw, unnest(regexp_extract_all(lower(raw), '[\\p{L}\\p{N}]+')) AS word FROM spellings) WHERE word NOT IN ('and', 'or', 'the', 'of')),
  hits AS (
    SELECT words.f, raw, word, v, CASE WHEN word = part THEN 1
      WHEN length(part) >= 3 AND length(word) >= 2 AND damerau_levenshtein(word, part) <= CASE WHEN least(length(word), length(part)) >= 8 THEN 2 ELSE 1 END THEN 2
      WHEN length(word) >= 2 AND starts_with(part, word) THEN 3 END AS rank
    FROM words JOIN parts USING (f)),
  named AS (SELECT f, raw, v FROM hits WHERE rank IS NOT NULL QUALIFY rank = min(rank) OVER (PARTITION BY f, raw, word)),
  joined AS (
    SELECT f, raw, v FROM (SELECT f, raw, string_agg(w, '' ORDER BY i) AS j FROM (SELECT f, raw, unnest(regexp_extract_all(lower(raw), '[\\p{L}\\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(raw), '[\\p{L}\\p{N}]+'), 1) AS i FROM spellings) GROUP BY f, raw)
    JOIN targets USING (f) WHERE j = regexp_replace(lower(v), '[^\\p{L}\\p{N}]+', '', 'g')),
  meant AS (
    SELECT f, raw, min(v) AS v FROM named WHERE (f, raw) NOT IN (SELECT (f, raw) FROM joined) GROUP BY f, raw HAVING count(DISTINCT v) = 1
    UNION ALL SELECT f, raw, v FROM joined),
  resolved AS (
    SELECT src, id, a.v AS category, b.v AS urgency, c.v AS domain FROM records
    LEFT JOIN meant a ON a.f = 'category' AND a.raw = category LEFT JOIN meant b ON b.f = 'urgency' AND b.raw = urgency LEFT JOIN meant c ON c.f = 'domain' AND c.raw = domain),
  belongs AS (
    SELECT target_id, plan_name, src, id FROM sample_targets t JOIN resolved r ON (t.category IS NULL OR t.category = r.category) AND (t.urgency IS NULL OR t.urgency = r.urgency) AND (t.domain IS NULL OR t.domain = r.domain)),
  sizes AS (SELECT plan_name, floor(any_value(sample_share)::DECIMAL(18, 9) * count(DISTINCT (src, id)))::BIGINT AS size FROM belongs JOIN sample_targets USING (plan_name, target_id) GROUP BY plan_name),
  needs AS (
    SELECT t.target_id, greatest(t.min_rows, ceil(t.target_share::DECIMAL(18, 9) * coalesce(s.size, 0))::BIGINT) AS needed, coalesce(b.n, 0) AS available
    FROM sample_targets t LEFT JOIN sizes s USING (plan_name) LEFT JOIN (SELECT target_id, count(DISTINCT (src, id)) AS n FROM belongs GROUP BY target_id) b USING (target_id))"""

#: Seats by the priorities (2r - 1) / share, compared as whole numbers, floors first.
_SEATS = """
  own AS (SELECT target_id, count(*) AS n FROM (SELECT min(target_id) AS target_id FROM belongs GROUP BY plan_name, src, id) GROUP BY target_id),
  ranks AS (SELECT plan_name, target_id, coalesce(min_rows, 0) AS floor, (coalesce(target_share, 0)::DECIMAL(18, 9) * 1000000000)::HUGEINT AS share, unnest(range(1, n + 1)) AS r FROM sample_targets JOIN own USING (target_id)),
  queue AS (SELECT *, row_number() OVER (PARTITION BY plan_name ORDER BY r > floor, (2 * r - 1)::HUGEINT * 1000000000000000000000000::HUGEINT // share, target_id) AS place FROM ranks WHERE share > 0 OR r <= floor),
  seats AS (SELECT target_id, count(*) AS seats FROM queue JOIN sizes USING (plan_name) WHERE r <= floor OR place <= size GROUP BY target_id),
  plans_ AS (SELECT plan_name, count(DISTINCT (src, id)) AS n FROM belongs GROUP BY plan_name)"""

_SPACE = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+"
_TERMS = f"""
  runs AS (SELECT run_id, any_value(keywords) AS keywords FROM ticket_run WHERE run_id IS NOT NULL GROUP BY run_id),
  entries AS (SELECT run_id, trim(regexp_replace(nfc_normalize(lower(nfc_normalize(k))), '{_SPACE}', ' ', 'g')) AS term FROM (SELECT run_id, unnest(keywords) AS k FROM runs) WHERE k IS NOT NULL),
  counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT run_id) AS records FROM entries WHERE term <> '' GROUP BY term),
  marked AS (SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 100 > 8 * (SELECT count(*) FROM runs) THEN 'common' END AS mark FROM counts)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_RESOLVED} SELECT target_id FROM needs WHERE available < needed",
        "p1_report": f"""WITH {_RESOLVED}, {_SEATS} SELECT target_id, plan_name, coalesce(p.n, 0) AS records_in_plan, coalesce(size, 0) AS sample_size, available, needed, coalesce(seats, 0) AS seats, greatest(needed - available, 0) AS shortfall,
          coalesce(seats, 0) >= available AS exhausted FROM sample_targets JOIN needs USING (target_id) LEFT JOIN sizes USING (plan_name) LEFT JOIN plans_ p USING (plan_name) LEFT JOIN seats USING (target_id)""",
        "p3_found": f"WITH {_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p7_summary": "SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS torn, 0::BIGINT AS overfull FROM containers WHERE capacity_tokens > 0",
        "p3_terms": f"WITH {_TERMS} SELECT term, occurrences, records, mark FROM marked",
    }
