"""DuckDB SQL of the core preparation queries, written independently of their Spark plans."""

from __future__ import annotations

_ROWS = """
rows AS (
  SELECT 'beats' AS src_table, script_id AS owner_id, CAST(round(start_time * 1000) AS BIGINT) AS lo, CAST(round(end_time * 1000) AS BIGINT) AS hi FROM beats
  UNION ALL
  SELECT 'timeline_items', job_id, CAST(round(start_time * 1000) AS BIGINT), CAST(round((start_time + duration) * 1000) AS BIGINT) FROM timeline_items
), marked AS (
  SELECT *, max(hi) OVER (PARTITION BY src_table, owner_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM rows WHERE hi > lo AND owner_id IS NOT NULL
)"""

_INSTANTS = r"""WITH raw AS (
  SELECT rec_id, created_at, coalesce(nullif(trim(capture_tz), ''), 'UTC') AS tz FROM scraped_assets UNION ALL SELECT rec_id, created_at, coalesce(nullif(trim(capture_tz), ''), 'UTC') FROM clip_entries
), texts AS (
  SELECT rec_id, tz, regexp_replace(created_at, '^\s+|\s+$', '', 'g') AS t FROM raw WHERE NOT regexp_full_match(created_at, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z')
), forms AS (
  SELECT rec_id, tz, t,
    regexp_extract(t, '^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:\.(\d+))?)?)?(Z|[+-]\d{2}:?\d{2})?(?:\[[^\]]*\])?$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z']) AS iso,
    regexp_extract(t, '^(\d{2})/(\d{2})/(\d{4}) (\d{2}):(\d{2}) ([AP])M$', ['mo', 'd', 'y', 'h', 'mi', 'half']) AS us,
    regexp_extract(t, '^(\d{2})\.(\d{2})\.(\d{4}) (\d{2}):(\d{2})$', ['d', 'mo', 'y', 'h', 'mi']) AS eu,
    regexp_extract(t, '^(?:[A-Z][a-z]{2}, )?(\d{1,2})[ -]([A-Z][a-z]{2})[ -](\d{4}) (\d{2}):(\d{2}):(\d{2}) ([A-Z]{3,4}|[+-]\d{2}:?\d{2})$', ['d', 'mon', 'y', 'h', 'mi', 's', 'z']) AS rfc
  FROM texts
), parts AS (
  SELECT rec_id, tz, t, CASE WHEN iso.y <> '' THEN iso.y || '-' || iso.mo || '-' || iso.d || ' ' || coalesce(nullif(iso.h, ''), '00') || ':' || coalesce(nullif(iso.mi, ''), '00') || ':' || coalesce(nullif(iso.s, ''), '00') || '.' || rpad(substring(iso.f, 1, 6), 6, '0')
      WHEN us.y <> '' THEN us.y || '-' || us.mo || '-' || us.d || ' ' || lpad(CAST(TRY_CAST(us.h AS INT) % 12 + CASE us.half WHEN 'P' THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || ':' || us.mi || ':00'
      WHEN eu.y <> '' THEN eu.y || '-' || eu.mo || '-' || eu.d || ' ' || eu.h || ':' || eu.mi || ':00'
      WHEN rfc.y <> '' THEN rfc.y || '-' || lpad(CAST(list_position(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], rfc.mon) AS VARCHAR), 2, '0') || '-' || lpad(rfc.d, 2, '0') || ' ' || rfc.h || ':' || rfc.mi || ':' || rfc.s END AS written,
    coalesce(nullif(iso.z, ''), nullif(rfc.z, '')) AS z FROM forms
), moments AS (
  SELECT rec_id, tz, t, TRY_CAST(written AS TIMESTAMP) AS local, CASE WHEN z SIMILAR TO '[+-].*' THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (TRY_CAST(z[2:3] AS INT) * 60 + TRY_CAST(right(z, 2) AS INT))
      ELSE CASE z WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'WET' THEN 0 WHEN 'WEST' THEN 60 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 WHEN 'IST' THEN 330 WHEN 'JST' THEN 540 WHEN 'AEST' THEN 600 WHEN 'AEDT' THEN 660 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'BRT' THEN -180 END END AS minutes FROM parts
), resolved AS (
  SELECT rec_id, CASE WHEN regexp_full_match(t, '\d{10}') THEN TRY_CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '\d{13}') THEN TRY_CAST(t AS BIGINT) * 1000 WHEN regexp_full_match(t, '\d{16}') THEN TRY_CAST(t AS BIGINT)
      WHEN minutes IS NOT NULL THEN epoch_us(local) - CAST(minutes AS BIGINT) * 60000000
      WHEN timezone(tz, timezone(tz, local) - INTERVAL 1 HOUR) = local THEN epoch_us(timezone(tz, local) - INTERVAL 1 HOUR) ELSE epoch_us(timezone(tz, local)) END AS utc_us FROM moments
) SELECT rec_id, CAST(utc_us AS BIGINT) AS utc_us FROM resolved WHERE utc_us IS NOT NULL"""

BEATS = r"""WITH texts AS (
  SELECT raw_id, CASE WHEN json_valid(trim(payload)) THEN trim(payload) ELSE regexp_extract(payload, '[\[{][\s\S]*[\]}]') END AS j FROM clue_payloads WHERE payload IS NOT NULL
), once AS (
  SELECT raw_id, CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') ELSE j END AS j FROM texts WHERE json_valid(j)
), roots AS (
  SELECT raw_id, CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') ELSE j END AS j FROM once WHERE json_valid(j)
), lists AS (
  SELECT raw_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE list_concat(json_extract(j, '$.beats[*]'), json_extract(j, '$.clue.beats[*]'), json_extract(j, '$.segments[*].beats[*]')) END AS l FROM roots
), beat AS (
  SELECT raw_id, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS beat_pos FROM lists
), fields AS (
  SELECT raw_id, beat_pos, 'primary_visual' AS node, json_extract(b, '$.primary_visual') AS v FROM beat UNION ALL SELECT raw_id, beat_pos, 'fallback_visual', json_extract(b, '$.fallback_visual') FROM beat
), opened AS (
  SELECT raw_id, beat_pos, node, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(json_extract_string(v, '$')) THEN CAST(json_extract_string(v, '$') AS JSON) ELSE v END AS v FROM fields
), objects AS (
  SELECT raw_id, beat_pos, node, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN [v] ELSE [] END AS l FROM opened
), visual AS (
  SELECT raw_id, beat_pos, node, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS node_pos FROM objects
)"""

_FLAT = BEATS + r""", entities AS (
  SELECT raw_id, beat_pos, node, node_pos, json_extract(o, '$.entities') AS e FROM visual
), named AS (
  SELECT raw_id, beat_pos, node, node_pos, CASE json_type(e) WHEN 'ARRAY' THEN json_extract(e, '$[*]') WHEN 'NULL' THEN [] ELSE [e] END AS l FROM entities WHERE e IS NOT NULL
), entity AS (
  SELECT raw_id, beat_pos, node, node_pos, unnest(l) AS i, generate_subscripts(l, 1) - 1 AS item_pos FROM named
), overlays AS (
  SELECT raw_id, beat_pos, CASE json_type(json_extract(b, '$.text_overlay')) WHEN 'ARRAY' THEN json_extract(b, '$.text_overlay[*]') ELSE [json_extract(b, '$.text_overlay')] END AS l FROM beat
), overlay AS (
  SELECT raw_id, beat_pos, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS node_pos FROM overlays
), items AS (
  SELECT raw_id, beat_pos, node, node_pos, item_pos, CASE json_type(i) WHEN 'OBJECT' THEN json_extract_string(i, '$.name') ELSE json_extract_string(i, '$') END AS item_value FROM entity
  UNION ALL SELECT raw_id, beat_pos, 'text_overlay', node_pos, 0, nullif(CASE json_type(o) WHEN 'OBJECT' THEN json_extract_string(o, '$.content') ELSE json_extract_string(o, '$') END, '') FROM overlay
) SELECT raw_id, CAST(beat_pos AS BIGINT) AS beat_pos, node, CAST(node_pos AS BIGINT) AS node_pos, CAST(item_pos AS BIGINT) AS item_pos, item_value FROM items WHERE item_value IS NOT NULL"""

ORACLES = {
    "p1_found": f"WITH {_ROWS} SELECT src_table, owner_id, reach AS gap_start_ms, lo AS gap_end_ms FROM marked WHERE lo > reach",
    "p1_periods": f"""WITH {_ROWS}, islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY src_table, owner_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked
) SELECT src_table, owner_id, min(lo) AS period_start_ms, max(hi) AS period_end_ms FROM islands GROUP BY src_table, owner_id, island""",
    "p4_found": _INSTANTS,
    "p5_found": _FLAT,
    "p5_beats": BEATS + " SELECT raw_id, CAST(beat_pos AS BIGINT) AS beat_pos, CASE json_type(b, '$.beat_id') WHEN 'VARCHAR' THEN json_extract_string(b, '$.beat_id') END AS beat_id FROM beat",
    "p5_visuals": BEATS
    + """ SELECT raw_id, CAST(beat_pos AS BIGINT) AS beat_pos, node, CAST(node_pos AS BIGINT) AS node_pos, CASE json_type(o, '$.media_type') WHEN 'VARCHAR' THEN json_extract_string(o, '$.media_type') END AS media_type
FROM visual WHERE json_type(o) <> 'NULL'""",
    "p5_terms": BEATS
    + """, fields_of AS (
  SELECT raw_id, beat_pos, node, node_pos, kind, json_extract(o, path) AS v FROM visual, (VALUES ('entity', '$.entities'), ('action', '$.actions'), ('context', '$.context')) p(kind, path)
), listed AS (
  SELECT raw_id, beat_pos, node, node_pos, kind, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'NULL' THEN [] ELSE [v] END AS l FROM fields_of WHERE v IS NOT NULL
), single AS (
  SELECT raw_id, beat_pos, node, node_pos, kind, unnest(l) AS i, generate_subscripts(l, 1) - 1 AS item_pos FROM listed
), valued AS (
  SELECT *, CASE WHEN kind = 'entity' AND json_type(i) = 'OBJECT' THEN json_extract_string(i, '$.name') ELSE json_extract_string(i, '$') END AS item_value FROM single
) SELECT raw_id, CAST(beat_pos AS BIGINT) AS beat_pos, node, CAST(node_pos AS BIGINT) AS node_pos, kind, CAST(item_pos AS BIGINT) AS item_pos, item_value FROM valued WHERE item_value IS NOT NULL""",
}
