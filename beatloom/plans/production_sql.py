"""DuckDB SQL of the production queries, written from what they are to compute, not from their Spark plans."""

from __future__ import annotations

from beatloom.functions import text as T
from beatloom.operators import production
from beatloom.plans.preparation_sql import BEATS
from beatloom.plans.studio_sql import _BEST, _CATALOG, _CHECKED, _HIT, _OFFSETS, _ORDER, _PIECES, _REQUESTS, _SCORED, _language, _low, _ordered_distinct, _strip, _top
from beatloom.sources import dimensions


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PLAIN = r"regexp_replace(regexp_replace({c}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


def _families(c: str) -> str:
    plain = _PLAIN.format(c=c)
    found = [f"regexp_extract_all({plain}, '(?i){p}')" for p in T.FAMILIES] + [f"regexp_extract_all({plain}, '{T.PROPER}')"]
    return f"list_transform(flatten([{', '.join(found)}]), lambda x: trim(x))"


_LANGUAGES = "languages(code, name, rtl, font, font_file, display_name, voice, voice_female) AS (VALUES " + ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else _q(v) for v in row) + ")" for row in dimensions.LANGUAGES) + ")"
_MOODS = "looks(mood, grade, shots) AS (VALUES " + ", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in production.MOODS) + ")"


def _at(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(b, '$.{p}')" for p in paths) + ")" if len(paths) > 1 else f"json_extract_string(b, '$.{paths[0]}')"


def _number(c: str) -> str:
    return f"CAST(CAST(coalesce(round({c}, 2), 0.0) AS DECIMAL(18, 2)) AS VARCHAR)"


_FIT = "scale=1920:1080:force_original_aspect_ratio=decrease,pad=1920:1080:(ow-iw)/2:(oh-ih)/2:black"
_CLIP = f"""'[' || item_id || ':v]{_FIT},trim=start=' || {_number('start_time')} || ':duration=' || {_number('duration')} || ',setpts=PTS-STARTPTS' || CASE motion
    WHEN 'push_in_slow' THEN ',zoompan=z=''min(zoom+0.0005,1.1)'':x=''iw/2-(iw/zoom/2)'':y=''ih/2-(ih/zoom/2)'':d=1:s=1920x1080' WHEN 'pan_left' THEN ',crop=iw:ih:iw*0.3*t/' || {_number('duration')} || ':0' ELSE '' END || ',format=yuv420p[v' || item_id || ']'"""
_STILL = f"""'[' || item_id || ':v]' || CASE motion WHEN 'push_in' THEN 'zoompan=z=''1+0.05*on/30'':x=''iw/2-(iw/zoom/2)'':y=''ih/2-(ih/zoom/2)'':d=1:s=1920x1080:fps=30'
    WHEN 'pan_right' THEN 'zoompan=z=''1.05'':x=''max(iw*0.05 - iw*0.05*on/' || CAST(floor(coalesce(duration, 0) * 30) AS BIGINT) || ',0)'':y=''ih/2-(ih*1.05/2)'':d=1:s=1920x1080:fps=30' ELSE '{_FIT}' END || ',trim=duration=' || {_number('duration')} || ',fps=30,format=yuv420p[v' || item_id || ']'"""
_CARD = f"""'color=c=black:s=1920x1080:d=' || {_number('duration')} || ':r=30[base];[base]drawtext=text=''' || replace(replace(coalesce(text_overlay, ''), '''', '\\'''), ':', '\\:') || ''':fontcolor=white:fontsize=72:fontfile=Arial:' || CASE text_position
    WHEN 'center' THEN 'x=(w-text_w)/2:y=(h-text_h)/2' WHEN 'bottom' THEN 'x=(w-text_w)/2:y=h*0.85' WHEN 'top' THEN 'x=(w-text_w)/2:y=h*0.1' ELSE 'x=w*' || {_number('position_x')} || ':y=h*' || {_number('position_y')} END || ':box=1:boxcolor=black@0.6:boxborderw=20[v' || item_id || ']'"""

_ADDITIVE = _top(
    f"""SELECT * FROM (SELECT request_id, entry_id, coalesce(list_sum(list_transform({_HIT}, lambda x: CASE x WHEN 2 THEN 50 WHEN 1 THEN 20 ELSE 0 END)), 0) + 15 * len(list_filter(r_actions, lambda a: list_contains(acts, a)))
  + 5 * len(list_filter(qw, lambda w: list_contains(dw, w))) AS tenths FROM worded WHERE CASE asset_type WHEN 'video' THEN media_type = 'video' WHEN 'image' THEN media_type IN ('image', 'video') ELSE TRUE END) p WHERE tenths > 0""",
    5,
)

_FIELDS = {"entity": "ent", "action": "act", "year": "yr"}


def _template(t: str) -> str:
    used = [n for n in _FIELDS if "{" + n + "}" in t]
    filled = _q(t)
    for n in used:
        filled = f"replace({filled}, '{{{n}}}', {_FIELDS[n]})"
    return f"CASE WHEN {' AND '.join(f'{_FIELDS[n]} <> {_q(str())}' for n in used)} THEN {filled} END"


_YEAR = r"\b(?:19|20)[0-9]{2}\b"

ORACLES = {
    "clue_beats": BEATS
    + f""" SELECT raw_id, CAST(beat_pos AS BIGINT) AS beat_pos, {_at('beat_id')} AS beat_id, {_at('narration_verbatim')} AS narration, TRY_CAST({_at('start_time', 'start')} AS DOUBLE) AS start_time, TRY_CAST({_at('end_time', 'end')} AS DOUBLE) AS end_time,
  coalesce({_at('asset_type', 'primary_visual.media_type')}, 'text_card') AS asset_type, coalesce({_at('search_terms', 'primary_visual.search_query')}, '') AS search_terms, coalesce({_at('strictness', 'primary_visual.strictness')}, 'general') AS strictness,
  coalesce({_at('mood')}, 'neutral') AS mood, coalesce({_at('text_overlay_title', 'text_overlay.content')}, '') AS overlay_title FROM beat""",
    "beats_multilingual": f"""WITH {_LANGUAGES}, {_PIECES}, timed AS (
  SELECT *, coalesce(sum(centis + 30) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM spoken
), named AS (
  SELECT *, array_to_string({_ordered_distinct('x')}, ' ') AS names FROM (SELECT *, {_families('narration')} AS x FROM timed) t
), coded AS (SELECT doc_id, {_language('text')} AS code FROM documents WHERE text IS NOT NULL)
SELECT doc_id, printf('B%03d', idx) AS beat_id, begun / 100.0 AS start_time, (begun + centis) / 100.0 AS end_time, centis / 100.0 AS duration, CASE WHEN names <> '' THEN names ELSE substring({_strip('narration')}, 1, 80) END AS search_terms,
  substring({_strip('narration')}, 1, 100) AS overlay_title, code AS language, name AS language_name, CASE WHEN rtl THEN 'rtl' ELSE 'ltr' END AS direction FROM named JOIN coded USING (doc_id) JOIN languages USING (code)""",
    "entity_families": f"""WITH e AS (SELECT row_id, list_filter(coalesce(primary_visual.entities, []), lambda v: v <> '') AS own, {_families("coalesce(narration_verbatim, '')")} AS x FROM beats)
SELECT row_id, array_to_string(CASE WHEN len(own) > 0 THEN own ELSE {_ordered_distinct('x')} END, '|') AS entities FROM e""",
    "retrieval": f"""WITH {_BEST} SELECT b.row_id, CASE WHEN t = 'text_card' OR m.entry_id IS NULL THEN 'text_card' ELSE m.media_type END AS media_type, CASE WHEN t = 'text_card' THEN NULL WHEN m.entry_id IS NULL THEN 'scrape_required' ELSE 'library' END AS source,
  CASE WHEN t <> 'text_card' THEN m.entry_id END AS entry_id, t <> 'text_card' AND m.entry_id IS NULL AS needs_scraping FROM (SELECT row_id, coalesce(primary_visual.media_type, 'text_card') AS t FROM beats) b LEFT JOIN best m USING (row_id)""",
    "library_then_scrape": f"""WITH {_BEST}, once AS (
  SELECT rec_id, entities FROM (SELECT *, row_number() OVER (PARTITION BY download_url ORDER BY rec_id) AS n FROM scraped_assets) t WHERE n = 1 OR download_url IS NULL
), held_by AS (
  SELECT DISTINCT rec_id, lower(e) AS entity FROM (SELECT rec_id, unnest(entities) AS e FROM once) t WHERE e <> ''
), wants AS (
  SELECT DISTINCT row_id, lower(e) AS entity FROM (SELECT row_id, unnest(primary_visual.entities) AS e FROM beats WHERE row_id NOT IN (SELECT row_id FROM best)) t
), offers AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY rec_id) AS n FROM (SELECT DISTINCT row_id, rec_id FROM wants JOIN held_by USING (entity)) t
) SELECT row_id, entry_id AS rec_id, 'library' AS origin FROM best UNION ALL SELECT row_id, rec_id, 'scraped' FROM offers WHERE n <= 2""",
    "identity_gates": f"""WITH {_CATALOG}, {_REQUESTS}, {_SCORED}, found AS ({_ADDITIVE}), asked AS (
  SELECT row_id AS request_id, list_filter(coalesce(primary_visual.entities, []), lambda e: regexp_matches(e, '[0-9]')) AS variants, regexp_extract_all(coalesce(narration_verbatim, ''), '{_YEAR}') AS years FROM beats
) SELECT f.request_id, f.entry_id, len(list_filter(variants, lambda v: NOT list_contains({_low('c.entities')}, lower(v)))) = 0 AND len(list_filter(years, lambda y: NOT contains(coalesce(c.description, ''), y))) = 0 AS passes
FROM found f JOIN asked a USING (request_id) JOIN catalog c USING (entry_id)""",
    "query_templates": f"""WITH f AS (SELECT rec_id, coalesce(list_filter(coalesce(entities, []), lambda e: e <> '')[1], '') AS ent, coalesce(list_filter(coalesce(tags, []), lambda e: e <> '')[1], '') AS act, regexp_extract(coalesce(created_at, ''), '{_YEAR}') AS yr FROM scraped_assets)
SELECT rec_id, array_to_string(list_filter([{', '.join(_template(t) for t in production.TEMPLATES)}], lambda x: x IS NOT NULL), '|') AS queries FROM f""",
    "mood_looks": f"WITH {_MOODS} SELECT row_id, coalesce(grade, 'standard') AS grade, coalesce(shots, 'steady') AS shots FROM beats b LEFT JOIN looks l ON lower(trim(b.mood)) = l.mood",
    "fallback_chain": BEATS
    + f""", v AS (SELECT raw_id, CAST(beat_pos AS BIGINT) AS beat_pos, {_at('primary_visual.media_type')} AS p, {_at('fallback_visual.media_type')} AS f, {_at('last_resort.type')} AS l FROM beat)
SELECT raw_id, beat_pos, CASE WHEN p IS NOT NULL THEN 'primary' WHEN f IS NOT NULL THEN 'fallback' ELSE 'last_resort' END AS level, coalesce(p, f, l, 'text_card') AS media_type FROM v""",
    "visual_types": r"""WITH asked AS (
  SELECT DISTINCT row_id, script_id, n, e FROM (SELECT row_id, script_id, coalesce(beat_number, -1) AS n, unnest(primary_visual.entities) AS e FROM beats) t WHERE e IN (SELECT name FROM entity_reference WHERE category = 'location')
), firsts AS (SELECT script_id, e, min(n) AS f FROM asked GROUP BY ALL), marked AS (
  SELECT row_id, max(CASE WHEN n = f THEN 1 ELSE 0 END) AS new FROM asked JOIN firsts USING (script_id, e) GROUP BY row_id
) SELECT b.row_id, CASE WHEN new IS NOT NULL AND regexp_matches(lower(coalesce(narration_verbatim, '')), '\b(?:route|road|crossing)\b') THEN 'map_route' WHEN new = 1 THEN 'animated_map' WHEN new = 0 THEN 'map_highlight'
  WHEN regexp_matches(narration_verbatim, '[0-9]{3,}') THEN 'text_card' WHEN regexp_matches(lower(narration_verbatim), '\b(?:compared|than|versus)\b') THEN 'comparison_graphic' ELSE coalesce(primary_visual.media_type, 'stock_image') END AS visual_type
FROM beats b LEFT JOIN marked m ON b.row_id = m.row_id""",
    "narration_files": f"""SELECT row_id, script_id, script_id || '_' || printf('%03d', place) AS file_name FROM (SELECT row_id, script_id, narration_verbatim, row_number() OVER ({_ORDER}) - 1 AS place FROM beats WHERE script_id IS NOT NULL) t
WHERE length({_strip('narration_verbatim')}) >= 10""",
    "script_estimates": r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: w <> '')) * 15 / 100.0 AS seconds FROM documents WHERE text IS NOT NULL",
    "language_contexts": f"""WITH {_LANGUAGES}, d AS (SELECT doc_id, CASE WHEN lower(trim(lang)) IN (SELECT code FROM languages) THEN lower(trim(lang)) ELSE 'en' END AS code FROM documents)
SELECT doc_id, code, display_name, font_file, voice, voice_female, CASE WHEN rtl THEN 'rtl' ELSE 'ltr' END AS direction FROM d JOIN languages USING (code)""",
    "asset_needs": """WITH k AS (SELECT script_id, coalesce(primary_visual.media_type, 'text_card') AS t FROM beats), c AS (
  SELECT script_id, count(*) FILTER (t IN ('video', 'video_clip')) AS n_videos, count(*) FILTER (t = 'image') AS n_images, count(*) FILTER (t IN ('map', 'animated_map')) AS n_maps, count(*) FILTER (t = 'text_card') AS n_text_cards, count(*) FILTER (t = 'graphic') AS n_graphics FROM k GROUP BY script_id
), e AS (SELECT DISTINCT script_id, e FROM (SELECT script_id, unnest(primary_visual.entities) AS e FROM beats) t WHERE e <> ''), l AS (
  SELECT script_id, string_agg(e, '|' ORDER BY encode(e)) AS entities, string_agg(e, '|' ORDER BY encode(e)) FILTER (e IN (SELECT name FROM entity_reference WHERE category = 'location')) AS locations FROM e GROUP BY script_id
) SELECT c.*, coalesce(l.entities, '') AS entities, coalesce(l.locations, '') AS locations FROM c LEFT JOIN l ON c.script_id IS NOT DISTINCT FROM l.script_id""",
    "times_used_after": f"WITH {_BEST} SELECT c.entry_id, c.times_used + count(m.row_id) AS times_used FROM catalog c LEFT JOIN best m USING (entry_id) GROUP BY c.entry_id, c.times_used",
    "job_pipeline": f"""WITH {_CHECKED}, {_OFFSETS}, {_BEST}, s AS (
  SELECT o.script_id, count(*) AS n_segments, count(m.entry_id) AS n_matched, sum(o.centis) / 100.0 AS seconds FROM offsets o LEFT JOIN best m USING (row_id) WHERE o.script_id IS NOT NULL GROUP BY o.script_id
), j AS (SELECT g.job_id, g.readiness, g.problems, s.* FROM graded g JOIN (SELECT job_id, script_id AS own FROM jobs) k USING (job_id) LEFT JOIN s ON k.own = s.script_id)
SELECT job_id, readiness, CASE WHEN readiness <> 'blocked' THEN coalesce(n_segments, 0) END AS n_segments, CASE WHEN readiness <> 'blocked' THEN coalesce(n_matched, 0) END AS n_matched, CASE WHEN readiness <> 'blocked' THEN coalesce(seconds, 0) END AS seconds,
  CASE WHEN readiness = 'blocked' THEN problems WHEN n_segments IS NULL THEN 'no beats' END AS error FROM j""",
    "preview_items": "SELECT job_id, item_id FROM (SELECT job_id, item_id, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(start_time, 0), item_id) AS n FROM timeline_items) t WHERE n <= 10",
    "render_filters": f"""SELECT item_id, CASE item_type WHEN 'video' THEN {_CLIP} WHEN 'image' THEN {_STILL} ELSE {_CARD} END AS filter,
  CASE WHEN coalesce(narration_start, 0) > 0 OR coalesce(narration_end, 0) > 0 THEN '[' || item_id || ':a]atrim=start=' || {_number('narration_start')} || ':duration=' || {_number('duration')} || ',asetpts=PTS-STARTPTS[a' || item_id || ']' END AS sound FROM timeline_items WHERE item_id IS NOT NULL""",
    "video_answers": "SELECT CAST(rec_id AS VARCHAR) AS source_id, coalesce(source_url, '') AS source_url, coalesce(download_url, '') AS download_url, coalesce(thumbnail_url, '') AS thumbnail_url, coalesce(photographer, '') AS photographer, coalesce(width, 0) + 1 AS width, coalesce(height, 0) AS height FROM scraped_assets",
    "photo_answers": "SELECT CAST(rec_id AS VARCHAR) AS source_id, coalesce(CASE WHEN width > 1000 THEN download_url END, source_url, '') AS download_url, coalesce(thumbnail_url, '') AS thumbnail_url, coalesce(description, '') AS description, coalesce(width, 0) AS width, coalesce(height, 0) AS height FROM scraped_assets",
    "archive_answers": """SELECT CAST(rec_id AS VARCHAR) AS source_id, coalesce(source_url, '') AS source_url, download_url, download_url AS thumbnail_url, substring(coalesce(description, ''), 1, 200) AS description, coalesce(nullif(license, ''), nullif(photographer, ''), 'CC') AS license, coalesce(width, 0) AS width, coalesce(height, 0) AS height
FROM scraped_assets WHERE download_url LIKE '%.jpg%'""",
    "thumbnail_sizes": """SELECT rec_id, quality, CASE quality WHEN 'maxresdefault' THEN 1280 ELSE 640 END AS width, CASE quality WHEN 'maxresdefault' THEN 720 ELSE 480 END AS height
FROM (SELECT rec_id, regexp_extract(coalesce(download_url, ''), '/vi/.*/([a-z]+)[.]jpg', 1) AS quality FROM scraped_assets) t WHERE quality <> ''""",
    "labelled_answers": r"""SELECT rec_id, CASE source_type WHEN 'pexels' THEN 'PEX' WHEN 'wikimedia' THEN 'WIK' WHEN 'youtube' THEN 'YT' WHEN 'local' THEN 'LOC' ELSE 'UNK' END || '_' || substring(md5(file_path), 1, 6) AS catalog_id,
  array_to_string(list_filter(list_transform(list_filter(coalesce(actions, []), lambda x: x <> ''), lambda x: trim(x)), lambda x: x <> ''), '|') AS entities, coalesce(nullif(trim(lower(quality)), ''), 'medium') AS quality, 'medium' AS shot_type,
  length(d) AS n_chars, d AS description FROM (SELECT *, trim(regexp_replace(coalesce(description, ''), '[\r\n]+', ' ', 'g')) AS d FROM clip_entries WHERE file_path IS NOT NULL) t""",
    "library_file": "SELECT CAST(rec_id AS VARCHAR) AS id, media_type AS type, file_path, topic, array_to_string(list_filter(entities, lambda e: e IS NOT NULL), '|') AS entities, coalesce(quality, 'medium') AS quality, times_used FROM clip_entries",
}
