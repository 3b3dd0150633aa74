"""DuckDB SQL of the studio queries, written independently of their Spark plans."""

from __future__ import annotations

from beatloom.functions import text as T

_B = r"[ \t\n\r\f]"
_CUT = "chr(31) || chr(30) || chr(29)"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g')"


def _sentences(c: str) -> str:
    return f"string_split(regexp_replace({_strip(c)}, '([.!?]){_B}+', '\\1' || {_CUT}, 'g'), {_CUT})"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_B}+'), lambda w: w <> '')"


def _count(pattern: str, c: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def _low(c: str) -> str:
    return f"list_filter(list_transform(coalesce({c}, []), lambda v: lower(v)), lambda v: v <> '')"


def _ordered_distinct(c: str) -> str:
    return f"list_filter({c}, lambda y, i: list_position({c}, y) = i)"


_PIECES = f"""pieces AS (
  SELECT doc_id, unnest(s) AS narration, generate_subscripts(s, 1) AS idx FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents WHERE text IS NOT NULL)
), spoken AS (SELECT doc_id, idx, narration, len({_words('narration')}) * 15 + 150 AS centis FROM pieces WHERE length(narration) >= 5)"""

_PLAIN = r"regexp_replace(regexp_replace({c}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


def _entities(c: str) -> str:
    runs = rf"list_slice(regexp_extract_all({_PLAIN.format(c=c)}, '\b[A-Z][a-z]+(?:{_B}+[A-Z][a-z]+)*\b'), 1, 5)"
    known = f"list_filter({_list(T.KNOWN_TERMS)}, lambda t: contains(lower({c}), lower(t)))"
    return f"list_concat({runs}, {known})"


def _language(c: str) -> str:
    tokens = f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-ZÀ-ÿ]+'))"
    hits = {k: f"len(list_filter({tokens}, lambda w: list_contains({_list(v)}, w)))" for k, v in T.MARKERS.items()}
    best = f"greatest({', '.join(hits.values())})"
    scripts = " ".join(f"WHEN {_count(block, c)} * 10 > {_count(chr(92) + 'p{L}', c)} THEN '{lang}'" for lang, block in T.SCRIPTS.items())
    latin = " ".join(f"WHEN {h} = {best} THEN '{lang}'" for lang, h in hits.items())
    return f"CASE WHEN {c} IS NULL OR length({_strip(c)}) < 10 THEN 'en' {scripts} WHEN {best} * 50 <= len({tokens}) THEN 'en' {latin} END"


def _topic() -> str:
    found = f"list_filter({_list((*T.VEHICLES, *T.LOCATIONS))}, lambda t: contains(t0, t))"
    says = [" OR ".join(f"contains(t0, '{w}')" for w in group) for group in T.TOPIC_RULES]
    named = lambda other: f"CASE WHEN len(found) > 0 THEN array_to_string(found[1:2], ' ') ELSE '{other}' END"
    return f"""WITH a AS (SELECT row_id, lower(narration_verbatim) AS t0 FROM beats WHERE narration_verbatim IS NOT NULL), b AS (SELECT row_id, t0, {found} AS found FROM a)
SELECT row_id, CASE WHEN {says[0]} THEN {named('military equipment')} WHEN {says[1]} THEN 'military exercise' WHEN {says[2]} THEN 'map' WHEN {says[3]} THEN {named('history')} ELSE {named('military')} END AS topic,
  array_to_string(found, '|') AS entities, CASE WHEN {says[0]} THEN 'both' WHEN {says[1]} THEN 'video' WHEN {says[2]} OR {says[3]} THEN 'image' ELSE 'both' END AS asset_type FROM b"""


def _clean() -> str:
    c = "text"
    for pattern, to in T.CLEANING:
        c = f"regexp_replace({c}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    for mark in ".!?:":
        c = f"replace({c}, '{mark} ', '{mark} ... ')"
    return f"SELECT doc_id, substring({_strip(c)}, 1, 7500) AS spoken FROM documents"


_JSON = rf"""WITH x AS (
  SELECT raw_id, payload AS whole, regexp_extract(payload, '```(?:json)?{_B}*\n([\s\S]*?)\n```', 1) AS fenced,
    CASE WHEN contains(payload, '{{') AND contains(payload, '}}') THEN substring(payload, instr(payload, '{{'), length(payload) - instr(reverse(payload), '}}') + 2 - instr(payload, '{{')) END AS inner_part FROM clue_payloads
), h AS (SELECT *, CASE WHEN whole IS NULL THEN 'none' WHEN json_valid(whole) THEN 'whole' WHEN json_valid(fenced) THEN 'fenced' WHEN inner_part <> '' AND json_valid(inner_part) THEN 'embedded' ELSE 'none' END AS how FROM x)
SELECT raw_id, how, CASE how WHEN 'whole' THEN whole WHEN 'fenced' THEN fenced WHEN 'embedded' THEN inner_part END AS json FROM h"""

_CATALOG = """catalog AS (
  SELECT rec_id AS entry_id, CASE media_type WHEN 'video_clip' THEN 'video' ELSE media_type END AS media_type, topic, description, coalesce(entities, []) AS entities, coalesce(actions, []) AS actions,
    coalesce(environment, []) AS environment, lower(quality) AS quality, coalesce(times_used, 0) AS times_used, duration,
    CASE coalesce(lower(quality), 'medium') WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS q, least(coalesce(times_used, 0) * 2, 10) AS penalty FROM clip_entries
)"""

_REQUESTS = f"""requests AS (
  SELECT row_id AS request_id, coalesce(primary_visual.search_query, '') AS query, {_low('primary_visual.entities')} AS r_entities, {_low('primary_visual.actions')} AS r_actions, {_low('primary_visual.context')} AS r_context,
    primary_visual.strictness AS strictness, CASE primary_visual.media_type WHEN 'video_clip' THEN 'video' ELSE primary_visual.media_type END AS asset_type FROM beats WHERE row_id % 20 = 0
)"""


def _overlap(other: str) -> str:
    return f"len(list_intersect(list_distinct(qw), list_distinct({other})))"


_SCORED = f"""pairs AS (
  SELECT r.*, c.*, {_words('lower(r.query)')} AS qw, {_words("lower(coalesce(c.description, ''))")} AS dw, {_words("lower(coalesce(c.topic, ''))")} AS tw, {_low('c.entities')} AS ents, {_low('c.actions')} AS acts, {_low('c.environment')} AS envs
  FROM requests r CROSS JOIN catalog c
), worded AS (
  SELECT *, 3 * {_overlap('dw')} + 5 * {_overlap('tw')} + 10 * {_overlap(f'flatten(list_transform(list_concat(ents, acts), lambda v: {_words(chr(118))}))')} AS word_tenths FROM pairs
)"""


def _meets(asked: str, held: str) -> str:
    return f"len(list_filter({asked}, lambda a: len(list_filter({held}, lambda h: contains(h, a) OR contains(a, h))) > 0)) > 0"


def _top(scored: str, k: int) -> str:
    return f"""SELECT request_id, entry_id, rank, tenths / 10.0 AS score FROM (
  SELECT request_id, entry_id, tenths, row_number() OVER (PARTITION BY request_id ORDER BY tenths DESC, entry_id) AS rank FROM ({scored}) s) t WHERE rank <= {k}"""


_HIT = "list_transform(r_entities, lambda a: CASE WHEN list_contains(ents, a) THEN 2 WHEN len(list_filter(ents, lambda h: contains(h, a) OR contains(a, h))) > 0 THEN 1 ELSE 0 END)"

# every beat with a visual: what it asks for, under the defaults of the search (strictness general, quality medium), once for each different request
_BEST = f"""{_CATALOG}, asked AS (
  SELECT row_id, {_low('primary_visual.entities')} AS r_entities, list_sort(list_distinct({_words("lower(coalesce(primary_visual.search_query, ''))")})) AS qw FROM beats WHERE primary_visual IS NOT NULL
), wanted AS (
  SELECT r_entities, qw, row_number() OVER () AS request_id FROM (SELECT DISTINCT r_entities, qw FROM asked) t
), offered AS (
  SELECT entry_id, media_type, quality, penalty, {_low('entities')} AS ents, list_distinct({_words("lower(coalesce(description, ''))")}) AS dw, list_distinct({_words("lower(coalesce(topic, ''))")}) AS tw,
    list_distinct(flatten(list_transform(list_concat({_low('entities')}, {_low('actions')}), lambda v: {_words('v')}))) AS gw FROM catalog WHERE q >= 1
), pairs AS (
  SELECT request_id, r_entities, qw, o.*, list_filter({_HIT}, lambda x: x > 0)[1] AS hit FROM wanted CROSS JOIN offered o
), rated AS (
  SELECT request_id, entry_id, media_type, quality, 3 * len(list_intersect(qw, dw)) + 5 * len(list_intersect(qw, tw)) + 10 * len(list_intersect(qw, gw)) + CASE WHEN len(r_entities) = 0 THEN 0 WHEN hit = 2 THEN 30 ELSE 10 END - penalty AS tenths
  FROM pairs WHERE len(r_entities) = 0 OR hit IS NOT NULL
), top_entries AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tenths DESC, entry_id) AS n FROM rated) t WHERE n = 1
), best AS (
  SELECT a.row_id, f.entry_id, f.media_type, f.quality, f.tenths / 10.0 AS score FROM asked a JOIN wanted w ON a.r_entities = w.r_entities AND a.qw = w.qw JOIN top_entries f USING (request_id)
)"""

_STATUS = "CASE WHEN lower(trim(coalesce(status, 'queued'))) IN ('queued', 'running', 'done', 'error', 'blocked', 'skipped') THEN lower(trim(coalesce(status, 'queued'))) ELSE 'unknown' END"

_CHECKED = f"""checked AS (
  SELECT job_id, {_STATUS} AS state, s.script_id IS NULL AS no_script, audio IS NULL AS no_audio, c.script_id IS NULL AS no_clue, niche IS NULL AS no_niche FROM jobs j
  LEFT JOIN (SELECT DISTINCT script_id FROM documents WHERE script_id IS NOT NULL) s ON j.script_id = s.script_id
  LEFT JOIN (SELECT DISTINCT script_id FROM clue_payloads WHERE script_id IS NOT NULL) c ON j.script_id = c.script_id
), graded AS (
  SELECT job_id, state, CASE WHEN no_script THEN 'blocked' WHEN no_audio OR no_clue OR no_niche THEN 'gaps' ELSE 'ready' END AS readiness,
    concat_ws('; ', CASE WHEN no_script THEN 'script not found' END, CASE WHEN no_audio THEN 'audio not found' END, CASE WHEN no_clue THEN 'clue script missing' END, CASE WHEN no_niche THEN 'niche pack not found' END) AS problems FROM checked
)"""

_STEM = r"regexp_replace(regexp_replace({c}, '^.*/', ''), '\.[^.]*$', '')"
_STEMS = f"""scripts AS (SELECT DISTINCT script AS script, {_STEM.format(c='script')} AS stem FROM jobs WHERE script IS NOT NULL), sounds AS (SELECT DISTINCT audio, {_STEM.format(c='audio')} AS stem FROM jobs WHERE audio IS NOT NULL)"""

_ORDER = "PARTITION BY script_id ORDER BY coalesce(beat_number, -1), row_id"
_OFFSETS = f"""offsets AS (
  SELECT row_id, script_id, coalesce(sum(centis) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun, centis FROM (SELECT *, CAST(round(coalesce(duration, 5.0) * 100) AS BIGINT) AS centis FROM beats) b
)"""
_MOTION = "CASE WHEN mood IN ('tension', 'action', 'epic') THEN 'push_in_slow' WHEN mood IN ('hopeful', 'triumphant') THEN 'pan_right' WHEN quality = 'high' THEN 'push_in_slow' ELSE 'static' END"

_QUERIES_B = f"""WITH v AS (
  SELECT row_id, primary_visual.search_query AS terms, narration_verbatim AS narration, list_filter(coalesce(primary_visual.entities, []), lambda x: x IS NOT NULL)[1:2] AS ents, list_filter(coalesce(primary_visual.actions, []), lambda x: x IS NOT NULL)[1:2] AS acts FROM beats
), own AS (
  SELECT row_id, narration, list_concat(CASE WHEN coalesce(terms, '') <> '' THEN [terms] ELSE [] END, flatten(list_transform(ents, lambda e: CASE WHEN len(acts) > 0 THEN list_transform(acts, lambda a: e || ' ' || a) ELSE [e || ' footage'] END))) AS o FROM v
), filled AS (SELECT row_id, CASE WHEN len(o) > 0 THEN o ELSE [substring(coalesce(narration, ''), 1, 80)] END AS o FROM own)
SELECT row_id, array_to_string({_ordered_distinct('o')}[1:5], '|') AS queries FROM filled"""

_RENDER = f"""WITH {_BEST}, firsts AS (
  SELECT script_id, row_id AS first_row FROM (SELECT script_id, row_id, row_number() OVER ({_ORDER}) AS n FROM beats WHERE script_id IS NOT NULL) t WHERE n = 1
), rows AS (
  SELECT b.row_id, b.script_id, b.beat_number, coalesce(b.narration_verbatim, '') AS narration, CAST(round(coalesce(b.duration, 5.0) * 100) AS BIGINT) AS full_centis, m.media_type, m.quality, b.row_id = f.first_row AS is_first
  FROM beats b JOIN firsts f USING (script_id) LEFT JOIN best m ON b.row_id = m.row_id
), kinds AS (
  SELECT *, CASE WHEN media_type IN ('video', 'image') THEN media_type WHEN narration <> '' THEN 'text_card' END AS item_type FROM rows
), sized AS (
  SELECT *, CASE WHEN item_type = 'text_card' AND is_first THEN least(full_centis, 500) ELSE full_centis END AS centis FROM kinds WHERE item_type IS NOT NULL
) SELECT row_id, script_id, item_type, coalesce(sum(centis) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100.0 AS start_time, centis / 100.0 AS duration,
  CASE WHEN item_type = 'text_card' AND is_first THEN substring(narration, 1, 60) WHEN item_type = 'text_card' AND length(narration) > 120 THEN substring(narration, 1, 120) || '...' WHEN item_type = 'text_card' THEN narration
    WHEN item_type = 'image' AND length(narration) > 50 THEN substring(narration, 1, 100) ELSE '' END AS text_overlay,
  CASE WHEN item_type = 'image' THEN 'push_in' WHEN item_type = 'video' AND quality = 'high' THEN 'push_in_slow' ELSE 'static' END AS motion,
  CASE WHEN item_type = 'image' THEN 'dissolve' WHEN item_type = 'video' OR is_first THEN 'cut' ELSE 'fade' END AS transition_in FROM sized"""

_RTL = "('ar')"

ORACLES = {
    "beats": f"""WITH {_PIECES} SELECT doc_id, printf('B%03d', idx) AS beat_id, narration, begun / 100.0 AS start_time, (begun + centis) / 100.0 AS end_time, centis / 100.0 AS duration FROM (
  SELECT *, coalesce(sum(centis + 30) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM spoken) t""",
    "script_duration": f"WITH {_PIECES} SELECT doc_id, count(*) AS n_beats, sum(centis + 30) / 100.0 AS clue_seconds, sum(centis) / 100.0 AS timeline_seconds FROM spoken GROUP BY doc_id",
    "entities_caps": f"WITH e AS (SELECT row_id, {_entities('narration_verbatim')} AS x FROM beats WHERE narration_verbatim IS NOT NULL) SELECT row_id, array_to_string({_ordered_distinct('x')}[1:8], '|') AS entities FROM e",
    "entity_terms": f"WITH e AS (SELECT {_entities('text')} AS x FROM documents WHERE text IS NOT NULL), d AS (SELECT unnest({_ordered_distinct('x')}[1:8]) AS entity FROM e) SELECT entity, count(*) AS n_docs FROM d GROUP BY entity",
    "lang_detect": f"SELECT doc_id, {_language('text')} AS detected FROM documents",
    "lang_accuracy": f"SELECT lang, count(*) AS n_docs, count(*) FILTER (lang = detected) AS n_agree FROM (SELECT lang, {_language('text')} AS detected FROM documents WHERE lang IS NOT NULL) t GROUP BY lang",
    "topic_analysis": _topic(),
    "text_clean": _clean(),
    "json_extract": _JSON,
    "catalog_counts": f"WITH {_CATALOG} SELECT count(*) AS total_entries, count(*) FILTER (media_type = 'video') AS videos, count(*) FILTER (media_type = 'image') AS images, count(*) FILTER (media_type = 'map') AS maps, count(*) FILTER (media_type = 'graphic') AS graphics FROM catalog",
    "coverage_by_entity": f"WITH {_CATALOG}, h AS (SELECT unnest(entities) AS entity, CAST(round(coalesce(duration, 0) * 100) AS BIGINT) AS centis FROM catalog) SELECT entity, count(*) AS clips, sum(centis) / 100.0 AS duration FROM h WHERE entity IS NOT NULL GROUP BY entity",
    "entity_index": f"WITH {_CATALOG}, h AS (SELECT DISTINCT entry_id, lower(e) AS entity FROM (SELECT entry_id, unnest(entities) AS e FROM catalog) t) SELECT entity, count(*) AS n_entries, min(entry_id) AS first_entry, max(entry_id) AS last_entry FROM h WHERE entity IS NOT NULL GROUP BY entity",
    "entity_postings": f"WITH {_CATALOG} SELECT DISTINCT lower(e) AS entity, entry_id FROM (SELECT entry_id, unnest(entities) AS e FROM catalog) t WHERE e IS NOT NULL",
    "action_index": f"WITH {_CATALOG}, h AS (SELECT DISTINCT entry_id, lower(e) AS action FROM (SELECT entry_id, unnest(actions) AS e FROM catalog) t) SELECT action, count(*) AS n_entries, min(entry_id) AS first_entry, max(entry_id) AS last_entry FROM h WHERE action IS NOT NULL GROUP BY action",
    "upsert_latest": "SELECT asset_id, rec_id, source_type, topic FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY rec_id DESC) AS n FROM scraped_assets WHERE asset_id IS NOT NULL) t WHERE n = 1",
    "search_text": f"WITH {_CATALOG}, {_REQUESTS}, {_SCORED} " + _top("SELECT request_id, entry_id, word_tenths - penalty AS tenths FROM worded WHERE q >= 1", 20),
    "search_gated": f"WITH {_CATALOG}, {_REQUESTS}, {_SCORED}, gated AS (SELECT *, list_filter({_HIT}, lambda x: x > 0)[1] AS hit FROM worded WHERE q >= 1) "
    + _top(
        f"""SELECT request_id, entry_id, word_tenths + CASE WHEN len(r_entities) = 0 THEN 0 WHEN hit = 2 THEN 30 ELSE 10 END + CASE WHEN len(r_actions) > 0 THEN 15 ELSE 0 END + CASE WHEN len(r_context) > 0 THEN 9 ELSE 0 END - penalty AS tenths FROM gated
  WHERE (len(r_entities) = 0 OR hit = 2 OR (hit = 1 AND coalesce(strictness, 'general') NOT IN ('exact', 'specific'))) AND (len(r_actions) = 0 OR {_meets('r_actions', 'acts')}) AND (len(r_context) = 0 OR {_meets('r_context', 'envs')})""",
        20,
    ),
    "search_additive": f"WITH {_CATALOG}, {_REQUESTS}, {_SCORED} "
    + _top(
        f"""SELECT * FROM (SELECT request_id, entry_id, coalesce(list_sum(list_transform({_HIT}, lambda x: CASE x WHEN 2 THEN 50 WHEN 1 THEN 20 ELSE 0 END)), 0) + 15 * len(list_filter(r_actions, lambda a: list_contains(acts, a)))
  + 5 * len(list_filter(qw, lambda w: list_contains(dw, w))) AS tenths FROM worded WHERE CASE asset_type WHEN 'video' THEN media_type = 'video' WHEN 'image' THEN media_type IN ('image', 'video') ELSE TRUE END) p WHERE tenths > 0""",
        5,
    ),
    "best_match_per_beat": f"WITH {_BEST} SELECT row_id, entry_id, media_type, score FROM best",
    "gap_requests": f"WITH {_BEST}, o AS (SELECT DISTINCT row_id, lower(e) AS entity FROM (SELECT row_id, unnest(primary_visual.entities) AS e FROM beats WHERE row_id NOT IN (SELECT row_id FROM best)) t) SELECT entity, count(*) AS n_beats FROM o WHERE entity <> '' GROUP BY entity",
    "coverage_ratio": f"WITH {_BEST} SELECT script_id, count(*) AS n_beats, count(m.row_id) AS n_matched, round(count(m.row_id) / count(*), 6) AS share_matched FROM beats b LEFT JOIN best m ON b.row_id = m.row_id GROUP BY script_id",
    "job_status": f"SELECT count(*) AS total_jobs, count(*) FILTER (s = 'done') AS completed, count(*) FILTER (s = 'error') AS failed, count(*) FILTER (s = 'queued') AS remaining, count(*) FILTER (s = 'blocked') AS blocked, count(*) FILTER (s = 'running') AS running FROM (SELECT {_STATUS} AS s FROM jobs) t",
    "job_preflight": f"WITH {_CHECKED} SELECT job_id, readiness, problems FROM graded",
    "variant_round_robin": f"WITH {_CHECKED}, p AS (SELECT job_id, row_number() OVER (ORDER BY CASE readiness WHEN 'ready' THEN 0 ELSE 1 END, job_id) AS position FROM graded WHERE readiness <> 'blocked' AND state <> 'done') SELECT job_id, position, 'F' || (position % 10 + 1) AS format_variant FROM p",
    "job_json": "SELECT job_id, '{' || array_to_string(list_filter(["
    + ", ".join(f"'\"{c}\":' || CAST(to_json({c}) AS VARCHAR)" for c in ("job_id", "title", "niche", "status", "format_variant"))
    + "], lambda x: x IS NOT NULL), ',') || '}' AS json FROM jobs",
    "append_job": f"""WITH f AS (SELECT DISTINCT script_id, title || ' (again)' AS title FROM jobs WHERE {_STATUS} = 'error'), n AS (SELECT script_id, title, row_number() OVER (ORDER BY script_id, title) AS i FROM f)
SELECT job_id, script_id, title FROM jobs UNION ALL SELECT printf('J%03d', i + (SELECT count(*) FROM jobs)), script_id, title FROM n""",
    "stem_join": f"WITH {_STEMS} SELECT script, audio, array_to_string(list_transform(regexp_extract_all(replace(stem, '_', ' '), '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title FROM scripts JOIN sounds USING (stem) WHERE stem <> ''",
    "stem_anti": f"WITH {_STEMS} SELECT script FROM scripts s WHERE stem <> '' AND NOT EXISTS (SELECT 1 FROM sounds o WHERE o.stem = s.stem)",
    "queue_stream": f"SELECT job_id, state FROM (SELECT job_id, {_STATUS} AS state FROM jobs) t WHERE state NOT IN ('done', 'blocked', 'skipped')",
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start_s, event_type, count(*) AS n_events FROM events GROUP BY ALL",
    "query_build_a": "SELECT rec_id, array_to_string(list_concat([topic], list_transform(list_filter(coalesce(entities, []), lambda e: e IS NOT NULL)[1:3], lambda e: topic || ' ' || e), [topic || ' high quality', topic || ' footage'])[1:5], '|') AS queries FROM scraped_assets WHERE topic IS NOT NULL",
    "query_build_b": _QUERIES_B,
    "url_first_seen": "SELECT download_url, rec_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY download_url ORDER BY rec_id) AS n FROM scraped_assets) t WHERE n = 1 OR download_url IS NULL",
    "source_union_quota": "WITH b AS (SELECT rec_id, topic, source_type FROM clip_entries UNION ALL SELECT rec_id, topic, source_type FROM scraped_assets) SELECT rec_id, topic, source_type FROM (SELECT *, row_number() OVER (PARTITION BY topic, source_type ORDER BY rec_id) AS n FROM b WHERE topic IS NOT NULL) t WHERE n <= 4",
    "library_first": "SELECT rec_id, asset_id AS clip_id, substring(topic, 1, 50) AS topic, substring(description, 1, 200) AS description, 'medium' AS quality FROM scraped_assets s WHERE NOT EXISTS (SELECT 1 FROM clip_entries c WHERE c.topic = s.topic)",
    "metadata_gate": "SELECT rec_id, source_type, height FROM scraped_assets WHERE height >= 1080 AND source_type IN (SELECT source_type FROM clip_entries WHERE license IS NOT NULL)",
    "asset_names": r"""WITH n AS (SELECT rec_id, substring(regexp_replace(asset_id, '[^A-Za-z0-9_-]', '_', 'g'), 1, 30) AS safe, media_type, regexp_extract(coalesce(download_url, ''), '(\.[A-Za-z0-9]{2,4})(?:[?#].*)?$', 1) AS ending FROM scraped_assets WHERE asset_id IS NOT NULL)
SELECT rec_id, safe || CASE WHEN ending <> '' THEN ending WHEN media_type IN ('video', 'video_clip') THEN '.mp4' ELSE '.jpg' END AS file_name FROM n""",
    "beat_timeline": f'WITH {_OFFSETS} SELECT row_id, script_id, begun / 100.0 AS start, (begun + centis) / 100.0 AS "end", centis / 100.0 AS duration FROM offsets',
    "timeline_segments": f"""WITH {_OFFSETS}, {_BEST} SELECT o.row_id, o.script_id, o.begun / 100.0 AS start, (o.begun + o.centis) / 100.0 AS "end", o.centis / 100.0 AS duration, b.mood, coalesce(CASE WHEN m.entry_id IS NOT NULL THEN m.media_type ELSE 'text_card' END, NULL) AS media_type, m.entry_id,
  CASE WHEN m.entry_id IS NOT NULL THEN {_MOTION} END AS motion, CASE WHEN m.entry_id IS NOT NULL THEN 'cut' END AS transition FROM offsets o JOIN (SELECT row_id, coalesce(mood, 'neutral') AS mood FROM beats) b USING (row_id) LEFT JOIN best m ON o.row_id = m.row_id""",
    "render_items": _RENDER,
    "motion_assign": f"WITH {_BEST} SELECT row_id, {_MOTION} AS motion FROM beats JOIN (SELECT row_id, quality FROM best) m USING (row_id)",
    "first_mention": "WITH m AS (SELECT DISTINCT row_id, script_id, coalesce(beat_number, -1) AS beat_number, lower(e) AS entity FROM (SELECT row_id, script_id, beat_number, unnest(primary_visual.entities) AS e FROM beats) t) SELECT script_id, entity, CAST(min(beat_number) AS BIGINT) AS first_beat, count(*) AS n_beats FROM m WHERE entity <> '' GROUP BY script_id, entity",
    "transition_by_topic": f"SELECT row_id, CASE WHEN before IS NULL THEN 'start' WHEN before = topic THEN 'cut' ELSE 'dissolve' END AS transition FROM (SELECT row_id, coalesce(visual_intent, '') AS topic, lag(coalesce(visual_intent, '')) OVER ({_ORDER}) AS before FROM beats) t",
    "shot_runs": f"SELECT row_id, shot FROM (SELECT row_id, primary_visual.shot_type AS shot, lag(primary_visual.shot_type, 1) OVER ({_ORDER}) AS a, lag(primary_visual.shot_type, 2) OVER ({_ORDER}) AS b FROM beats) t WHERE shot = a AND shot = b",
    "overlay_style": f"""WITH s AS (SELECT row_id, substring(coalesce(text_overlay_title, narration_verbatim, ''), 1, 120) AS title, {_language('narration_verbatim')} AS code FROM beats)
SELECT row_id, title, '' AS subtitle, code, CASE code WHEN 'hi' THEN 'Noto Sans Devanagari' WHEN 'ar' THEN 'Noto Sans Arabic' WHEN 'ja' THEN 'Noto Sans JP' WHEN 'ko' THEN 'Noto Sans KR' WHEN 'zh' THEN 'Noto Sans SC' ELSE 'Inter' END AS font, CASE code WHEN 'ar' THEN 'rtl' ELSE 'ltr' END AS direction FROM s""",
    "drawtext": f"""WITH t AS (SELECT item_id, replace(replace(replace(text_overlay, '''', '\\'''), ':', '\\:'), '%', '\\%') AS safe, {_language('text_overlay')} AS code FROM timeline_items WHERE text_overlay <> '' AND item_id IS NOT NULL)
SELECT item_id, 'drawtext=text=''' || safe || ''':fontsize=52:fontcolor=white:box=1:boxcolor=black@0.7:boxborderw=10:' || CASE WHEN code IN {_RTL} THEN 'x=w-text_w-50:y=h-160' ELSE 'x=(w-text_w)/2:y=h-140' END || ':enable=''between(t,0,5)''' AS filter FROM t""",
}
