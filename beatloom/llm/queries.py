"""Queries of the corpus problems over the project tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm import canonical, contamination, history, language, spans, tokenizer, truncation
from beatloom.session import table

# ----------------------------------------------------------------- 2: language


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = table(spark, sf_dir, "beats").select("row_id", "lang", "narration_verbatim")
    labelled = language.sample(beats, "row_id", "narration_verbatim", "lang")
    return language.with_segments(beats, "narration_verbatim", labelled)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the narrations whose label is missing or wrong, or that mix languages."""
    return language.found_cases(_segmented(spark, sf_dir), "row_id", "lang")


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every narration."""
    rows = _segmented(spark, sf_dir).select("row_id", F.posexplode("segments").alias("segment_pos", "s"))
    return rows.select("row_id", F.col("segment_pos").cast("bigint").alias("segment_pos"), "s.begin", "s.end", "s.lang", F.round("s.confidence", 6).alias("confidence"))


# ------------------------------------------------------------------ 3: history


def _addresses(df: DataFrame, batch: Column, *columns: str) -> DataFrame:
    rows = df.select("rec_id", batch.alias("batch_number"), *columns)
    for c in columns:
        rows = history.with_address_key(rows, c, f"{c}_key")
    return history.written(history.signatures(rows, "rec_id", F.array(*[F.col(f"{c}_key") for c in columns]), F.col("batch_number")))


def _batches_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library and then the batches in turn, each checked against what was accepted before it and then appended."""
    past = history.History(spark)
    within_library = past.take(_addresses(table(spark, sf_dir, "clip_entries"), F.lit(0), "source_url"))
    found = past.take(_addresses(table(spark, sf_dir, "scraped_assets"), F.col("batch_no"), "source_url", "download_url"))
    return within_library.unionByName(found)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose media item was accepted before, with the first record of the item. The batches are taken while the query is built."""
    return _batches_checked(spark, sf_dir).select("first_rec_id", "rec_id")


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each repeated record was known: all its addresses, or some."""
    found = _batches_checked(spark, sf_dir)
    return found.groupBy("full_copy", "n_parts", "n_shared").agg(F.count(F.lit(1)).alias("n_records"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat paragraphs of documents of smaller id: full copies, and how many of the paragraphs were known."""
    documents = table(spark, sf_dir, "documents").select("doc_id", history.paragraphs(F.col("text")).alias("parts"))
    found = history.History(spark).take(history.written(history.signatures(documents, "doc_id", F.col("parts"))))
    return found.select(F.col("rec_id").alias("doc_id"), F.col("first_rec_id").alias("first_doc_id"), "full_copy", "n_parts", "n_shared")


# ---------------------------------------------------------------- 6: canonical


def _typed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = canonical.exploded(table(spark, sf_dir, "clip_entries"), "clip_entries", "rec_id", F.col("entities"))
    beats = canonical.exploded(table(spark, sf_dir, "beats"), "beats", "row_id", F.col("primary_visual.entities"))
    return clips.unionByName(beats)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entry meant by each freely typed entity, or -1."""
    return canonical.mapped_items(_typed_entities(spark, sf_dir), table(spark, sf_dir, "entity_reference"))


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that mean no reference entry, with the number of their occurrences."""
    reference = table(spark, sf_dir, "entity_reference")
    values = canonical.counted(canonical.cases(_typed_entities(spark, sf_dir), reference))
    mapped = canonical.mapped_values(values, reference, "entity_id", "name").where("entity_id >= 0")
    return values.join(mapped, "value", "left_anti").select("value", "n_items")


def p6_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which form of the value and at which distance the entries were met."""
    reference = table(spark, sf_dir, "entity_reference")
    values = canonical.counted(canonical.cases(_typed_entities(spark, sf_dir), reference))
    mapped = canonical.mapped_values(values, reference, "entity_id", "name").where("entity_id >= 0")
    return values.join(mapped, "value").groupBy("route", "distance").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n_items").alias("n_items"))


# --------------------------------------------------------------- 7: truncation


def _stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = truncation.texts(table(spark, sf_dir, "scraped_assets"), "scraped_assets", "rec_id", "source_type", "description")
    items = truncation.texts(table(spark, sf_dir, "timeline_items"), "timeline_items", "item_id", "origin", "text_overlay")
    return assets.unionByName(items)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose stored text lost its end."""
    return truncation.judged(_stored_texts(spark, sf_dir)).where("cut").select("src_table", "row_key")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts for each source."""
    return truncation.rates(_stored_texts(spark, sf_dir))


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hidden storage limits of each source by encoding."""
    return truncation.limits(_stored_texts(spark, sf_dir))


# ---------------------------------------------------------------- 8: tokenizer


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and tokens for each label of language."""
    counts = tokenizer.encoded(table(spark, sf_dir, "documents"), "doc_id", "text", keep=("lang", "n_chars")).select("lang", "n_chars", F.size("ids").cast("bigint").alias("n_ids"))
    return counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("n_ids").alias("n_ids"))


# ------------------------------------------------------------ 9: contamination


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain ten consecutive words of a held-out prompt."""
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each item leaked."""
    found = contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_windows").alias("most_windows"))


def p9_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a prompt or a part of it with other names and numbers."""
    return contamination.reparameterised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


# -------------------------------------------------------------------- 10: spans


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a common span of at least 320 characters."""
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal stretches of each document shared with others."""
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class of its exact copies and the number of classes that share a span with it."""
    return spans.linked_classes(table(spark, sf_dir, "documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    return spans.shares(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_segments, p3_found, p3_coverage, p3_paragraphs, p6_found, p6_unmatched, p6_routes, p7_found, p7_rates, p7_limits,
        p8_ids, p8_lengths, p9_found, p9_items, p9_reparameterised, p10_found, p10_classes, p10_spans, p10_shares,
    )
}

_ITEMS = r"""
addresses AS (
  SELECT rec_id, source_url AS address FROM clip_entries UNION ALL SELECT rec_id, source_url FROM scraped_assets UNION ALL SELECT rec_id, download_url FROM scraped_assets
), plain AS (
  SELECT rec_id, url_decode(regexp_replace(regexp_replace(address, '#.*$', ''), '^[A-Za-z]+://', '')) AS a FROM addresses WHERE trim(address) <> ''
), split AS (
  SELECT rec_id, a, lower(regexp_extract(a, '^([^/:?]*)', 1)) AS host FROM plain
), items AS (
  SELECT rec_id, CASE
    WHEN host LIKE '%stockpile.example' THEN 'stockpile:' || regexp_extract(a, '/(?:[^/?]*-)?([0-9]{6,})(?:/|[?]|$)', 1)
    WHEN host LIKE '%filmlocker.example' THEN 'filmlocker:' || regexp_extract(a, '[?&](?:id|asset)=([0-9]+)', 1)
    WHEN host LIKE '%agencywire.example' THEN 'agencywire:' || regexp_extract(a, '(?:/media/+|/item/+|-)([0-9a-f]{8})(?:[/?]|$)', 1)
    WHEN host = 'tbth.example' THEN 'tubethumb:' || regexp_extract(a, '^[^/]*/+([^/?]+)', 1)
    WHEN host LIKE '%tubethumb.example' THEN 'tubethumb:' || regexp_extract(a, '(?:[?&]v=|/vi/+|/embed/+)([A-Za-z0-9_-]+)', 1)
    ELSE 'openarchive:' || replace(regexp_extract(a, '(?:File:|/[0-9a-f]/+[0-9a-f]{2}/+)([^/?&]+)', 1), ' ', '_') END AS item
  FROM split
)"""

_LEAKS = r"""WITH words AS (
  SELECT 'd' AS src, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(prompt), '[\p{L}\p{N}]+') FROM eval_items WHERE prompt IS NOT NULL
), windows AS (
  SELECT src, id, unnest(list_transform(range(1, len(t) - 8), lambda i: array_to_string(t[i:i + 9], ' '))) AS w FROM words WHERE len(t) >= 10
) SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM windows d JOIN windows i USING (w) WHERE d.src = 'd' AND i.src = 'i'"""

_SHARED = r"""WITH windows AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 318), lambda i: md5(substring(text, i, 320)))) AS w FROM documents WHERE length(text) >= 320
) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM windows a JOIN windows b USING (w) WHERE a.doc_id < b.doc_id"""

_ITEM_WINDOWS = r"""WITH words AS (
  SELECT 'd' AS src, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(prompt), '[\p{L}\p{N}]+') FROM eval_items WHERE prompt IS NOT NULL
), places AS (
  SELECT src, id, t, unnest(range(1, len(t) - 8)) AS pos FROM words WHERE len(t) >= 10
), windows AS (
  SELECT src, id, pos, array_to_string(t[pos:pos + 9], ' ') AS w FROM places
), met AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(DISTINCT i.pos) AS n FROM windows d JOIN windows i USING (w) WHERE d.src = 'd' AND i.src = 'i' GROUP BY ALL
) SELECT item_id, count(*) AS n_docs, max(n) AS most_windows FROM met GROUP BY item_id"""

_COVERED = """WITH places AS (
  SELECT doc_id, text, unnest(range(0, length(text) - 319)) AS pos FROM documents WHERE length(text) >= 320
), windows AS (
  SELECT doc_id, pos, md5(substring(text, CAST(pos AS BIGINT) + 1, 320)) AS w FROM places
), held AS (
  SELECT w FROM windows GROUP BY w HAVING count(DISTINCT doc_id) > 1
), starts AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM windows JOIN held USING (w)
), runs AS (
  SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos - before > 320 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM starts
), spans AS (
  SELECT doc_id, CAST(min(pos) AS BIGINT) AS span_start, CAST(max(pos) + 320 AS BIGINT) AS span_end FROM runs GROUP BY doc_id, run
)"""

ORACLES = {
    "p3_found": f"""WITH {_ITEMS}, firsts AS (SELECT item, min(rec_id) AS first_rec_id FROM items GROUP BY item)
SELECT min(f.first_rec_id) AS first_rec_id, i.rec_id FROM items i JOIN firsts f USING (item) WHERE f.first_rec_id < i.rec_id GROUP BY i.rec_id""",
    "p3_paragraphs": r"""WITH parts AS (
  SELECT DISTINCT doc_id, lower(trim(regexp_replace(p, '\s+', ' ', 'g'))) AS p FROM (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS p FROM documents) t WHERE trim(regexp_replace(p, '\s+', ' ', 'g')) <> ''
), wholes AS (
  SELECT doc_id, string_agg(p, chr(31) ORDER BY p) AS w, count(*) AS n_parts FROM parts GROUP BY doc_id
), marked AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY p) AS first FROM parts
), shared AS (
  SELECT doc_id, min(first) AS first_doc_id, count(*) AS n_shared FROM marked WHERE first < doc_id GROUP BY doc_id
) SELECT doc_id, first_doc_id, f < doc_id AS full_copy, n_parts, n_shared FROM (SELECT doc_id, n_parts, min(doc_id) OVER (PARTITION BY w) AS f FROM wholes) x JOIN shared USING (doc_id)""",
    "p9_found": _LEAKS,
    "p9_items": _ITEM_WINDOWS,
    "p10_found": _SHARED,
    "p10_spans": f"{_COVERED} SELECT doc_id, span_start, span_end FROM spans",
    "p10_shares": f"""{_COVERED} SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) ELSE 0.0 END AS share
FROM documents LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n FROM spans GROUP BY doc_id) s USING (doc_id)""",
    "p10_classes": """WITH members AS (
  SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE length(text) >= 320
), places AS (
  SELECT class_id, text, unnest(range(0, length(text) - 319)) AS pos FROM members WHERE doc_id = class_id
), windows AS (
  SELECT DISTINCT class_id, md5(substring(text, CAST(pos AS BIGINT) + 1, 320)) AS w FROM places
), links AS (
  SELECT a.class_id, count(DISTINCT b.class_id) AS n_links FROM windows a JOIN windows b USING (w) WHERE a.class_id <> b.class_id GROUP BY a.class_id
) SELECT doc_id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM members LEFT JOIN links USING (class_id)""",
}
