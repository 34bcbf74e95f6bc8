"""Named queries over the driver tables, and their SQL.

A document stands for a dossier's file (its source names the dossier, its id the
module), a line for a page, a benchmark item for a checklist item, a page's URL
for an archive member, a part for an approved product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import cases, entities, files, matching, ordering, paging, paragraphs, provenance, registry
from vellum.session import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SALT = "review"
#: Thresholds that give all statuses on the unrelated vectors of the driver tables.
STRICT, PARTIAL, GAP, FALLBACK = 0.35, 0.25, 0.10, 0.22


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def detected(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    return entities.detect(documents(spark, sf_dir).select("doc_id", "text"), kinds=kinds)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_change_report_all(spark, sf_dir)


#: The types that the SQL of some queries names; each has a companion ``_all`` over all definitions, which SQL cannot follow.
_SQL_KINDS = ("EMAIL", "IP_ADDRESS")


# --- entities ---------------------------------------------------------------------------------------------------------------------

_EMAIL = r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}"
_IP = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_FOUND = rf"""found AS (
  SELECT doc_id, 'EMAIL' AS entity_type, unnest(regexp_extract_all(text, '\b({_EMAIL})\b', 1)) AS v, 0.96 AS score FROM documents
  UNION ALL SELECT doc_id, 'IP_ADDRESS', unnest(regexp_extract_all(text, '\b({_IP})\b', 1)), 0.82 FROM documents
)"""


@query(rf"SELECT doc_id, v AS value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b({_EMAIL})\b', 1)) AS v FROM documents) GROUP BY ALL")
def pii_email_values(spark, sf_dir):
    return entities.exploded(detected(spark, sf_dir, ("EMAIL",))).groupBy("doc_id", F.col("text").alias("value")).agg(F.count("*").alias("n"))


@query(rf"""WITH one AS (SELECT doc_id, text, regexp_extract_all(text, '\b({_EMAIL})\b', 1) AS vs FROM documents)
SELECT doc_id, vs[1] AS value, CAST(instr(text, vs[1]) - 1 AS INTEGER) AS "start", CAST(instr(text, vs[1]) - 1 + length(vs[1]) AS INTEGER) AS "end" FROM one WHERE len(vs) = 1""")
def pii_email_offsets(spark, sf_dir):
    return detected(spark, sf_dir, ("EMAIL",)).where(F.size("entities") == 1).select("doc_id", F.inline("entities")).select("doc_id", F.col("text").alias("value"), "start", "end")


@query()
def pii_email_spans(spark, sf_dir):
    """Offsets of all addresses of all documents; the SQL of pii_email_offsets can follow only where there is one."""
    return entities.exploded(detected(spark, sf_dir, ("EMAIL",))).select("doc_id", F.col("text").alias("value"), "start", "end")


@query(rf"SELECT doc_id, v AS value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b({_IP})\b', 1)) AS v FROM documents) GROUP BY ALL")
def pii_ipv4_values(spark, sf_dir):
    return entities.exploded(detected(spark, sf_dir, ("IP_ADDRESS",))).groupBy("doc_id", F.col("text").alias("value")).agg(F.count("*").alias("n"))


@query()
def pii_fused_entities(spark, sf_dir):
    """All definitions over all texts."""
    return entities.exploded(detected(spark, sf_dir, None))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(text, '\b[\w.+-]+@([\w-]+\.[a-zA-Z]{{2,}})\b', '****@\1', 'g'), '\b{_IP}\b', 'XXX.XXX.XXX.XXX', 'g') AS full_text FROM documents")
def pii_full_anonymise(spark, sf_dir):
    return entities.anonymise(detected(spark, sf_dir, _SQL_KINDS), SALT, "full").select("doc_id", "full_text")


@query()
def pii_full_anonymise_all(spark, sf_dir):
    return entities.anonymise(detected(spark, sf_dir), SALT, "full").select("doc_id", "full_text")


@query()
def pii_pseudonymise(spark, sf_dir):
    return entities.anonymise(detected(spark, sf_dir), SALT, "pseudo").select("doc_id", "pseudo_text", F.size("mapping").cast("long").alias("n_tokens"))


@query("SELECT doc_id, text AS restored FROM documents")
def mapping_reidentify(spark, sf_dir):
    done = entities.anonymise(detected(spark, sf_dir), SALT, "pseudo")
    return done.select("doc_id", entities.reidentified(F.col("pseudo_text"), F.col("mapping")).alias("restored"))


@query(rf"""WITH {_FOUND}
SELECT doc_id, entity_type, v AS original_value,
  CASE entity_type WHEN 'EMAIL' THEN '****@' || split_part(v, '@', 2) ELSE 'XXX.XXX.XXX.XXX' END AS full_anon_value, 'regex' AS detection_source, CAST(score AS DOUBLE) AS confidence, count(*) AS occurrences
FROM found GROUP BY ALL""")
def pii_change_report(spark, sf_dir):
    report = entities.change_report(entities.anonymise(detected(spark, sf_dir, _SQL_KINDS), SALT))
    return report.select("doc_id", "entity_type", "original_value", "full_anon_value", "detection_source", "confidence", "occurrences")


@query()
def pii_change_report_all(spark, sf_dir):
    report = entities.change_report(entities.anonymise(detected(spark, sf_dir), SALT))
    return report.select("doc_id", "entity_type", "original_value", "full_anon_value", "detection_source", "confidence", "occurrences")


@query()
def pii_change_report_tokens(spark, sf_dir):
    return entities.change_report(entities.anonymise(detected(spark, sf_dir), SALT)).select("doc_id", "serial_no", "pseudo_value")


@query(f"WITH {_FOUND} SELECT entity_type, count(*) AS n, count(DISTINCT v) AS n_values FROM found GROUP BY 1")
def pii_type_summary(spark, sf_dir):
    return entities.type_summary(entities.exploded(detected(spark, sf_dir, _SQL_KINDS)))


@query()
def pii_type_summary_all(spark, sf_dir):
    return entities.type_summary(entities.exploded(detected(spark, sf_dir)))


@query(f"WITH {_FOUND} SELECT 'regex' AS source, count(*) AS n FROM found")
def pii_source_summary(spark, sf_dir):
    return entities.source_summary(entities.exploded(detected(spark, sf_dir, _SQL_KINDS)))


@query()
def pii_source_summary_all(spark, sf_dir):
    return entities.source_summary(entities.exploded(detected(spark, sf_dir)))


@query(f"WITH {_FOUND} SELECT count(DISTINCT v) AS unique_values, count(DISTINCT entity_type) AS unique_types, count(*) AS spans FROM found")
def pii_totals(spark, sf_dir):
    return entities.totals(entities.exploded(detected(spark, sf_dir, _SQL_KINDS)))


@query()
def pii_totals_all(spark, sf_dir):
    return entities.totals(entities.exploded(detected(spark, sf_dir)))


@query(f"WITH {_FOUND} SELECT entity_type, count(*) AS n, CASE entity_type WHEN 'IP_ADDRESS' THEN 'PII' ELSE '' END AS category FROM found GROUP BY 1")
def pii_legend(spark, sf_dir):
    return entities.legend(entities.exploded(detected(spark, sf_dir, _SQL_KINDS)))


@query()
def pii_legend_all(spark, sf_dir):
    return entities.legend(entities.exploded(detected(spark, sf_dir)))


@query()
def pii_category_rollup(spark, sf_dir):
    """Spans and types found by category; those outside the catalogue have an empty one."""
    return pii_legend_all(spark, sf_dir).groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("n_types"))


@query()
def pii_randomization_spans(spark, sf_dir):
    spans = entities.exploded(detected(spark, sf_dir, ("RANDOMIZATION_CODE",)))
    return spans.select("doc_id", F.col("text").alias("value"), "start", "end")


@query(f"WITH {_FOUND} SELECT CASE entity_type WHEN 'IP_ADDRESS' THEN 'IP ADDRESS' ELSE entity_type END AS label, count(*) AS n FROM found GROUP BY 1")
def ui_label_rollup(spark, sf_dir):
    return entities.label_rollup(entities.exploded(detected(spark, sf_dir, _SQL_KINDS)))


@query()
def ui_label_rollup_all(spark, sf_dir):
    return entities.label_rollup(entities.exploded(detected(spark, sf_dir)))


@query(rf"""WITH {_FOUND}, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), inside AS (
  SELECT doc_id, unnest(regexp_extract_all(l, '\b({_EMAIL})\b', 1)) AS v FROM lines)
SELECT doc_id, v AS value, count(*) AS n FROM inside GROUP BY ALL""")
def spans_in_paragraphs(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    spans = entities.exploded(detected(spark, sf_dir, ("EMAIL",))).withColumnRenamed("text", "value")
    hit = docs.join(spans.select("doc_id").distinct(), "doc_id", "left_semi")
    return entities.spans_in_paragraphs(spans, entities.paragraph_offsets(hit)).where(F.substring("paragraph", F.col("local_start") + 1, F.length("value")) == F.col("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, CAST(i AS INTEGER) AS para, CAST(coalesce(list_sum(list_transform(ls[1:i], lambda x: length(x) + 1)), 0) AS INTEGER) AS p_start
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d, unnest(range(len(ls))) AS r(i)""")
def paragraph_offsets(spark, sf_dir):
    return entities.paragraph_offsets(documents(spark, sf_dir)).select("doc_id", "para", "p_start")


# --- pages ------------------------------------------------------------------------------------------------------------------------

_PAGES = "pages_ AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS raw_text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents)"
_MEMBERS = f"""WITH {_PAGES}, o AS (SELECT *, page - 1 AS ord, count(*) OVER (PARTITION BY file) AS n FROM pages_),
c AS (SELECT *, greatest(1, CAST(ceil((n - 1) / 19.0) AS BIGINT)) AS k FROM o),
m AS (SELECT file, page, ord, raw_text, ord // 19 AS chunk, k FROM c UNION ALL SELECT file, page, ord, raw_text, ord // 19 - 1, k FROM c WHERE ord % 19 = 0)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.lines_as_pages(documents(spark, sf_dir))


@query(f"{_MEMBERS} SELECT file, CAST(page AS INTEGER) AS page, chunk FROM m WHERE chunk >= 0 AND chunk < k")
def chunk_membership(spark, sf_dir):
    return paging.window_members(pages(spark, sf_dir)).select("file", "page", "chunk")


@query(f"{_MEMBERS} SELECT file, chunk, count(*) AS n_pages, string_agg(chr(10) || '--- [FILE: ' || file || ' | PAGE: ' || page || '] ---' || chr(10) || raw_text, '' ORDER BY ord) AS text FROM m WHERE chunk >= 0 AND chunk < k GROUP BY ALL")
def chunk_text(spark, sf_dir):
    return paging.window_texts(paging.window_members(pages(spark, sf_dir))).drop("mapping")


@query("""WITH o AS (SELECT conv_id AS file, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord, count(*) OVER () AS n FROM conversations),
m AS (SELECT *, ord // 19 AS chunk FROM o UNION ALL SELECT *, ord // 19 - 1 FROM o WHERE ord % 19 = 0)
SELECT chunk, count(*) AS n_pages, count(DISTINCT file) AS n_files FROM m WHERE chunk >= 0 AND chunk < greatest(1, CAST(ceil((n - 1) / 19.0) AS BIGINT)) GROUP BY 1""")
def chunk_global(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page"), F.col("text").alias("raw_text"))
    return paging.window_members(turns, across_files=True).groupBy("chunk").agg(F.count("*").alias("n_pages"), F.count_distinct("file").alias("n_files"))


@query(f"""{_MEMBERS}, one AS (SELECT file, chunk, arg_min(trim(raw_text), ord) FILTER (WHERE trim(raw_text) <> '') AS partial FROM m WHERE chunk >= 0 AND chunk < k GROUP BY ALL)
SELECT file, string_agg(coalesce(partial, ''), chr(10) ORDER BY chunk) AS summary, count(*) AS n_chunks FROM one GROUP BY 1""")
def summaries(spark, sf_dir):
    """Map each window, reduce each file, with the stand-in model."""
    windows = paging.window_texts(paging.window_members(pages(spark, sf_dir)))
    return paging.reduced(paging.map_windows(windows, paging.first_line))


@query("SELECT doc_id AS file, CAST(i AS INTEGER) AS page, substring(text, (i - 1) * 3000 + 1, 3000) AS raw_text FROM documents, unnest(range(1, CAST(ceil(length(text) / 3000.0) AS BIGINT) + 1)) AS r(i) WHERE trim(substring(text, (i - 1) * 3000 + 1, 3000), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def pseudo_pages_chars(spark, sf_dir):
    return paging.pages_of_chars(documents(spark, sf_dir))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s]+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id AS file, CAST(i AS INTEGER) AS page, array_to_string(ws[(i - 1) * 400 + 1 : i * 400], ' ') AS raw_text FROM w, unnest(range(1, CAST(ceil(len(ws) / 400.0) AS BIGINT) + 1)) AS r(i)""")
def pseudo_pages_words(spark, sf_dir):
    return paging.pages_of_words(documents(spark, sf_dir))


@query(rf"""WITH {_PAGES}, g AS (SELECT file, page, len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda x: x <> '')) > 80 AND length(trim(raw_text)) > 40 AS good FROM pages_),
a AS (SELECT *, bool_or(good) OVER (PARTITION BY file) AS any_good FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page) AS rn FROM a WHERE good OR NOT any_good)
SELECT file, CAST(page AS INTEGER) AS page FROM r WHERE rn <= 3""")
def page_substantive_filter(spark, sf_dir):
    return paging.substantive_pages(pages(spark, sf_dir)).select("file", "page")


@query(rf"""WITH {_PAGES}, b AS (SELECT *, max(CAST(len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda x: x <> '')) >= 15 AS INTEGER)) OVER (PARTITION BY file ORDER BY page ROWS UNBOUNDED PRECEDING) AS begun FROM pages_ WHERE raw_text <> ''),
t AS (SELECT *, coalesce(sum(length(raw_text)) OVER (PARTITION BY file ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM b WHERE begun = 1)
SELECT file, CAST(page AS INTEGER) AS i FROM t WHERE taken < 18000""")
def docx_prefix_filter(spark, sf_dir):
    rows = pages(spark, sf_dir).select("file", F.col("page").alias("i"), F.col("raw_text").alias("paragraph"))
    return paging.lead_paragraphs(rows, 18_000).select("file", "i")


@query(rf"""WITH {_PAGES}, b AS (SELECT *, max(CAST(len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda x: x <> '')) >= 15 AS INTEGER)) OVER (PARTITION BY file ORDER BY page ROWS UNBOUNDED PRECEDING) AS begun FROM pages_ WHERE raw_text <> ''),
t AS (SELECT file, string_agg(raw_text, chr(10) ORDER BY page) AS t FROM b WHERE begun = 1 GROUP BY file)
SELECT file, md5(trim(left(t, 3000), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS text_md5 FROM t""")
def docx_prefix_text(spark, sf_dir):
    """The lead text of each file, as its digest: the last paragraph is cut."""
    rows = pages(spark, sf_dir).select("file", F.col("page").alias("i"), F.col("raw_text").alias("paragraph"))
    return paging.lead_texts(rows).select("file", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(rf"""WITH {_PAGES}, g AS (SELECT file, page, len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda x: x <> '')) > 80 AND length(trim(raw_text)) > 40 AS good FROM pages_),
a AS (SELECT *, bool_or(good) OVER (PARTITION BY file) AS any_good FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page) AS rn FROM a WHERE good OR NOT any_good)
SELECT file, CAST(page AS INTEGER) AS page FROM r WHERE rn <= CASE WHEN file % 4 = 0 THEN 5 ELSE 3 END""")
def page_limit_by_section(spark, sf_dir):
    """Substantive pages with the limit of their document's section; every fourth document is a quality section."""
    sections = documents(spark, sf_dir).select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 4 == 0, "3.2.S.1").otherwise("1.2").alias("section"))
    return paging.limited_pages(pages(spark, sf_dir), sections).select("file", "page")


@query("""WITH f AS (SELECT source AS module, CAST(doc_id AS VARCHAR) AS path, chr(10) || chr(10) || '===== ' || doc_id || ' =====' || chr(10) || chr(10) || left(text, 120000) AS block FROM documents),
s AS (SELECT *, 400000 - coalesce(sum(length(block)) OVER (PARTITION BY module ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f),
k AS (SELECT module, path, left(block, CAST(room AS BIGINT)) AS block FROM s WHERE length(block) <= room OR room > 500)
SELECT module, md5(string_agg(block, '' ORDER BY path)) AS text_md5, count(*) AS n_files FROM k GROUP BY 1""")
def module_text_aggregate(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("source").alias("module"), F.col("doc_id").cast("string").alias("path"), "text")
    return paging.module_texts(rows).select("module", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_files")


# --- matching ---------------------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of small ids as checklist items, the others as documents, dealt to five modules."""
    e = table(spark, sf_dir, "embeddings").withColumn("module", F.concat(F.lit("m"), F.col("vec_id") % 5 + 1))
    items = e.where("vec_id < 50").select("module", F.col("vec_id").alias("item"), F.col("vec_id").alias("item_ord"), F.col("embedding").alias("item_vec"))
    docs = e.where("vec_id >= 50").select("module", F.col("vec_id").alias("doc"), F.col("vec_id").alias("doc_ord"), F.col("embedding").alias("doc_vec"))
    return items, docs


def sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.similarity(*_vectors(spark, sf_dir))


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("item") % 3 == 0, "Mandatory").when(F.col("item") % 3 == 1, "Conditional").otherwise("Optional")
    return _vectors(spark, sf_dir)[0].select("module", "item", kind.alias("applicability"))


_SIMS = """sims AS (SELECT 'm' || (d.vec_id % 5 + 1) AS module, i.vec_id AS item, d.vec_id AS doc, round(list_dot_product(CAST(i.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS sim
  FROM embeddings d JOIN embeddings i ON d.vec_id % 5 = i.vec_id % 5 WHERE i.vec_id < 50 AND d.vec_id >= 50)"""
_RANKS = f"WITH {_SIMS}, ranks AS (SELECT *, row_number() OVER (PARTITION BY module, doc ORDER BY sim DESC, item) AS rk FROM sims)"
_MATCH = f"""{_RANKS},
best AS (SELECT module, item, arg_max(doc, struct_pack(s := sim, o := -doc)) AS doc, max(sim) AS sim FROM sims WHERE sim > 0 GROUP BY ALL),
clear AS (SELECT module, doc, round(max(sim) FILTER (WHERE rk = 1) - max(sim) FILTER (WHERE rk = 2), 6) AS clarity FROM ranks WHERE rk <= 2 GROUP BY ALL),
nom AS (SELECT module, item, count(DISTINCT doc) AS n FROM ranks WHERE rk <= 3 GROUP BY ALL),
pen AS (SELECT b.*, coalesce(n, 0) AS n, CASE WHEN clarity < 0.08 THEN sim * 0.88 ELSE sim END AS p FROM best b LEFT JOIN clear USING (module, doc) LEFT JOIN nom USING (module, item)),
sc AS (SELECT *, round(CASE WHEN n >= 2 THEN least(1.0, p + 0.12) ELSE p END, 6) AS score FROM pen),
st AS (SELECT *, CASE WHEN score >= {STRICT} THEN 'matched' WHEN score >= {STRICT - GAP} THEN 'needs_user_confirmation' ELSE 'missing' END AS status FROM sc),
sec AS (SELECT module, item, arg_max(doc, struct_pack(s := sim, o := -doc)) AS doc2, max(sim) AS sim2 FROM ranks WHERE rk BETWEEN 2 AND 3 AND sim >= {FALLBACK} GROUP BY ALL),
items AS (SELECT 'm' || (vec_id % 5 + 1) AS module, vec_id AS item, CASE vec_id % 3 WHEN 0 THEN 'Mandatory' WHEN 1 THEN 'Conditional' ELSE 'Optional' END AS applicability FROM embeddings WHERE vec_id < 50),
res AS (SELECT i.module, i.item, i.applicability, coalesce(status, 'missing') = 'missing' AND doc2 IS NOT NULL AS fb, doc, doc2, sim2, coalesce(status, 'missing') AS status0, coalesce(score, 0.0) AS score0, coalesce(n, 0) AS n FROM items i LEFT JOIN st USING (module, item) LEFT JOIN sec USING (module, item)),
matched AS (SELECT module, item, applicability, CASE WHEN fb THEN doc2 WHEN status0 <> 'missing' THEN doc END AS doc, CASE WHEN fb THEN sim2 ELSE score0 END AS score, CASE WHEN fb THEN 'needs_user_confirmation' ELSE status0 END AS status,
  CASE WHEN fb THEN 'secondary_fallback' ELSE 'primary' END AS match_method, n AS nominations FROM res)"""


@query(f"WITH {_SIMS} SELECT * FROM sims")
def dense_similarity(spark, sf_dir):
    return sims(spark, sf_dir).select("module", "item", "doc", "sim")


@query(f"{_RANKS} SELECT module, doc, item, sim, CAST(rk AS INTEGER) AS rank FROM ranks WHERE rk <= 3")
def topk_per_doc(spark, sf_dir):
    return matching.ranked(sims(spark, sf_dir)).where("rank <= 3").select("module", "doc", "item", "sim", "rank")


@query(f"{_RANKS} SELECT module, item, count(DISTINCT doc) AS nominations FROM ranks WHERE rk <= 3 GROUP BY ALL")
def nomination_count(spark, sf_dir):
    return matching.nominations(matching.ranked(sims(spark, sf_dir)))


@query(f"{_RANKS} SELECT module, doc, round(max(sim) FILTER (WHERE rk = 1) - max(sim) FILTER (WHERE rk = 2), 6) AS clarity FROM ranks WHERE rk <= 2 GROUP BY ALL")
def match_clarity(spark, sf_dir):
    return matching.clarity(matching.ranked(sims(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_SIMS}, ords AS (SELECT module, item, row_number() OVER (PARTITION BY module ORDER BY item) AS o FROM (SELECT DISTINCT module, item FROM sims)),
walk AS (
  SELECT DISTINCT module, CAST(0 AS BIGINT) AS o, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS item, CAST(NULL AS BIGINT) AS doc, CAST(0 AS DOUBLE) AS sim FROM ords
  UNION ALL
  SELECT w.module, w.o + 1, CASE WHEN b.sim >= {PARTIAL} THEN list_append(w.used, b.doc) ELSE w.used END, n.item, b.doc, coalesce(b.sim, 0)
  FROM walk w JOIN ords n ON n.module = w.module AND n.o = w.o + 1
  LEFT JOIN LATERAL (SELECT arg_max(s.doc, struct_pack(a := s.sim, b := -s.doc)) AS doc, max(s.sim) AS sim FROM sims s WHERE s.module = n.module AND s.item = n.item AND s.sim > 0 AND NOT list_contains(w.used, s.doc)) b ON true
)
SELECT module, item, CASE WHEN sim >= {PARTIAL} THEN doc ELSE -1 END AS doc, sim, CASE WHEN sim >= {STRICT} THEN 'matched' WHEN sim >= {PARTIAL} THEN 'needs_user_confirmation' ELSE 'missing' END AS status FROM walk WHERE o > 0""")
def greedy_assignment(spark, sf_dir):
    return matching.greedy(sims(spark, sf_dir), STRICT, PARTIAL).select("module", "item", F.coalesce("doc", F.lit(-1)).cast("long").alias("doc"), "sim", "status")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(checklist(spark, sf_dir), sims(spark, sf_dir), STRICT, GAP, FALLBACK)


@query(f"{_MATCH} SELECT module, item, coalesce(doc, -1) AS doc, score, status, match_method, nominations FROM matched")
def match_status(spark, sf_dir):
    return matched(spark, sf_dir).withColumn("doc", F.coalesce("doc", F.lit(-1)).cast("long"))


@query(f"{_MATCH} SELECT 'm' || (vec_id % 5 + 1) AS module, vec_id AS doc FROM embeddings WHERE vec_id >= 50 AND vec_id NOT IN (SELECT doc FROM matched WHERE doc IS NOT NULL)")
def extra_docs(spark, sf_dir):
    return matching.extras(_vectors(spark, sf_dir)[1].select("module", "doc"), matched(spark, sf_dir))


@query(f"{_MATCH} SELECT module, count(*) AS total, count(*) FILTER (WHERE status <> 'missing') AS submitted, NOT bool_or(applicability = 'Mandatory' AND status = 'missing') AS mandatory_complete FROM matched GROUP BY ROLLUP (module)")
def completeness_rollup(spark, sf_dir):
    return matching.completeness(checklist(spark, sf_dir), matched(spark, sf_dir))


@query(f"{_MATCH} SELECT module, list(item ORDER BY item) AS items FROM matched WHERE applicability <> 'Mandatory' AND status <> 'matched' GROUP BY 1")
def items_to_review(spark, sf_dir):
    return matching.to_review(checklist(spark, sf_dir), matched(spark, sf_dir))


@query("""WITH i AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)) AS ws FROM benchmark),
iw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w FROM i), d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2))) AS w FROM documents),
p AS (SELECT item_id, doc_id, n, count(*) AS shared FROM iw JOIN d USING (w) GROUP BY ALL)
SELECT item_id, doc_id, round(shared / n, 6) AS overlap FROM p WHERE shared >= 0.35 * n""")
def relevance_join(spark, sf_dir):
    titles = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("title"))
    return matching.relevance(titles, documents(spark, sf_dir).select("doc_id", "text"))


@query("""WITH b AS (SELECT item_id, trim(regexp_replace(lower(text), '[\\s]+', ' ', 'g')) AS t FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\\s]+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id, strpos(d.t, b.t) AS pos FROM b JOIN d ON contains(d.t, b.t)""".replace("\\\\", "\\"))
def snippet_locate(spark, sf_dir):
    """Where passages of the benchmark stand in normalised documents."""
    return provenance.located(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir))


@query(r"""WITH b AS (SELECT item_id, unnest([0, 1, 2, 4]) AS extra, regexp_split_to_array(trim(regexp_replace(lower(text), '[\s]+', ' ', 'g')), ' ') AS ws FROM benchmark),
s AS (SELECT item_id * 10 + extra AS item_id, array_to_string(ws[2 : 2 + extra], ' ') AS t FROM b WHERE len(ws) > 6),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\s]+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id, strpos(d.t, s.t) AS pos FROM s JOIN d ON contains(d.t, s.t)""")
def snippet_locate_short(spark, sf_dir):
    """The same for passages of one, two, three and five words: the second word of each item, and those behind it."""
    words = F.split(provenance.normal(F.col("text")), " ")
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("ws")).where(F.size("ws") > 6).withColumn("extra", F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 4)])))
    short = b.select((F.col("item_id") * 10 + F.col("extra")).alias("item_id"), F.array_join(F.slice("ws", F.lit(2), F.col("extra") + 1), " ").alias("text"))
    return provenance.located(short, documents(spark, sf_dir))


@query()
def snippet_items(spark, sf_dir):
    """The lines of each document that hold the snippet of the benchmark item with its number, strongly or weakly; tested against brute force."""
    pairs = documents(spark, sf_dir).select("doc_id", "text").repartition(tasks(spark)).select("doc_id", F.split("text", "\n").alias("items"), (F.col("doc_id") % 40).alias("n")).withColumn("page", provenance.page_of(F.col("items")))
    snippets = table(spark, sf_dir, "benchmark").select(F.pmod("item_id", F.lit(40)).alias("n"), "item_id", F.col("text").alias("snippet"))
    found = pairs.join(F.broadcast(snippets), "n").select("doc_id", "item_id", F.inline(F.array(provenance.items_of(F.col("snippet"), F.col("items"), F.col("page")))))
    return found.where((F.size("strong") > 0) | (F.size("weak") > 0))


# --- files ------------------------------------------------------------------------------------------------------------------------

_URLS = "u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


@query(f"""WITH {_URLS}, m AS (SELECT CASE page_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS archive, path, lower(regexp_extract(path, '[^/]*$')) AS key FROM u WHERE path <> '' AND NOT ends_with(path, '/'))
SELECT archive AS only_in, path, key FROM m WHERE key NOT IN (SELECT key FROM m GROUP BY key HAVING count(DISTINCT archive) = 2)""")
def version_diff(spark, sf_dir):
    return files.version_diff(_members(spark, sf_dir).select(F.when(F.col("page_id") % 2 == 0, "a").otherwise("b").alias("archive"), "path"))


@query(f"""WITH {_URLS}, p AS (SELECT DISTINCT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM u),
n AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM p), t AS (SELECT array_to_string(p[1:depth], '/') AS path, array_to_string(p[1:depth - 1], '/') AS parent, p[depth] AS name, depth, depth < len(p) AS inner_ FROM n)
SELECT path, parent, name, depth, CASE WHEN bool_or(inner_) THEN 'folder' ELSE 'file' END AS type, CASE WHEN bool_or(inner_) THEN '' ELSE lower(regexp_extract(name, '\\.([^.]+)$', 1)) END AS extension FROM t GROUP BY path, parent, name, depth""".replace("\\\\", "\\"))
def path_tree(spark, sf_dir):
    return files.tree(_members(spark, sf_dir))


@query(f"WITH {_URLS}, k AS (SELECT page_id, path, array_to_string(list_transform(regexp_extract_all(path, '(\\d+|\\D+)', 1), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 4, '0') || ltrim(x, '0') ELSE lower(x) END), '') AS key FROM u) SELECT page_id, key, CAST(row_number() OVER (ORDER BY key, page_id) AS BIGINT) AS place FROM k")
def natural_sort(spark, sf_dir):
    """Places of paths in natural order over the whole table."""
    rows = _members(spark, sf_dir).select("page_id", files.natural_key(F.col("path")).alias("key"))
    return ordering.numbered(rows, [F.col("key"), F.col("page_id")])


@query(f"WITH {_URLS} SELECT page_id, lower(regexp_extract(path, '[^/]*$')) AS base, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.([^.]+)$', 1)) AS extension FROM u")
def file_names(spark, sf_dir):
    return _members(spark, sf_dir).select("page_id", F.lower(files.basename(F.col("path"))).alias("base"), files.extension(F.col("path")).alias("extension"))


@query(rf"""WITH {_URLS}, n AS (SELECT page_id, lower(trim(regexp_replace(regexp_extract(replace(path, '\\', '/'), '[^/]*$'), '(?i)\\s*\\(page\\s*\\d+\\)\\s*$', ''))) AS nm, regexp_extract(replace(path, '\\', '/'), '[^/]*$') AS name FROM u),
x AS (SELECT *, regexp_replace(nm, '\\.[a-z0-9]+$', '') AS st, regexp_replace(nm, '[^a-z0-9]', '', 'g') AS cn FROM n WHERE nm <> ''),
y AS (SELECT *, list_filter(string_split_regex(st, '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM x),
a AS (SELECT DISTINCT upper(name) AS source_name, nm, st, cn, ws FROM y WHERE page_id % 2 = 0), b AS (SELECT * FROM y WHERE page_id % 2 = 1),
p AS (SELECT a.source_name, b.name, b.page_id, CASE WHEN a.nm = b.nm THEN 100 WHEN a.st = b.st THEN 95 WHEN a.cn = b.cn THEN 90 WHEN contains(a.cn, b.cn) OR contains(b.cn, a.cn) THEN 80 ELSE len(list_filter(a.ws, lambda w: list_contains(b.ws, w))) END AS score FROM a, b)
SELECT source_name, arg_max(name, struct_pack(s := score, o := -page_id)) AS name, max(score) AS score FROM p WHERE score > 0 GROUP BY 1""".replace("\\\\", "\\"))
def filename_fuzzy_match(spark, sf_dir):
    names = _members(spark, sf_dir).select("page_id", files.basename(F.col("path")).alias("name"))
    sources = names.where(F.col("page_id") % 2 == 0).select(F.upper("name").alias("source_name")).distinct()
    return files.best_files(sources, names.where(F.col("page_id") % 2 == 1).select("name", F.col("page_id").alias("ord")))


# --- registry, cases --------------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT p_partkey AS query_id, lower(split_part(p_name, ' ', 1)) AS name FROM part)
SELECT query_id, min(p_partkey) AS row_id FROM q JOIN part ON contains(lower(p_name), name) GROUP BY 1""")
def drug_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    queries = part.select(F.col("p_partkey").alias("query_id"), F.split("p_name", " ")[0].alias("name"), F.lit(None).cast("string").alias("strength"))
    known = part.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("drug_name"), F.col("p_type").alias("strength"))
    return registry.look_up(queries, known).select("query_id", "row_id")


_SEVERITY = """WITH s AS (SELECT doc_id, lower(text) AS t FROM documents),
r AS (SELECT doc_id, CASE WHEN contains(t, 'death') OR contains(t, 'fatal') THEN 'Death' WHEN contains(t, 'disability') OR contains(t, 'disabled') THEN 'Disability' WHEN contains(t, 'hospitalization') OR contains(t, 'hospitalisation') OR contains(t, 'admitted') THEN 'Hospitalisation' END AS event FROM s),
v AS (SELECT *, CASE event WHEN 'Hospitalisation' THEN 'Medium' WHEN 'Death' THEN 'High' WHEN 'Disability' THEN 'High' END AS severity FROM r)"""


@query(f"{_SEVERITY} SELECT * FROM v")
def severity_rules(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", cases.severity(F.col("text")).alias("s")).select("doc_id", "s.event", "s.severity")


@query(f"""{_SEVERITY}, s2 AS (SELECT lower(coalesce(event, 'Others') || ' ' || CASE doc_id % 3 WHEN 0 THEN 'Disability' WHEN 1 THEN 'prolonged hospital stay' ELSE '' END) AS s FROM v)
SELECT CASE WHEN contains(s, 'death') THEN 'Death' WHEN contains(s, 'disability') THEN 'Disability' WHEN contains(s, 'hospital') THEN 'Hospitalisation' ELSE 'Others' END AS bucket, count(*) AS n FROM s2 GROUP BY 1""")
def severity_histogram(spark, sf_dir):
    """Cases by what their seriousness says: the event found in the text, with a remark by number."""
    remark = F.when(F.col("doc_id") % 3 == 0, "Disability").when(F.col("doc_id") % 3 == 1, "prolonged hospital stay").otherwise("")
    rows = documents(spark, sf_dir).select(F.concat(F.coalesce(cases.severity(F.col("text"))["event"], F.lit("Others")), F.lit(" "), remark).alias("seriousness"))
    return cases.histogram(rows)


@query("""WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) AS first_sig, min(doc_id) OVER (PARTITION BY source || '-' || (n_chars // 10)) AS first_name FROM documents)
SELECT doc_id, CASE WHEN least(first_sig, first_name) < doc_id THEN least(first_sig, first_name) ELSE -1 END AS duplicate_of,
  CAST(CASE WHEN first_name < doc_id AND first_name <= first_sig THEN 1.0 WHEN first_sig < doc_id THEN 0.95 WHEN first_name < doc_id THEN 1.0 ELSE 0.0 END AS DOUBLE) AS similarity FROM c""")
def duplicate_cases(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit("-"), F.floor(F.col("n_chars") / 10)).alias("file_name"), F.col("text").alias("signature"), F.col("doc_id").alias("case_ord"))
    return cases.duplicates(rows).select("doc_id", F.coalesce("duplicate_of", F.lit(-1)).cast("long").alias("duplicate_of"), "similarity")


@query("""WITH h AS (SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split('SAE-' || doc_id || '|' || source, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM documents),
l AS (SELECT d.doc_id, h.h, CASE d.doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS level FROM documents d JOIN h USING (doc_id))
SELECT doc_id, round(CASE level WHEN 'high' THEN 8.5 + 1.5 * ((h % 1000) / CAST(1000 AS DOUBLE)) WHEN 'medium' THEN 5.5 + 2.5 * ((h % 1000) / CAST(1000 AS DOUBLE)) WHEN 'low' THEN 1.5 + 3.5 * ((h % 1000) / CAST(1000 AS DOUBLE)) ELSE 2.0 END, 1) AS priority FROM l""")
def priority_score(spark, sf_dir):
    level = F.when(F.col("doc_id") % 4 == 0, "high").when(F.col("doc_id") % 4 == 1, "medium").when(F.col("doc_id") % 4 == 2, "low").otherwise("none")
    return documents(spark, sf_dir).select("doc_id", cases.priority(level, F.concat(F.lit("SAE-"), "doc_id", F.lit("|"), "source")).alias("priority"))


@query("""SELECT doc_id, doc_id % 5 = 4 OR coalesce(contains(lower(left(text, 1500)), 'with'), false) AS classified FROM documents""")
def module_gate(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("Module "), F.col("doc_id") % 5 + 1).alias("module"), F.lower(F.left("text", F.lit(1500))).contains("with").alias("sae_applicable"))
    return cases.gated(rows).select("doc_id", "classified")


@query("SELECT doc_id AS file, string_agg(left(l, 1500), '' ORDER BY i) AS sample FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE i < 2 GROUP BY 1")
def module_sample(spark, sf_dir):
    return cases.detection_sample(pages(spark, sf_dir))


# --- JSON -------------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, json_keys(CAST(props AS JSON))[1] AS first_key FROM events WHERE props IS NOT NULL AND contains(props, '{')")
def json_extract(spark, sf_dir):
    """The outer object of a model's answer, here wrapped in prose and fences, and its first key."""
    events = table(spark, sf_dir, "events").where(F.col("props").contains("{"))
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return events.select("event_id", F.get(F.json_object_keys(T.outer_json(answer)), F.lit(0)).alias("first_key"))


# --- paragraphs, reports, listings ------------------------------------------------------------------------------------------------


@query(rf"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS para FROM documents),
f AS (SELECT doc_id, para, 'EMAIL' AS entity_type, unnest(regexp_extract_all(line, '\b({_EMAIL})\b', 1)) AS v FROM p
 UNION ALL SELECT doc_id, para, 'IP_ADDRESS', unnest(regexp_extract_all(line, '\b({_IP})\b', 1)) FROM p)
SELECT doc_id, v AS original_value, entity_type, CAST(min(para) AS INTEGER) AS first_para, count(*) AS occurrences FROM f GROUP BY ALL""")
def pii_paragraph_vault(spark, sf_dir):
    """Values of documents, once each over all their paragraphs, with the paragraph in which they are first met."""
    spans = paragraphs.spans_by_paragraph(detected(spark, sf_dir, _SQL_KINDS))
    return paragraphs.vault(spans).select("doc_id", "original_value", "entity_type", "first_para", "occurrences")


@query()
def pii_paragraphs_anonymised_all(spark, sf_dir):
    return paragraphs.anonymise_paragraphs(detected(spark, sf_dir), SALT).select("doc_id", "pseudo_text", "full_text", F.size("mapping").alias("n_values"))


@query(r"""WITH m AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'txt' END AS ext FROM documents)
SELECT 'd' || doc_id || '.' || ext AS path, CASE ext WHEN 'pdf' THEN left(regexp_replace(array_to_string(string_split(text, chr(10))[1:5], chr(10)), '^\s+|\s+$', '', 'g'), 14000) WHEN 'docx' THEN left(text, 3000) END AS snippet,
 CASE ext WHEN 'txt' THEN 'unsupported_type' END AS error FROM m""")
def version_snippets(spark, sf_dir):
    none = F.lit(None).cast("string")
    ext = F.when(F.col("doc_id") % 3 == 0, "pdf").when(F.col("doc_id") % 3 == 1, "docx").otherwise("txt")
    members = documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id", F.lit("."), ext).alias("path"), F.split("text", "\n").alias("pages"), F.left("text", F.lit(3000)).alias("lead"), none.alias("read_error"), none.alias("extract_error"))
    return files.snippets(members)


@query("""SELECT source AS job_name, source || '.json' AS json_file, CASE WHEN bool_or(lang = 'en') THEN source || '.pdf' END AS pdf_file, count(*) AS asset_count, CAST(sum(n_chars) AS BIGINT) AS json_size_bytes
FROM documents WHERE source <> '' AND NOT contains(source, '/') GROUP BY source""")
def job_listing(spark, sf_dir):
    """Documents as the assets of their source, whose result holds them all; sources with English ones have a PDF."""
    docs = documents(spark, sf_dir).withColumn("size", F.col("n_chars").cast("long"))
    assets = docs.select(F.concat(F.lit("assets/"), "source", F.lit("/"), "doc_id", F.lit(".png")).alias("path"), "size")
    results = docs.groupBy("source").agg(F.sum("size").alias("size")).select(F.concat(F.lit("json/"), "source", F.lit(".json")).alias("path"), "size")
    pdfs = docs.where("lang = 'en'").select(F.concat(F.lit("pdf/"), "source", F.lit(".pdf")).alias("path"), "size")
    return files.job_listing(assets.unionByName(results).unionByName(pdfs))


@query(f"""WITH {_URLS}, f AS (SELECT DISTINCT array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') AS p FROM u)
SELECT count(*) AS files FROM f a WHERE p <> '' AND NOT EXISTS (SELECT 1 FROM f b WHERE starts_with(b.p, a.p || '/'))""")
def file_count(spark, sf_dir):
    return files.count_files(files.tree(_members(spark, sf_dir)))


@query("SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source")
def one_file_per_module(spark, sf_dir):
    return files.one_per_module(documents(spark, sf_dir).select("source", "doc_id", "text", F.col("doc_id").alias("ord")), "source").select("source", "doc_id")


@query("""SELECT lang, source, count(*) AS n, CAST(row_number() OVER (PARTITION BY lang ORDER BY CASE source WHEN 'wiki' THEN 1 WHEN 'forum' THEN 2 ELSE 3 END, source) AS INTEGER) AS place FROM documents GROUP BY lang, source""")
def section_order(spark, sf_dir):
    return paging.ordered_sections(documents(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n")), "source", ("wiki", "forum"), "lang")


@query(f"{_MATCH} SELECT module, item, CASE status WHEN 'matched' THEN 'CONSISTENT' WHEN 'needs_user_confirmation' THEN 'NEEDS_REVIEW' ELSE 'INCONSISTENT' END AS result FROM matched")
def match_results(spark, sf_dir):
    """Results of all items, by way of one nested report a module, as they are sent."""
    items = F.struct("module", "item", "status")
    nested = matched(spark, sf_dir).groupBy("module").agg(F.collect_list(items).alias("items"))
    reports = nested.select(F.create_map("module", F.struct("items")).alias("modules"))
    return matching.flattened(reports).select("module", "item", matching.result_of(F.col("status")).alias("result"))


@query("SELECT coalesce(s_suppkey, c_custkey) AS id, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name, CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE s_nationkey END AS nation FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def index_upsert(spark, sf_dir):
    """Suppliers put into an index of customers under their own keys."""
    index = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    changes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("at"))
    return matching.upsert(index, changes, "id", "at")
