"""More named queries over the driver tables: recognisers, provenance in Word files, archives, boxes, batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import cases, consistency, entities, files, geometry, matching, models, paging, paragraphs, provenance, recogniser, registry
from vellum.plans import catalogue
from vellum.plans.catalogue import documents, query, table
from vellum.session import scratch, tasks
from vellum.sources import archives
from vellum.sources import files as sources

# --- a tagger's windows -----------------------------------------------------------------------------------------------------------


def _by_rule(words: pa.ListArray) -> pa.ListArray:
    """Words with a capital are persons or places by their length, numbers organisations; scores by length."""
    flat = words.flatten()
    _, offsets, data = flat.buffers()
    begin = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1]
    n = pc.utf8_length(flat).to_numpy()
    first = np.append(np.frombuffer(data or b"", np.uint8), np.uint8(0))[begin[:-1]]
    mark = (n == 1) & np.isin(first, np.frombuffer(b".@-", np.uint8))
    capital, digit = (first >= 65) & (first <= 90), (first >= 48) & (first <= 57)
    which = np.select([capital & (n % 3 == 0), capital & (n % 3 == 1), capital, digit, mark], range(5), 5).astype(np.int8)
    label = pa.DictionaryArray.from_arrays(pa.array(which), pa.array(["B-PER", "I-LOC", "E-PER", "ORG", "I-ORG", "O"]))
    tags = pa.StructArray.from_arrays([label, pa.array(np.where(mark, 0.8, 0.7 + n / 50.0))], ["label", "score"])
    upto = words.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(upto - upto[0]), tags)


_stand_in = recogniser.InArrow(_by_rule)


@query(r"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*(?:[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D])') AS ps FROM documents),
t AS (SELECT doc_id, i, ps[i] AS raw, ltrim(ps[i], E' \t\n\x0b\x0c\r') AS w, len(ps) AS n, CAST(sum(length(ps[i])) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM p, unnest(range(1, len(ps) + 1)) AS r(i)),
m AS (SELECT *, unnest(range(greatest(0, CAST(ceil((i - 510) / 446.0) AS BIGINT)), least((i - 1) // 446, greatest(0, CAST(ceil((n - 510) / 446.0) AS BIGINT))) + 1)) AS win FROM t),
g AS (SELECT *, e - length(w) AS s, CASE WHEN w IN ('.', '@', '-') THEN 0.8 ELSE 0.7 + length(w) / 50.0 END AS score,
  CASE WHEN regexp_matches(w, '^[A-Z]') THEN CASE length(w) % 3 WHEN 1 THEN 'LOCATION' ELSE 'PERSON' END WHEN regexp_matches(w, '^[0-9]') OR w IN ('.', '@', '-') THEN 'ORGANISATION' END AS kind0 FROM m),
k AS (SELECT *, CASE WHEN score >= 0.75 THEN kind0 END AS kind FROM g),
b AS (SELECT *, CASE WHEN kind = lag(kind) OVER o AND s <= lag(e) OVER o THEN 0 ELSE 1 END AS fresh FROM k WINDOW o AS (PARTITION BY doc_id, win ORDER BY i)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, win ORDER BY i) AS run FROM b),
z AS (SELECT doc_id, win, kind, min(s) AS "start", max(e) AS "end", round(min(score), 4) AS score FROM r WHERE kind IS NOT NULL GROUP BY doc_id, win, kind, run)
SELECT z.doc_id, CAST(z.win AS INTEGER) AS win, kind AS entity_type, substring(d.text, "start" + 1, "end" - "start") AS value, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", score
FROM z JOIN documents d USING (doc_id) WHERE "end" - "start" >= 2 AND lower(substring(d.text, "start" + 1, "end" - "start")) NOT IN ({spurious})""".replace("{spurious}", ", ".join(f"'{w}'" for w in recogniser.P.RECOGNISER_SPURIOUS)))
def recogniser_spans(spark, sf_dir):
    """What a tagger by rule finds in windows of 512 tokens, touching tokens joined; common parts of windows give the same span twice."""
    return recogniser.window_spans(documents(spark, sf_dir), _stand_in)


@query()
def pii_fused_recognised(spark, sf_dir):
    """Definitions and a tagger by rule, fused; tested against plain loops."""
    return recogniser.entity_rows(documents(spark, sf_dir), _stand_in, kinds=("EMAIL", "IP_ADDRESS"))


# --- archives ---------------------------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(source, 'none') || '.zip' AS archive, 'docs/' || doc_id || '.txt' AS member, strlen(text) AS n_bytes, md5(text) AS content_md5, doc_id FROM documents WHERE text IS NOT NULL""")
def archive_round_trip(spark, sf_dir):
    """All documents as members of an archive for each source, written as streams and read again by stretches of each archive."""
    folder = scratch(spark, "archives")
    docs = documents(spark, sf_dir).select(F.concat(F.coalesce("source", F.lit("none")), F.lit(".zip")).alias("archive"), F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("member"), F.col("text").cast("binary").alias("content"))
    archives.save(docs, folder)
    rows = archives.read(spark, folder, large_bytes=1 << 20, split_bytes=1 << 20)
    name = F.regexp_extract("archive", "[^/]*$", 0)
    return rows.select(name.alias("archive"), "member", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("content_md5"), F.regexp_extract("member", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"))


# --- snippets in Word files -------------------------------------------------------------------------------------------------------


@query(r"""WITH b AS (SELECT item_id, trim(lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))) AS needle FROM benchmark),
k AS (SELECT *, array_to_string(string_split(needle, ' ')[1:4], ' ') AS head FROM b WHERE needle <> ''),
d AS (SELECT doc_id, replace(text, chr(10), '') AS text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, trim(lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))) AS form FROM d),
p AS (SELECT doc_id, item_id, needle, form, text, ls, item_id % 4 + 1 AS page, strpos(form, needle) AS hit FROM f JOIN k ON contains(form, head)),
h AS (SELECT *, length(replace(left(form, CAST(hit AS BIGINT) - 1), ' ', '')) AS a, length(replace(needle, ' ', '')) AS n FROM p),
r AS (SELECT *, regexp_replace(text, '[a-zA-Z0-9]', chr(1), 'g') AS marks FROM h),
s AS (SELECT doc_id, item_id, hit, page, ls, CASE WHEN hit > 0 THEN list_sum(list_transform(string_split(marks, chr(1))[1:a + 1], lambda x: length(x))) + a END AS st, CASE WHEN hit > 0 THEN list_sum(list_transform(string_split(marks, chr(1))[1:a + n], lambda x: length(x))) + a + n END AS en FROM r),
o AS (SELECT *, list_transform(range(0, len(ls)), lambda i: CAST(coalesce(list_sum(list_transform(ls[1:i + 1], lambda x: length(x))), 0) AS BIGINT)) AS ends FROM s)
SELECT doc_id, item_id AS snippet_id, CASE WHEN hit > 0 THEN 'document' WHEN len(ls) > (page - 1) * 20 THEN 'page' ELSE 'none' END AS stage, CAST(st AS INTEGER) AS "start", CAST(en AS INTEGER) AS "end",
 CAST(CASE WHEN hit > 0 THEN len(list_filter(ends, lambda e: e <= st)) WHEN len(ls) > (page - 1) * 20 THEN (page - 1) * 20 END AS INTEGER) AS block FROM o""")
def docx_provenance(spark, sf_dir):
    """Benchmark items in documents that hold their first four words: where the whole item stands in the original text, else the page that it names.

    A document's lines are the blocks of a Word file, twenty to a page.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", provenance.alnum_form(F.col("text")).alias("needle")).where("needle <> ''")
    docs = documents(spark, sf_dir).select("doc_id", "text").where(F.col("text").isNotNull())
    heads = items.select("item_id", F.array_join(F.slice(F.split("needle", " "), 1, 4), " ").alias("text"))
    pairs = provenance.located(heads, docs.select("doc_id", provenance.alnum_form(F.translate("text", "\n", "")).alias("text")))
    snippets = pairs.join(items, "item_id").select("doc_id", F.col("item_id").alias("snippet_id"), F.col("text").alias("snippet"), (F.col("item_id") % 4 + 1).alias("page"))
    blocks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text")).select("doc_id", "block", (F.floor(F.col("block") / 20) + 1).alias("page"), "text")
    return provenance.in_word_files(snippets, blocks)


# --- boxes of spans ---------------------------------------------------------------------------------------------------------------


def laid_out(docs: DataFrame) -> DataFrame:
    """Documents as words on pages: 40 lines to a page, 14 units high each, and 6 units for a character.

    Texts are dealt to tasks by their ids before they become words, so that words are shuffled only once behind Python.
    """
    docs = docs.select("doc_id", "text").repartition(tasks(docs.sparkSession), "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    pieces = lines.select("doc_id", "line", F.regexp_extract_all("t", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)).alias("ps"))
    words = pieces.select("doc_id", "line", F.posexplode("ps").alias("i", "p"))
    end = F.sum(F.length("p")).over(Window.partitionBy("doc_id", "line").orderBy("i"))
    words = words.select("doc_id", "line", F.ltrim("p", F.lit(" \t\n\x0b\f\r")).alias("text"), end.alias("e"))
    y = (F.col("line") % 40) * 14.0
    return words.select("doc_id", F.floor(F.col("line") / 40).cast("int").alias("page"), ((F.col("e") - F.length("text")) * 6.0).alias("x0"), y.alias("y0"), (F.col("e") * 6.0).alias("x1"), (y + 10.0).alias("y1"), "text")


_EMAIL, _IP = r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
p AS (SELECT doc_id, line, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS ps FROM l),
w AS (SELECT doc_id, line, ltrim(ps[i], E' \t\n\x0b\x0c\r') AS text, CAST(sum(length(ps[i])) OVER (PARTITION BY doc_id, line ORDER BY i) AS BIGINT) AS e FROM p, unnest(range(1, len(ps) + 1)) AS r(i)),
f AS (SELECT *, 'EMAIL' AS entity_type, unnest(regexp_extract_all(text, '\b({_EMAIL})\b', 1)) AS value FROM w UNION ALL SELECT *, 'IP_ADDRESS', unnest(regexp_extract_all(text, '\b({_IP})\b', 1)) FROM w)
SELECT doc_id, entity_type, value, CAST(line // 40 AS INTEGER) AS page, (e - length(text)) * 6.0::DOUBLE AS x0, (line % 40) * 14.0::DOUBLE AS y0, e * 6.0::DOUBLE AS x1, (line % 40) * 14.0::DOUBLE + 10 AS y1 FROM f""")
def span_boxes(spark, sf_dir):
    """Addresses in the text that the words of laid-out documents give, with the boxes to cover on each page."""
    docs, path = documents(spark, sf_dir), scratch(spark, "spans")
    words = geometry.placed_words(laid_out(docs))
    entities.exploded(entities.detect(geometry.stream_of(words), kinds=("EMAIL", "IP_ADDRESS"))).write.parquet(path)
    spans = spark.read.parquet(path)
    some = docs.join(spans.select(F.col("doc_id").alias("_d")).distinct(), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    boxes = entities.words_under_spans(geometry.placed_words(laid_out(some)), spans)
    return spans.join(boxes, ["doc_id", "start", "end"]).select("doc_id", "entity_type", F.col("text").alias("value"), "page", "x0", "y0", "x1", "y1")


# --- model calls and batches ------------------------------------------------------------------------------------------------------


def _reply(prompt: str) -> str:
    """Stands in for a model: the role and length of a turn as JSON, prose for short ones, an error for those that begin with T."""
    if prompt.startswith("T"):
        raise RuntimeError("refused")
    if len(prompt) % 7 == 0:
        return f"I have {len(prompt)} characters."
    return f'Here it is: {{"length": {len(prompt)}}}'


_REPLIES = """WITH t AS (SELECT conv_id, turn, text, CASE WHEN starts_with(text, 'T') THEN 'RuntimeError: refused' END AS failure, length(text) AS n FROM conversations WHERE text IS NOT NULL)"""


@query(_REPLIES + """ SELECT conv_id, turn, failure, CASE WHEN failure IS NULL AND n % 7 <> 0 THEN n END AS length, CASE WHEN failure IS NULL AND n % 7 = 0 THEN 'Failed to parse JSON' END AS error,
 CASE WHEN failure IS NULL AND n % 7 = 0 THEN 'I have ' || n || ' characters.' END AS raw_response FROM t""")
def model_answers(spark, sf_dir):
    """A stand-in's answers to all turns: errors and prose become rows, JSON becomes values."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").where(F.col("text").isNotNull())
    rows = models.called(turns, "text", _reply, "answer", "failure").withColumn("j", models.json_answer(F.col("answer")))
    return rows.select("conv_id", "turn", "failure", F.try_variant_get(F.col("j.value"), "$.length", "bigint").alias("length"), "j.error", "j.raw_response")


@query(_REPLIES + """ SELECT conv_id, turn, CASE WHEN failure IS NULL AND n % 7 <> 0 THEN 'answered' ELSE 'Error generating overall summary.' END AS value, CASE WHEN failure IS NULL AND n % 7 <> 0 THEN 'high' ELSE 'low' END AS confidence FROM t""")
def overall_summaries(spark, sf_dir):
    """Overall summaries of all turns, with the fixed value where the call failed."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").where(F.col("text").isNotNull())
    rows = models.called(turns, "text", _reply)
    said = F.when(F.col("answer").contains("{"), F.lit('{"value": "answered", "confidence": "high", "source": []}')).otherwise(F.col("answer"))
    return rows.select("conv_id", "turn", models.overall_summary(said, F.col("error")).alias("s")).select("conv_id", "turn", "s.value", "s.confidence")


@query("""WITH p AS (SELECT page_id, url, html, coalesce(ends_with(lower(url), '.html'), false) AS taken FROM pages)
SELECT page_id, NOT taken AS skipped, CASE WHEN taken AND NOT contains(lower(html), '</html>') THEN 'ValueError: page is cut off' END AS error, CASE WHEN taken AND contains(lower(html), '</html>') THEN length(html) END AS size FROM p""")
def page_batch(spark, sf_dir):
    """A batch of pages that goes on after failures: those with another ending are skipped, and cut-off ones are errors."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows, _ = models.batch(pages, "url", lambda f: models.called(f, "html", _size_of_page), ".html")
    return rows.select("page_id", "skipped", "error", F.col("answer").cast("bigint").alias("size"))


def _size_of_page(html: str) -> str:
    if "</html>" not in html.lower():
        raise ValueError("page is cut off")
    return str(len(html))


@query("""WITH o AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE lang <> 'de'), n AS (SELECT doc_id, sha256(CASE WHEN contains(text, '@') THEN 'new ' || text ELSE text END) AS d FROM documents WHERE lang <> 'fr')
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'gone' WHEN o.doc_id IS NULL THEN 'new' WHEN n.d = o.d THEN 'same' ELSE 'changed' END AS status FROM n FULL JOIN o ON n.doc_id = o.doc_id""")
def index_changes(spark, sf_dir):
    """What an index of documents lacks after some came, went and changed (those with an at sign)."""
    docs = documents(spark, sf_dir)
    index = docs.where("lang <> 'de'").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit("m").alias("model"))
    now = docs.where("lang <> 'fr'").select("doc_id", F.when(F.col("text").contains("@"), F.concat(F.lit("new "), "text")).otherwise(F.col("text")).alias("content"))
    return models.changes(now.withColumnRenamed("doc_id", "key"), index.withColumnRenamed("doc_id", "key"), "m").select(F.col("key").alias("doc_id"), "status")


@query("""SELECT event_id, CASE WHEN value > 50 THEN NULL ELSE value END AS value, list_transform([value, value / 2], lambda v: CASE WHEN v > 50 THEN NULL ELSE v END) AS pair, base64(encode(event_type)) AS raw, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM events""")
def json_safe_events(spark, sf_dir):
    """Events as JSON can hold them: infinite values (those above 50), also in arrays, as null, bytes as Base64, times as text."""
    big = lambda v: F.when(v > 50, F.lit(float("inf"))).otherwise(v)
    rows = table(spark, sf_dir, "events").select("event_id", big(F.col("value")).alias("value"), F.array(big(F.col("value")), big(F.col("value") / 2)).alias("pair"), F.col("event_type").cast("binary").alias("raw"), "ts")
    return models.json_safe(rows)


# --- folders, exports, reading ----------------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT DISTINCT o_custkey AS dossier, CASE o_orderstatus WHEN 'F' THEN 'Module ' || o_orderpriority WHEN 'O' THEN 'm' || left(o_orderpriority, 1) || '_' || lower(o_orderstatus) ELSE 'part ' || o_orderpriority END AS name FROM orders),
k AS (SELECT dossier, name, 'm' || regexp_extract(lower(name), '^(?:m|module )([1-5])', 1) AS module FROM p WHERE regexp_matches(lower(name), '^(?:m|module )[1-5]'))
SELECT dossier, module, 'dossier/' || max(name) AS folder FROM k GROUP BY ALL""")
def module_folders_found(spark, sf_dir):
    """Orders as files of customers' dossiers, in folders named by priority and status: the folder of each module, the later name where two give one."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Module "), "o_orderpriority")).when(F.col("o_orderstatus") == "O", F.concat(F.lit("m"), F.left("o_orderpriority", F.lit(1)), F.lit("_"), F.lower("o_orderstatus"))).otherwise(F.concat(F.lit("part "), "o_orderpriority"))
    members = o.select(F.col("o_custkey").alias("dossier"), F.concat(F.lit("dossier/"), name, F.lit("/"), "o_orderkey", F.lit(".pdf")).alias("path"))
    return files.detected_modules(members)


@query("SELECT url AS name, CAST(row_number() OVER (ORDER BY url DESC, page_id) AS BIGINT) AS place FROM pages WHERE ends_with(url, '.html') QUALIFY place <= 20")
def newest_exports(spark, sf_dir):
    """The twenty last names of pages."""
    names = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), "page_id")
    return sources.newest_first(names, ".html").limit(20).select("name", F.row_number().over(Window.orderBy(F.desc("name"), "page_id")).cast("long").alias("place"))


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), c AS (SELECT *, list_transform(range(0, len(ls)), lambda i: CAST(coalesce(list_sum(list_transform(ls[1:i], lambda x: length(x))), 0) AS BIGINT)) AS before FROM p),
n AS (SELECT doc_id, ls, least(80, len(list_filter(before, lambda b: b < 4000))) AS k FROM c)
SELECT CAST(doc_id AS VARCHAR) AS path, k AS n_pages, md5(left(array_to_string(ls[1:k], chr(10)), 4000)) AS text_md5 FROM n""")
def capped_reading(spark, sf_dir):
    """Texts read page by page (a line each), no further than 80 pages or 4,000 characters."""
    docs = documents(spark, sf_dir).where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    rows = sources.pdf_texts(docs, _lines, most_chars=4000)
    return rows.select("path", F.col("n_pages").cast("long").alias("n_pages"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _lines(content: bytes):
    yield from content.decode().split("\n")


@query(catalogue._MATCH + " SELECT module, item, applicability, status FROM matched")
def completeness_projection(spark, sf_dir):
    """What the user interface is sent of the matching: module, item, applicability and status."""
    found = catalogue.matched(spark, sf_dir).drop("applicability").join(catalogue.checklist(spark, sf_dir), ["module", "item"])
    return found.select("module", "item", "applicability", "status")
