"""Named queries whose dossiers, boxes and folders are made of the driver's parts, orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import consistency, entities, files, geometry, matching, paragraphs, registry
from vellum.operators import cases as case_rules
from vellum.plans import catalogue
from vellum.plans.catalogue import documents, query, table
from vellum.plans.extended import laid_out
from vellum.session import tasks

# --- fields of dossiers: three parts are the modules of one -----------------------------------------------------------------------


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.with_normal(_raw_fields(spark, sf_dir))


def _raw_fields(spark: SparkSession, sf_dir: str, others: bool = False) -> DataFrame:
    """dossier_id, module, field_number, raw: the five fields that are compared, or all ten; dealt to tasks for all cores, as their normal forms take longer than reading parts."""
    p = table(spark, sf_dir, "part").repartition(tasks(spark))
    lt = F.floor("p_retailprice") % 60
    study = F.when(F.col("p_type") == "PROMO", "Biowaiver granted").when(F.col("p_type") == "SMALL", "Not applicable").otherwise("Fasting BE study")
    form = F.when(F.col("p_size") % 4 == 0, "Film-coated tablets").when(F.col("p_size") % 4 == 1, "Hard capsule").when(F.col("p_size") % 4 == 2, "solution for injection").otherwise(F.concat("p_name", F.lit(" lozenge")))
    more = [
        F.struct(F.lit(2).alias("field_number"), F.concat(F.lit("Tab. "), "p_name", F.lit(" Hydrochloride 500 mg")).alias("raw")),
        F.struct(F.lit(3).alias("field_number"), form.alias("raw")),
        F.struct(F.lit(4).alias("field_number"), F.concat("p_name", F.lit(" Pharma Pvt Ltd")).alias("raw")),
        F.struct(F.lit(5).alias("field_number"), F.concat("p_brand", F.lit(", Pune, India")).alias("raw")),
        F.struct(F.lit(6).alias("field_number"), F.concat(F.lit("DMF "), "p_partkey", F.lit(", Basel, Germany")).alias("raw")),
    ]
    raw = F.array(
        *(more if others else []),
        F.struct(F.lit(1).alias("field_number"), F.concat("p_size", F.lit(".0 milligrams")).alias("raw")),
        F.struct(F.lit(7).alias("field_number"), F.concat(F.col("p_name"), F.lit(" disorder")).alias("raw")),
        F.struct(F.lit(8).alias("field_number"), F.concat(F.lit("Long-term "), lt, F.lit(" months")).alias("raw")),
        F.struct(F.lit(9).alias("field_number"), F.concat("p_size", F.lit(" months")).alias("raw")),
        F.struct(F.lit(10).alias("field_number"), study.alias("raw")),
    )
    module = F.when(F.col("p_partkey") % 3 == 0, "M2").when(F.col("p_partkey") % 3 == 1, "M3").otherwise("M5")
    return p.select(F.floor(F.col("p_partkey") / 3).alias("dossier_id"), module.alias("module"), F.inline(raw))


_PARTS = """WITH f AS (SELECT p_partkey // 3 AS dossier_id, CASE p_partkey % 3 WHEN 0 THEN 'M2' WHEN 1 THEN 'M3' ELSE 'M5' END AS module, p_size, CAST(floor(p_retailprice) AS BIGINT) % 60 AS lt, lower(p_name) || ' disorder' AS ind,
 CASE p_type WHEN 'PROMO' THEN 'BE-WAIVER' WHEN 'SMALL' THEN 'NO-BE' ELSE 'BE-INVIVO' END AS be FROM part)"""
_VERDICTS = _PARTS + """, c AS (SELECT dossier_id, count(DISTINCT p_size) AS sizes, count(DISTINCT lt) AS lts, bool_or(p_size > lt) AS too_long, count(DISTINCT be) AS bes, count(DISTINCT ind) AS inds,
 max(be) FILTER (module = 'M2') AS c2, max(be) FILTER (module = 'M5') AS c5 FROM f GROUP BY 1),
v AS (SELECT dossier_id, 1 AS field_number, CASE WHEN sizes > 1 THEN 'INCONSISTENT' ELSE 'CONSISTENT' END AS result FROM c
 UNION ALL SELECT dossier_id, 7, CASE WHEN inds > 1 THEN 'NEEDS_REVIEW' ELSE 'CONSISTENT' END FROM c
 UNION ALL SELECT dossier_id, 8, CASE WHEN lts > 1 THEN 'INCONSISTENT' ELSE 'CONSISTENT' END FROM c
 UNION ALL SELECT dossier_id, 9, CASE WHEN too_long OR sizes > 1 THEN 'INCONSISTENT' ELSE 'CONSISTENT' END FROM c
 UNION ALL SELECT dossier_id, 10, CASE WHEN c2 = 'BE-INVIVO' AND c5 = 'NO-BE' THEN 'INCONSISTENT' WHEN c2 = 'BE-INVIVO' AND c5 = 'BE-INVIVO' THEN 'CONSISTENT' WHEN bes > 1 THEN 'NEEDS_REVIEW' ELSE 'CONSISTENT' END FROM c)"""


@query(_PARTS + """ SELECT dossier_id, module, 1 AS field_number, p_size || ' mg' AS canonical FROM f UNION ALL SELECT dossier_id, module, 7, ind FROM f UNION ALL SELECT dossier_id, module, 8, 'LT:' || lt || '|ACC:None' FROM f
 UNION ALL SELECT dossier_id, module, 9, CAST(p_size AS VARCHAR) FROM f UNION ALL SELECT dossier_id, module, 10, be FROM f
 UNION ALL SELECT p_partkey // 3, CASE p_partkey % 3 WHEN 0 THEN 'M2' WHEN 1 THEN 'M3' ELSE 'M5' END, n, CASE n WHEN 2 THEN lower(p_name) WHEN 3 THEN CASE p_size % 4 WHEN 0 THEN 'OS-TAB' WHEN 1 THEN 'OS-CAP' WHEN 2 THEN 'PAR' ELSE lower(p_name) || ' lozenge' END
 WHEN 4 THEN lower(p_name) || ' pharma' WHEN 5 THEN replace(lower(p_brand), '#', ' ') || ' pune india' ELSE 'dmf ' || p_partkey || ' basel germany' END FROM part, unnest([2, 3, 4, 5, 6]) AS r(n)""")
def field_normal_forms(spark, sf_dir):
    """All ten fields of parts, as they are compared."""
    return consistency.with_normal(_raw_fields(spark, sf_dir, others=True)).select("dossier_id", "module", "field_number", F.col("v.canonical").alias("canonical"))


@query(_VERDICTS + " SELECT * FROM v")
def field_compare(spark, sf_dir):
    """Verdicts across the modules of each dossier, after the rules across fields."""
    rows = _fields(spark, sf_dir)
    return consistency.refined(consistency.compare(rows), rows).select("dossier_id", "field_number", "result")


@query(_VERDICTS + " SELECT dossier_id, count(*) FILTER (WHERE result = 'CONSISTENT') AS consistent, count(*) AS total FROM v GROUP BY 1")
def consistent_ratio(spark, sf_dir):
    rows = _fields(spark, sf_dir)
    return consistency.consistent_ratio(consistency.refined(consistency.compare(rows), rows), "dossier_id")


def _specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each part: its name, strength and shelf life under headings."""
    head = F.when(F.col("p_partkey") % 4 == 0, "Proposed name: ").when(F.col("p_partkey") % 4 == 1, "Contents of ").otherwise("PRODUCT NAME :")
    text = F.concat(F.lit("Table of contents\n"), head, F.lit("\nSection 1\n"), "p_name", F.lit(" made by "), "p_brand", F.lit("\nShelf life: "), "p_size", F.lit(" months\nStorage below "), F.col("p_size") % 30, F.lit(" C"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 1 THEN p_name || ' made by ' || p_brand END AS product FROM part")
def product_names(spark, sf_dir):
    """Names of products in texts made of parts, by their anchors; a heading between is passed over, and a text without an anchor names none."""
    return _specifications(spark, sf_dir).select("p_partkey", registry.product_in(F.col("text")).alias("product"))


@query("SELECT p_partkey, true AS has_shelf, p_partkey % 4 IN (2, 3) AS passed FROM part")
def headings_checked(spark, sf_dir):
    """Whether the texts of parts have the headings of a specification."""
    found = registry.headings_check(F.col("text"), {"name": r"product\s+name", "shelf": r"shelf\s+life"})
    return _specifications(spark, sf_dir).select("p_partkey", found.alias("o")).select("p_partkey", (~F.array_contains("o.missing", "shelf")).alias("has_shelf"), "o.passed")


@query("SELECT p_partkey, 9 AS field_number, CAST(p_size AS INTEGER) AS months FROM part")
def anchor_fields(spark, sf_dir):
    """Shelf lives that stand behind their anchors in texts made of parts, in months."""
    rows = _specifications(spark, sf_dir).select(F.col("p_partkey").alias("dossier_id"), F.lit("M3").alias("module"), "text")
    found = consistency.extract_fields(rows, (9,)).where("raw <> ''")
    return found.select(F.col("dossier_id").alias("p_partkey"), "field_number", consistency.months(F.col("raw")).alias("months"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' was seen.' WHEN p_size > 12 THEN 'Event: ' || p_name || '. Suspected drug: ' || p_brand || '. Patient: ' || p_size || ', F' WHEN p_size > 6 THEN p_type || ' ' || p_brand ELSE 'No narrative available.' END AS narrative FROM part""")
def case_narratives(spark, sf_dir):
    """Narratives of cases made of parts: the given one, or its parts, or the first source's snippets, or a constant."""
    p = table(spark, sf_dir, "part")
    only = lambda c, x: F.when(c, x).otherwise("")
    parts, none = F.col("p_size").between(13, 25), F.lit("")
    snippets = F.when(F.col("p_size").between(7, 12), F.array(F.concat(F.lit(" "), "p_type"), F.lit("Rule-based engine output"), F.col("p_brand"))).otherwise(F.array().cast("array<string>"))
    text = case_rules.narrative(
        only(F.col("p_size") > 25, F.concat("p_name", F.lit(" was seen."))), only(parts, F.col("p_name")), none, none, none, only(parts, F.col("p_brand")), only(parts, F.col("p_size").cast("string")), only(parts, F.lit("F")),
        [F.array(F.lit(" ")), snippets],
    )
    return p.select("p_partkey", text.alias("narrative"))


@query(f"""SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN '{case_rules.GENERIC_MESSAGE}' ELSE '{case_rules.NEW_MESSAGE}' END AS message FROM orders""")
def eligibility_messages(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority") == "2-HIGH", "Generic Drug Application").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", case_rules.eligibility_message(kind).alias("message"))


# --- folders and file names -------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'm' || left(o_orderpriority, 1) END AS module, o_orderpriority <> '4-NOT SPECIFIED' AS usable FROM orders""")
def module_detection(spark, sf_dir):
    """Modules of the paths of orders: from a folder's name, or a mark within the path; paths that lead outside are not usable."""
    n = F.left("o_orderpriority", F.lit(1))
    folder = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Module "), n)).when(F.col("o_orderstatus") == "O", F.concat(F.lit("m"), n, F.lit("_quality"))).otherwise(F.lit("misc"))
    up = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "../").otherwise("")
    path = F.concat(F.lit("dossier\\"), up, folder, F.lit("/"), "o_orderkey", F.lit(".PDF"))
    return table(spark, sf_dir, "orders").select("o_orderkey", files.module_of(path).alias("module"), files.safe(files.normalised(path)).alias("usable"))


@query("""WITH r AS (SELECT p_partkey, (p_size % 5 + 1) || '.' || (p_size % 3) AS hint, CASE WHEN p_partkey % 2 = 0 THEN (p_size % 5 + 1) || '.' || (p_size % 3) || '.P' ELSE '9.9' END AS section_id, round((p_size * 2) / 100.0, 6) AS sim FROM part)
SELECT p_partkey, CASE WHEN starts_with(section_id, hint) THEN 'filename_hint:' || hint END AS boost_applied, CASE WHEN starts_with(section_id, hint) THEN least(1.0, round(sim + 0.20, 6)) ELSE sim END AS sim FROM r""")
def hinted_similarity(spark, sf_dir):
    """Similarities lifted where a section number of the file's name agrees with the item's."""
    hint = F.concat(F.col("p_size") % 5 + 1, F.lit("."), F.col("p_size") % 3)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(hint, F.lit(" "), "p_name", F.lit(".pdf")).alias("filename"), F.when(F.col("p_partkey") % 2 == 0, F.concat(hint, F.lit(".P"))).otherwise("9.9").alias("section_id"), F.round(F.col("p_size") * 2 / 100.0, 6).cast("double").alias("sim"))
    return matching.hinted(rows).select("p_partkey", "boost_applied", F.round("sim", 6).alias("sim"))


_STRICT = (0.62, 0.10, 0.48)


@query(catalogue._MATCH.replace(f">= {catalogue.STRICT} ", f">= {_STRICT[0]} ").replace(f">= {catalogue.STRICT - catalogue.GAP} ", f">= {_STRICT[0] - _STRICT[1]} ").replace(f"sim >= {catalogue.FALLBACK} ", f"sim >= {_STRICT[2]} ") + " SELECT module, item FROM matched WHERE status = 'missing' AND applicability = 'Mandatory'")
def missing_items(spark, sf_dir):
    """Mandatory items that no document matches at the thresholds in use."""
    items = catalogue.checklist(spark, sf_dir)
    return matching.missing_mandatory(items, matching.match(items, catalogue.sims(spark, sf_dir), *_STRICT)).select("module", "item")


# --- boxes: orders are pages, their lines are blocks ------------------------------------------------------------------------------


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 12) * 4.0, (F.col("l_suppkey") % 8) * 4.0
    kind = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "R", "image").otherwise("text")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.concat(F.lit("b"), "l_linenumber").alias("block_id"), F.col("l_linenumber").alias("block_ord"), kind.alias("type"),
        x.alias("x1"), y.alias("y1"), (x + 20 + F.floor("l_quantity")).alias("x2"), (y + 20 + F.floor("l_quantity")).alias("y2"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_suppkey") % 10) * 5.0, (F.col("l_partkey") % 9) * 5.0
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), place.alias("line_ord"), x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 24).alias("y2"))


_BOXES = """WITH blocks AS (SELECT l_orderkey AS page_id, 'b' || l_linenumber AS block_id, l_linenumber AS block_ord, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'R' THEN 'image' ELSE 'text' END AS type,
 (l_partkey % 12) * 4.0::DOUBLE AS x1, (l_suppkey % 8) * 4.0::DOUBLE AS y1, (l_partkey % 12) * 4.0::DOUBLE + 20 + floor(l_quantity) AS x2, (l_suppkey % 8) * 4.0::DOUBLE + 20 + floor(l_quantity) AS y2 FROM lineitem),
lines AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line_ord, (l_suppkey % 10) * 5.0::DOUBLE AS x1, (l_partkey % 9) * 5.0::DOUBLE AS y1, (l_suppkey % 10) * 5.0::DOUBLE + 30 AS x2, (l_partkey % 9) * 5.0::DOUBLE + 24 AS y2 FROM lineitem)"""
_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREAS = "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)"


@query(_BOXES + f"""SELECT a.page_id, a.block_id AS a, b.block_id AS b, round({_INTER} / ({_AREAS} - {_INTER} + 1e-6), 6) AS iou FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.block_ord < b.block_ord""")
def box_iou(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    a = blocks.select("page_id", F.col("block_id").alias("a"), F.col("block_ord").alias("ao"), geometry.box().alias("x"))
    b = blocks.select("page_id", F.col("block_id").alias("b"), F.col("block_ord").alias("bo"), geometry.box().alias("y"))
    return a.join(b, "page_id").where("ao < bo").select("page_id", "a", "b", F.round(geometry.iou(F.col("x"), F.col("y")), 6).alias("iou"))


@query(_BOXES + f""", n AS (SELECT DISTINCT a.page_id, a.block_id FROM blocks a JOIN blocks b ON a.page_id = b.page_id AND a.type = b.type AND a.block_id <> b.block_id
 WHERE (a.x2 - a.x1) * (a.y2 - a.y1) < (b.x2 - b.x1) * (b.y2 - b.y1) AND {_INTER} / ({_AREAS} - {_INTER} + 1e-6) > 0.8)
SELECT page_id, block_id FROM blocks ANTI JOIN n USING (page_id, block_id)""")
def nested_blocks(spark, sf_dir):
    return geometry.without_nested(_blocks(spark, sf_dir)).select("page_id", "block_id")


@query(_BOXES + f""", q AS (SELECT a.page_id, a.line_ord, b.block_id, b.block_ord, {_INTER} / ({_AREAS} - {_INTER} + 1e-6) + CASE WHEN (a.x1 + a.x2) / 2 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 AND b.y2 THEN 0.5 ELSE 0 END AS score
 FROM lines a JOIN blocks b ON a.page_id = b.page_id), r AS (SELECT page_id, line_ord, arg_max(block_id, struct_pack(a := score, b := -block_ord)) AS block_id FROM q WHERE score > 0.3 GROUP BY ALL)
SELECT page_id, line_ord, r.block_id FROM lines LEFT JOIN r USING (page_id, line_ord)""")
def line_assignment(spark, sf_dir):
    return geometry.assigned(_lines(spark, sf_dir), _blocks(spark, sf_dir)).select("page_id", "line_ord", "block_id")


_SAME = "list_contains(list_transform(w.kept, lambda k: {test}), true)"
_OVER = "greatest(0, least(k.x2, a.x2) - greatest(k.x1, a.x1)) * greatest(0, least(k.y2, a.y2) - greatest(k.y1, a.y1))"
_IOU = f"{_OVER} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (a.x2 - a.x1) * (a.y2 - a.y1) - {_OVER} + 1e-6)"
_NEAR = "abs((k.x1 + k.x2) / 2 - (a.x1 + a.x2) / 2) < 5 AND abs((k.y1 + k.y2) / 2 - (a.y1 + a.y2) / 2) < 5"


@query(_BOXES.replace("WITH blocks", "WITH RECURSIVE blocks") + f""", o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_ord) AS i FROM lines),
walk AS (
  SELECT page_id, i, line_ord, true AS stays, [struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT a.page_id, a.i, a.line_ord, NOT {_SAME.format(test=f"({_IOU} > 0.5 OR ({_NEAR}))")}, CASE WHEN {_SAME.format(test=f"({_IOU} > 0.5 OR ({_NEAR}))")} THEN w.kept ELSE list_append(w.kept, struct_pack(x1 := a.x1, y1 := a.y1, x2 := a.x2, y2 := a.y2)) END
  FROM walk w JOIN o a ON a.page_id = w.page_id AND a.i = w.i + 1)
SELECT page_id, line_ord FROM walk WHERE stays""")
def line_dedup_boxes(spark, sf_dir):
    """Lines of pages of which no earlier kept line is nearly the same."""
    return geometry.deduplicated_strictly(_lines(spark, sf_dir)).select("page_id", "line_ord")


@query(_BOXES + """, o AS (SELECT page_id, block_id, CASE type WHEN 'table' THEN 0 WHEN 'image' THEN 1 ELSE 2 END AS layer, y1, x1 FROM blocks)
SELECT page_id, block_id, row_number() OVER (PARTITION BY page_id ORDER BY layer, y1, x1, block_id) AS place FROM o""")
def draw_order(spark, sf_dir):
    return geometry.draw_list(_blocks(spark, sf_dir)).select("page_id", "block_id", "place")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
p AS (SELECT doc_id, line, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS ps FROM l),
w AS (SELECT doc_id, line, len(ps) AS n, array_to_string(list_transform(ps, lambda x, i: CASE WHEN i = 1 THEN '' WHEN length(x) - length(ltrim(x, E' \t\n\x0b\x0c\r')) >= 3 THEN chr(9) ELSE ' ' END || ltrim(x, E' \t\n\x0b\x0c\r')), '') AS row_text FROM p)
SELECT doc_id, CAST(line // 40 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id, line // 40 ORDER BY line) - 1 AS INTEGER) AS row_no, row_text FROM w WHERE n > 0""")
def row_cluster(spark, sf_dir):
    """Rows of the words of laid-out documents, found by the heights of the words."""
    words = laid_out(documents(spark, sf_dir))
    rows = geometry.rows_of_words(words, doc_id="doc_id")
    return rows.select("doc_id", "page", F.col("row_no").cast("int").alias("row_no"), "row_text")


# --- tables and parts of Word files -----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_orderkey, 'body' AS part, 0 AS section, 0 AS row_no, 0 AS i FROM orders UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'table' ELSE 'header' END, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE l_linenumber END, l_linenumber, l_linenumber FROM lineitem)
SELECT o_orderkey AS file, part, row_no, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE part WHEN 'body' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, section, row_no, i) - 1 AS INTEGER) AS ord FROM p""")
def reading_order(spark, sf_dir):
    """The parts of files in reading order: an order is the body, its odd lines rows of a table, its even ones headers of sections."""
    odd = F.col("l_linenumber") % 2 == 1
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.when(odd, "table").otherwise("header").alias("part"), F.when(odd, 1).otherwise(F.col("l_linenumber")).alias("section"), F.col("l_linenumber").alias("row_no"), F.lit(0).alias("cell_no"), F.col("l_linenumber").alias("i"))
    body = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.lit("body").alias("part"), F.lit(0).alias("section"), F.lit(0).alias("row_no"), F.lit(0).alias("cell_no"), F.lit(0).alias("i"))
    return paragraphs.reading_order(body.unionByName(lines)).select("file", "part", "row_no", "ord")


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), c AS (SELECT doc_id, unnest(string_split(t, ' | ')) AS cell FROM l WHERE contains(t, ' | ')),
f AS (SELECT doc_id, 'EMAIL' AS entity_type, unnest(regexp_extract_all(cell, '\b({catalogue._EMAIL})\b', 1)) AS value FROM c UNION ALL SELECT doc_id, 'IP_ADDRESS', unnest(regexp_extract_all(cell, '\b({catalogue._IP})\b', 1)) FROM c)
SELECT doc_id, entity_type, value, count(*) AS n FROM f GROUP BY ALL""")
def table_row_values(spark, sf_dir):
    """Addresses in the cells of table rows (lines with bars), found in whole rows and mapped back to their cells' places in the text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lines = entities.paragraph_offsets(docs).where(F.col("paragraph").contains(" | ")).select("doc_id", F.col("para").alias("row_no"), "p_start", F.split("paragraph", r" \| ").alias("cs"))
    starts = lambda i: F.aggregate(F.slice("cs", F.lit(1), i), F.lit(0), lambda a, c: a + F.length(c) + 3)
    cells = F.transform("cs", lambda c, i: F.struct(i.alias("cell_id"), F.array(F.struct((F.col("p_start") + starts(i)).alias("start"), c.alias("text"))).alias("paragraphs")))
    rows = lines.select("doc_id", "row_no", F.inline(F.array(F.struct(cells.alias("cells")))))
    none = docs.limit(0).select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"))
    found = paragraphs.row_spans(rows, none, kinds=("EMAIL", "IP_ADDRESS"))
    placed = found.join(docs.withColumnRenamed("text", "body"), "doc_id")
    right = F.substring("body", F.col("start") + 1, F.length("text")) == F.col("text")
    return placed.where(right).groupBy("doc_id", "entity_type", F.col("text").alias("value")).agg(F.count("*").alias("n"))
