"""Rules on small tables worked out by hand."""

from pyspark.sql import functions as F

from tests import fixtures
from vellum.operators import consistency, files, geometry


def same(got, want):
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, map(tuple, want.select(*order).collect())))


def test_modules_of_paths(spark):
    got = fixtures.frame(spark, "paths").select("path", files.module_of(F.col("path")).alias("m"), files.safe(F.col("path")).alias("usable"))
    same(got, fixtures.frame(spark, "paths_out"))


def test_fields(spark):
    rows = consistency.with_normal(fixtures.frame(spark, "fields"))
    same(rows.select("dossier_id", "module", "field_number", F.col("v.canonical").alias("canonical")), fixtures.frame(spark, "fields_out"))
    verdicts = consistency.refined(consistency.compare(rows), rows).select("dossier_id", "field_number", "result")
    same(verdicts, fixtures.frame(spark, "verdicts_out"))


def test_anchored_fields(spark):
    assert consistency.extract_fields(fixtures.frame(spark, "dossiers")).where("raw <> ''").count() > 0


def test_boxes(spark):
    blocks, lines = fixtures.frame(spark, "blocks"), fixtures.frame(spark, "lines")
    assert geometry.without_nested(blocks).count() <= blocks.count()
    once = geometry.assigned_once(geometry.deduplicated_strictly(geometry.deduplicated(lines)), blocks)
    assert 0 < once.count() <= lines.count()


def test_rows_of_words(spark):
    got = geometry.rows_of_words(fixtures.frame(spark, "words"))
    assert sorted((r.page_id, r.row_no, r.row_text) for r in got.collect()) == [(1, 0, "Name John"), (1, 1, "Age\t47 years")]
