"""Archives read by members and written as streams."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.sources import archives


def make(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in members:
            z.writestr(name, content)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    blob = lambda n: bytes(rng.getrandbits(8) for _ in range(n))
    members = [(f"m1/f{i}.bin", blob(3000)) for i in range(40)] + [("m1/", b""), ("__MACOSX/x", b"x"), ("/abs", b"x"), ("a/../b", b"x"), ("back\\slash.txt", b"text"), ("empty.txt", b"")]
    make(tmp_path / "large.zip", members)
    make(tmp_path / "stored.zip", [("s.txt", b"stored " * 2000), ("é.txt", "é".encode())], zipfile.ZIP_STORED)
    (tmp_path / "broken.zip").write_bytes(b"PK no archive" * 1000)
    return tmp_path


def rows(df):
    return sorted(((os.path.basename(r.archive), r.member, None if r.content is None else bytes(r.content), r.error) for r in df.collect()), key=repr)


def test_members_by_stretches_equal_whole_reading(spark, folder):
    whole = rows(archives.read(spark, str(folder), large_bytes=1 << 40))
    split = rows(archives.read(spark, str(folder), large_bytes=1, split_bytes=10_000))
    assert [r for r in whole if r[3] is None] == [r for r in split if r[3] is None]
    assert [(r[0], r[1]) for r in whole if r[3]] == [(r[0], r[1]) for r in split if r[3]] == [("broken.zip", None)]
    large = archives.read_large(spark, [f"file:{folder}/large.zip"], split_bytes=10_000)
    assert large.select(F.spark_partition_id()).distinct().count() > 5  # one archive by several tasks


def test_limits_and_damage(spark, folder):
    path = str(folder / "large.zip")
    assert [r[3] for r in rows(archives.read_large(spark, [path], most_bytes=100))] == ["ValueError: archive is too large"]
    assert {r[3] for r in rows(archives.read_large(spark, [path], most_member_bytes=100)) if r[1].startswith("m1/f")} == {"ValueError: member is too large"}
    raw = bytearray((folder / "stored.zip").read_bytes())
    at = raw.find(b"stored stored")
    raw[at] ^= 1
    (folder / "damaged.zip").write_bytes(raw)
    got = rows(archives.read_large(spark, [str(folder / "damaged.zip")]))
    assert {(r[1], r[3]) for r in got} == {("s.txt", "ValueError: member is damaged"), ("é.txt", None)}
    assert rows(archives.read_large(spark, [str(folder / "missing.zip")]))[0][3].startswith("FileNotFoundError")
    assert archives.read_large(spark, []).count() == 0


def test_save_and_read_again(spark, tmp_path):
    given = [(f"g{i % 3}/all.zip", f"d{i}.txt", f"text {i} é".encode()) for i in range(60)] + [("g0/all.zip", "none.txt", None), ("lone.zip", "x", b"")]
    df = spark.createDataFrame(given, "archive string, member string, content binary").repartition(7)
    archives.save(df, f"file://{tmp_path}/out")
    files = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, fs in os.walk(tmp_path / "out") for f in fs)
    assert files == ["g0/all.zip", "g1/all.zip", "g2/all.zip", "lone.zip"]
    for name in files:
        with zipfile.ZipFile(tmp_path / "out" / name) as z:
            assert z.testzip() is None
            assert [(m, z.read(m)) for m in z.namelist()] == sorted((m, c) for a, m, c in given if a == name and c is not None)
    archives.save(df.limit(0), f"file://{tmp_path}/out")  # nothing to write


def test_failures_leave_no_file(spark, tmp_path):
    @F.udf("binary")
    def bad(i):
        if i == 57:
            raise ValueError("no content")
        return str(i).encode()

    df = spark.range(60).select(F.lit("one.zip").alias("archive"), F.col("id").cast("string").alias("member"), bad("id").alias("content"))
    with pytest.raises(Exception):
        archives.save(df, f"{tmp_path}/out")
    for bad_name in ("../out.zip", "/abs.zip", None):
        rows_ = spark.createDataFrame([(bad_name, "a", b"a"), ("ok.zip", "a", b"a")], "archive string, member string, content binary")
        with pytest.raises(Exception):
            archives.save(rows_, f"{tmp_path}/out")
    left = [f for _, _, fs in os.walk(tmp_path) for f in fs]
    assert left == []


def test_rows_of_an_archive_must_follow_each_other(spark, tmp_path):
    archives.register(spark)
    df = spark.createDataFrame([("a.zip", "1", b"1"), ("b.zip", "1", b"1"), ("a.zip", "2", b"2")], "archive string, member string, content binary").coalesce(1)
    with pytest.raises(Exception):
        df.write.format("zip").option("path", f"{tmp_path}/out").mode("append").save()
    two = spark.createDataFrame([("a.zip", "1", b"1"), ("a.zip", "2", b"2")], "archive string, member string, content binary").repartition(2, "member")
    if two.select(F.spark_partition_id()).distinct().count() == 2:
        with pytest.raises(Exception):
            two.write.format("zip").option("path", f"{tmp_path}/out").mode("append").save()
    assert [f for _, _, fs in os.walk(tmp_path) for f in fs] == []


def test_a_member_of_an_archive_in_memory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"abc")
    with zipfile.ZipFile(out) as z:
        i = z.infolist()[0]
    assert archives.content_of(out, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.flag_bits, i.CRC) == b"abc"
    with pytest.raises(ValueError):
        archives.content_of(out, 5, 3, 3, 0, 0, 0)
    with pytest.raises(ValueError):
        archives.content_of(out, i.header_offset, 3, 3, 0, 1, i.CRC)
