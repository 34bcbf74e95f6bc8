"""Operator 6: line dedup with overlapping three-line windows, DataFrame functions only.

Every run of three consecutive lines of a document is hashed (to 128 bits).  A
window that occurs more than once in the corpus stays where it occurs first, by
document id and then by line; each later occurrence covers its three lines, and
the covered lines of a document, merged over all its windows, are removed.

A run of one or two lines of over ``LONG`` words is a window as well, in every
document, so a long passage is found between differing neighbours.  Apart from
that, a document of one or two lines has one window, of all its lines, that
meets only windows of as many lines.  With ``long=None`` only the former count.
The SQL below states the whole rule.  Lines are compared without the blanks at their
ends; what stays keeps them.

A frequent passage is counted with partial sums before the shuffle, and the
windows then meet the table of repeated hashes in a join that Spark can split
where one hash has many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fresh, n_words, saved

WINDOW = 3
#: A run of fewer lines is a window of its own if it has more words than this.
LONG = 50


def windows(text: Column, size: int = WINDOW, long: int | None = LONG) -> Column:
    """Array of structs (pos, n, h1, h2): first line from 0, number of lines, hash of the window's lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x))  # F.btrim itself would take the index as what to trim
    words = n_words if long is not None else lambda x: F.lit(0).cast("long")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), words(x).alias("w")))
    span = lambda h: F.least(F.size(h), F.lit(size))
    one = lambda h, i, n: F.struct(i.alias("pos"), n.alias("n"), F.xxhash64(F.slice(h["a"], i + 1, n)).alias("h1"), F.xxhash64(F.slice(h["b"], i + 1, n)).alias("h2"))
    runs = lambda h, n: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: one(h, i, n))

    def short(h: Column, n: int) -> Column:
        total = lambda i: sum((F.get(h["w"], i + k) for k in range(1, n)), F.get(h["w"], i))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: total(i) > long)
        return F.when(F.size(h) > n, F.transform(starts, lambda i: one(h, i, F.lit(n)))).otherwise(F.slice(runs(h, span(h)), 1, 0))

    every = lambda h: runs(h, span(h)) if long is None else F.concat(runs(h, span(h)), *[short(h, n) for n in range(1, size)])
    return F.transform(F.array(hashed), every)[0]


def later_windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, long: int | None = LONG) -> DataFrame:
    """Windows that occur earlier in the corpus: doc_id, pos, n."""
    found = df.where(F.col(f"`{text}`").isNotNull() & (F.col(f"`{text}`") != "")).select(F.col(f"`{doc_id}`").alias("doc_id"), F.inline(windows(F.col(f"`{text}`"), size, long)))
    found = saved(found, "line-windows")  # read twice: hashing the lines again would cost more
    first = F.min(F.struct("doc_id", "pos"))
    repeated = found.groupBy("n", "h1", "h2").agg(F.count("*").alias("times"), first.alias("first")).where("times > 1").drop("times")
    repeated = saved(repeated, "repeated-windows")
    return found.join(repeated, ["n", "h1", "h2"]).where(F.struct("doc_id", "pos") > F.col("first")).select("doc_id", "pos", "n")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "removed_lines", size: int = WINDOW, long: int | None = LONG) -> DataFrame:
    """df with repeated passages removed from the text, and the number of lines removed from each row.

    No row is dropped: a document of which nothing is left has an empty text.
    Null and empty texts stay as they are.  Rows with the same doc_id count as
    one document: windows at the same line of them are one occurrence, and what
    is removed from one is removed from all.  A null id comes before all others.
    A column of df named as removed is replaced.
    """
    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() != removed.lower()])
    positions, key = fresh(kept.columns, "covered"), fresh(kept.columns, "covered_id")
    later = later_windows(kept, doc_id, text, size, long)
    covered = later.select("doc_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("line"))
    covered = covered.groupBy("doc_id").agg(F.collect_set("line").alias(positions)).withColumnRenamed("doc_id", key)
    rows = kept.join(covered, F.col(f"`{doc_id}`").eqNullSafe(F.col(key)), "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    # The difference is taken by hashing, so a text costs its lines and those covered, not their product.
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(positions))
    left = F.transform(F.array(lines), lambda x: F.transform(stay(x), lambda i: F.get(x, i)))[0]
    hit = F.col(positions).isNotNull() & F.col(f"`{text}`").isNotNull() & (F.col(f"`{text}`") != "")
    n = F.size(F.filter(F.col(positions), lambda i: i < F.size(lines)))
    new_text, new_n = fresh(kept.columns, "left_text"), fresh(kept.columns, "left_out")
    # Names inside lambdas must not meet an alias of the same select: results get their names in a second one.
    rows = rows.select(*[f"`{c}`" for c in kept.columns], F.when(hit, F.array_join(left, "\n")).otherwise(F.col(f"`{text}`")).alias(new_text), F.when(hit, n).otherwise(F.lit(0)).cast("int").alias(new_n))
    return rows.select(*[F.col(new_text).alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in kept.columns], F.col(new_n).alias(removed))



ORACLE = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> ''
), trimmed AS (
  SELECT doc_id, list_transform(ls, lambda x: trim(x, ' ')) AS ts, list_transform(ls, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS ns, least(len(ls), 3) AS whole FROM lines
), spans AS (
  SELECT doc_id, ts, ns, whole, n, unnest(range(len(ts) - n + 1)) AS pos FROM (SELECT *, unnest(range(1, whole + 1)) AS n FROM trimmed)
), win AS (
  SELECT doc_id, pos, n, ts[pos + 1 : pos + n] AS w FROM spans WHERE n = whole OR list_sum(ns[pos + 1 : pos + n]) > 50
), rep AS (
  SELECT n, w, min(struct_pack(d := doc_id, p := pos)) AS f FROM win GROUP BY n, w HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + win.n)) AS line
  FROM win JOIN rep ON win.n = rep.n AND win.w = rep.w
  WHERE struct_pack(d := doc_id, p := pos) > f
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM lines) l
  LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.line = l.i
  WHERE c.line IS NULL GROUP BY l.doc_id
), n AS (SELECT doc_id, count(*) AS removed FROM covered GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN d.text ELSE coalesce(k.text, '') END AS text, CAST(coalesce(n.removed, 0) AS INTEGER) AS removed_lines
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
