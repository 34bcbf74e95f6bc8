"""Paths and archives: modules, trees, versions, order and names of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.registry import containing
from vellum.session import scratch


def normalised(path: Column) -> Column:
    return F.btrim(F.replace(path, F.lit("\\"), F.lit("/")))


def safe(path: Column) -> Column:
    """Whether an archive member may be used: a relative path without ``..`` that is no folder and none of the packer's own."""
    p = normalised(path)
    parts = F.split(p, "/")
    return (p != "") & ~p.startswith("/") & ~p.endswith("/") & ~p.rlike("^[A-Za-z]:") & ~F.array_contains(parts, "..") & ~F.array_contains(parts, "__MACOSX")


def basename(path: Column) -> Column:
    return F.element_at(F.split(normalised(path), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(basename(name), r"\.[^.]+$", "")


def joined(*parts: Column) -> Column:
    """Parts of a storage path that aren't empty, without slashes at their ends."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda x: F.btrim(x, F.lit("/"))), lambda x: x.isNotNull() & (x != "")), "/")


def module_of(path: Column) -> Column:
    """m1 to m5 of an archive path: by a segment's name, else by the lowest mark within the path; or null."""
    low = F.lower(normalised(path))
    number = lambda s: F.coalesce(F.nullif(F.regexp_extract(s, r"^m([1-5])$", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"^module\s*([1-5])$", 1), F.lit("")))
    named = F.get(F.filter(F.transform(F.split(low, "/"), number), lambda x: x.isNotNull()), F.lit(0))
    marked = F.coalesce(*[F.when(low.rlike(rf"(^|/)m{i}(?=/|_|\.|$)"), F.lit(str(i))) for i in range(1, 6)])
    return F.concat(F.lit("m"), F.coalesce(named, marked))


def module_of_folder(name: Column) -> Column:
    """A module's key from a folder's name, or null."""
    low = F.lower(F.btrim(name))
    part = lambda p, g: F.nullif(F.regexp_extract(low, p, g), F.lit(""))
    return F.concat(F.lit("m"), F.coalesce(part(r"^m(\d+)$", 1), part(r"(?:^|[^a-z0-9])m(\d+)(?:[^a-z0-9]|$)", 1), part(r"module[\s_-]*(\d+)", 1)))


def module_folders(folders: DataFrame, keys: tuple[str, ...] = ("m1", "m2", "m3", "m4", "m5"), first_wins: bool = False) -> DataFrame:
    """One folder for each module of folders (folder, ord): the last that has its key, or the first."""
    rows = folders.withColumn("module", module_of_folder(F.col("folder"))).where(F.col("module").isin(*keys))
    pick = F.min_by("folder", "ord") if first_wins else F.max_by("folder", "ord")
    return rows.groupBy("module").agg(pick.alias("folder"))


def expected_module(name: Column, keys: tuple[str, ...]) -> Column:
    """The module that a folder's name gives, by the first of its marks that is among the expected keys; or null."""
    low = F.lower(F.btrim(name))

    def by(pattern: str) -> Column:
        digits = F.regexp_extract(low, pattern, 1)
        key = F.concat(F.lit("m"), F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")))
        return F.when((digits != "") & key.isin(*keys), key)

    return F.coalesce(by(r"^m(\d+)$"), by(r"(?:^|[^a-z0-9])m(\d+)(?:[^a-z0-9]|$)"), by(r"module[\s_-]*(\d+)"))


def detected_modules(members: DataFrame, keys: tuple[str, ...] = ("m1", "m2", "m3", "m4", "m5")) -> DataFrame:
    """The folder of each module of dossiers (dossier, path of a file below its root): dossier, module, folder.

    The root comes first: if its name gives a module, it is that module's folder
    and nothing else counts.  Otherwise its folders do, in the order of their
    names, and of several with one module the later takes it.  Files beside them
    give none.  Empty paths are left out; repeated ones change nothing.
    """
    parts = members.select("dossier", F.filter(F.split(normalised(F.col("path")), "/"), lambda s: s != "").alias("p")).where(F.size("p") > 1)
    levels = parts.select("dossier", F.explode(F.slice(F.transform("p", lambda s, i: F.struct(i.alias("level"), F.array_join(F.slice("p", 1, i + 1), "/").alias("folder"), s.alias("name"))), 1, F.least(F.size("p") - 1, F.lit(2)))).alias("f"))
    found = levels.select("dossier", "f.level", "f.folder", "f.name", expected_module(F.col("f.name"), keys).alias("module")).where("module IS NOT NULL")
    best = found.groupBy("dossier", "module").agg(F.min("level").alias("level"), F.min_by("folder", F.struct("level", "folder")).alias("root"), F.max_by("folder", F.struct(F.when(F.col("level") == 1, F.col("name")))).alias("last"))
    rooted = F.max(F.when(F.col("level") == 0, 1).otherwise(0)).over(Window.partitionBy("dossier"))
    best = best.withColumn("rooted", rooted)
    return best.where((F.col("rooted") == 0) | (F.col("level") == 0)).select("dossier", "module", F.when(F.col("level") == 0, F.col("root")).otherwise(F.col("last")).alias("folder"))


def is_module_folder(name: Column) -> Column:
    return F.lower(F.btrim(name)).rlike(r"^m[1-5]$|^module[\s_-]*[1-5]$")


def sheet_key(name: Column) -> Column:
    """m and the first number of a sheet's name; a name without one is an error."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(digits == "", F.raise_error(F.concat(F.lit("no module number in sheet name: "), name))).otherwise(F.concat(F.lit("m"), digits))


def module_aliases(key: Column) -> Column:
    """Names that a module goes by."""
    low = F.lower(F.btrim(key))
    n = F.regexp_extract(low, r"(\d+)", 1)
    return F.array_distinct(F.array(low, F.regexp_replace(low, r"[^a-z0-9]", ""), F.concat(F.lit("m"), n), F.concat(F.lit("module"), n), F.concat(F.lit("module "), n)))


def unwrapped(members: DataFrame, path: str = "path") -> DataFrame:
    """members without the one folder that holds them all, if there is one."""
    top = F.split(F.col(path), "/")[0]
    usable = members.where(~top.isin("__MACOSX", ".DS_Store"))
    tops = usable.agg(F.count_distinct(top).alias("n"), F.bool_and(F.instr(F.col(path), "/") > 0).alias("inside"))
    rows = usable.crossJoin(F.broadcast(tops))  # one row
    return rows.withColumn(path, F.when((F.col("n") == 1) & F.col("inside"), F.regexp_replace(path, "^[^/]*/", "")).otherwise(F.col(path))).drop("n", "inside")


def kind(path: Column) -> Column:
    """How a file is read; null is unsupported."""
    ext = extension(path)
    return F.when(ext.isin("pdf", "docx"), ext).when(ext.isin("txt", "md", "csv", "json", "xml", "html"), "text").when(ext.isin("mp3", "wav", "m4a"), "audio").when(ext.isin("png", "jpg", "jpeg"), "image")


def anonymisable(path: Column) -> Column:
    return extension(path).isin("docx", "pdf")


def version_diff(members: DataFrame) -> DataFrame:
    """Members (archive, path) of archives a and b whose lower-cased base name the other one lacks: only_in, path, key.

    Several members with one base name all appear.
    """
    rows = members.where(safe(F.col("path"))).select("archive", "path", F.lower(basename(F.col("path"))).alias("key"))
    has = rows.groupBy("key").agg(F.bool_or(F.col("archive") == "a").alias("in_a"), F.bool_or(F.col("archive") == "b").alias("in_b")).where("NOT (in_a AND in_b)")
    return rows.join(has, "key").select(F.col("archive").alias("only_in"), "path", "key")


def content_diff(members: DataFrame) -> DataFrame:
    """An extension of ``version_diff``: base names that both archives (archive, path, content) have with different contents."""
    rows = members.where(safe(F.col("path"))).groupBy(F.lower(basename(F.col("path"))).alias("key")).agg(F.min(F.when(F.col("archive") == "a", F.sha2(F.col("content").cast("binary"), 256))).alias("a"), F.min(F.when(F.col("archive") == "b", F.sha2(F.col("content").cast("binary"), 256))).alias("b"))
    return rows.where("a <> b").select("key")


def tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """Nodes of the tree that paths make: path, parent, name, depth (from 1), type, extension."""
    parts = F.filter(F.split(normalised(F.col(path)), "/"), lambda x: x != "")
    rows = paths.select(parts.alias("p")).where(F.size("p") > 0).distinct()
    rows = rows.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    nodes = rows.select(F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("path"), F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/").alias("parent"), F.get("p", F.col("depth") - 1).alias("name"), "depth", (F.col("depth") < F.size("p")).alias("inner"))
    nodes = nodes.groupBy("path", "parent", "name", "depth").agg(F.bool_or("inner").alias("folder"))
    return nodes.select("path", "parent", "name", F.col("depth").cast("long").alias("depth"), F.when(F.col("folder"), "folder").otherwise("file").alias("type"), F.when(F.col("folder"), "").otherwise(extension(F.col("name"))).alias("extension"))


def natural_key(name: Column) -> Column:
    """Sorts digits as numbers of any length (each behind the number of its digits) and letters without case."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda x: F.ltrim(x, F.lit("0"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(number(x)).cast("string"), 4, "0"), number(x))).otherwise(F.lower(x))), "")


def siblings_ordered(nodes: DataFrame) -> DataFrame:
    """nodes with ``place`` among their parent's children: folders first, then by name without case."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.col("type") == "file", F.lower("name"), "name")).cast("long"))


def leaf_image_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """Folders with images and no folder of images below them: one document each."""
    folder = F.regexp_replace(F.col(path), "/[^/]*$", "")
    images = files.where(extension(F.col(path)).isin("png", "jpg", "jpeg")).groupBy(folder.alias("folder")).agg(F.count("*").alias("n_images"))
    parents = images.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda d: F.array_join(F.slice(F.split("folder", "/"), F.lit(1), d - 1), "/"))).alias("folder")).distinct()
    return images.join(parents, "folder", "left_anti")


def source_name(name: Column) -> Column:
    """A file's name as a source gives it: without folders and a page in brackets at its end, in lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1), r"(?i)\s*\(page\s*\d+\)\s*$", "")))


def source_stem(name: Column) -> Column:
    """A source's name without its extension, after a second page in brackets has gone too."""
    return F.regexp_replace(source_name(source_name(name)), r"(?i)\.[a-z0-9]+$", "")


def canonical_name(name: Column) -> Column:
    """A source's name, extension included, of a-z and 0-9 only, after a second page in brackets has gone too."""
    return F.regexp_replace(source_name(source_name(name)), "[^a-z0-9]", "")


def stem_words(name: Column) -> Column:
    return F.filter(F.split(source_stem(name), "[^a-z0-9]+"), lambda w: w != "")


def name_score(wanted: Column, name: Column) -> Column:
    """How well a source's name fits a file's: 100 exactly, 95 by stem, 90 in canonical form, 80 if one holds the other (any holds an empty one), else the source's words (repeats counted) that the file has, or -1."""
    a, b, ca, cb = source_name(wanted), source_name(name), canonical_name(wanted), canonical_name(name)
    has = F.map_from_arrays(F.array_distinct(stem_words(name)), F.transform(F.array_distinct(stem_words(name)), lambda w: F.lit(1)))
    shared = F.size(F.filter(stem_words(wanted), lambda w: F.map_contains_key(has, w)))
    return (
        F.when((a == "") | (b == ""), -1)
        .when(a == b, 100)
        .when(source_stem(wanted) == source_stem(name), 95)
        .when(ca == cb, 90)
        .when(ca.contains(cb) | cb.contains(ca), 80)
        .when(shared > 0, shared)
        .otherwise(-1)
    )


#: A word that more files have is common: files meet sources over their sets of common words, not one by one.
COMMON = 200


def most_shared(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Files (name, ord, ws: distinct words) with the most words of each source (source_name, ws; repeats count), as source_name and f, a struct of ord and name.

    Up to two files a source, the first of those with the most words among them.
    Files that share a rare word with the source are met one by one.  Of all
    others only the common words count, so the first file of each set of common
    words stands for its like, and sources with the same common words ask once.
    """
    common = files.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("w", F.lit(True).alias("common"))

    def marked(rows: DataFrame, key: str, *columns: str) -> DataFrame:
        """A row for each word, and the common ones of its row in order, as one text."""
        words = rows.select(key, *columns, F.explode("ws").alias("w")).join(common, "w", "left")
        own = F.array_join(F.array_sort(F.collect_list(F.when(F.col("common"), F.col("w")))), " ")
        return words.groupBy(key, *columns).agg(own.alias("own"), F.filter(F.collect_list(F.when(F.col("common").isNull(), F.col("w"))), lambda w: w.isNotNull()).alias("rare"))

    times = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    split = lambda c: F.split(c, " ")
    of_common = lambda mine, other: F.aggregate(split(other), F.lit(0), lambda n, w: n + times(split(mine), w))
    a, b = marked(sources, "source_name"), marked(files, "name", "ord")
    # By rare words: their number, and the common ones of the pair.
    met = a.select("source_name", F.explode("rare").alias("w")).join(b.select("name", "ord", F.explode("rare").alias("w")), "w").groupBy("source_name", "name", "ord").agg(F.count("*").alias("n"))
    met = met.join(a.select("source_name", F.col("own").alias("mine")), "source_name").join(b.select("name", "ord", "own"), ["name", "ord"])
    met = met.withColumn("n", F.col("n") + F.when((F.col("mine") != "") & (F.col("own") != ""), of_common(F.col("mine"), F.col("own"))).otherwise(0))
    best = lambda rows, key: rows.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "ord", "name")).alias("s")).select(key, F.struct("s.ord", "s.name").alias("f"))
    # By sets of common words.
    firsts = b.where("own <> ''").groupBy("own").agg(F.min(F.struct("ord", "name")).alias("f")).select("own", "f.ord", "f.name")
    asked = a.where("own <> ''").select(F.col("own").alias("mine")).distinct()
    kinds = asked.select("mine", F.explode(split(F.col("mine"))).alias("w")).join(firsts.select("own", "ord", "name", F.explode(split(F.col("own"))).alias("w")), "w").groupBy("mine", "own", "ord", "name").agg(F.count("*").alias("n"))
    others = a.select("source_name", F.col("own").alias("mine")).join(best(kinds, "mine"), "mine").select("source_name", "f")
    return best(met, "source_name").unionByName(others)


def best_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """For each source (source_name) the file (name, ord) that fits best, the first of equals; sources with none are left out.

    Names are compared as distinct texts, and each rule brings together only the
    pairs that it can score: equal names, stems and canonical forms by equi-joins,
    contained ones over their rarest run of up to six characters, shared words by
    the words.  Of each rule one file a source goes on.
    """
    spark = sources.sparkSession
    forms = lambda c: (source_name(c).alias("k1"), source_stem(c).alias("k2"), canonical_name(c).alias("k3"), stem_words(c).alias("ws"))
    kept = {"a": sources.select("source_name").distinct().select("source_name", *forms(F.col("source_name"))), "b": files.select("name", "ord", *forms(F.col("name")))}
    path = scratch(spark, "names")  # forms are asked for many times and computed once
    for side, rows in kept.items():
        rows.where("k1 <> ''").write.parquet(f"{path}/{side}")
    a, b = (spark.read.parquet(f"{path}/{side}") for side in kept)

    def first(key: str) -> DataFrame:
        return b.groupBy(key).agg(F.min(F.struct("ord", "name")).alias("f"))

    def met(key: str) -> DataFrame:
        return a.select("source_name", key).join(first(key), key).select("source_name", "f")

    canons, first_of = a.select("source_name", F.col("k3").alias("ca")), first("k3").withColumnRenamed("k3", "cb")
    needles, hays = canons.where("ca <> ''").select("ca").distinct(), first_of.where("cb <> ''").select("cb")
    inside = containing(needles.withColumnRenamed("ca", "needle"), hays.withColumnRenamed("cb", "hay"), most=6).select(F.col("needle").alias("ca"), F.col("hay").alias("cb"))
    around = containing(hays.withColumnRenamed("cb", "needle"), needles.withColumnRenamed("ca", "hay"), most=6).select(F.col("hay").alias("ca"), F.col("needle").alias("cb"))
    held = inside.unionByName(around).join(first_of, "cb").groupBy("ca").agg(F.min("f").alias("f"))
    contained = canons.join(held, "ca").select("source_name", "f")
    # An empty form is in all others: the first file for such a source, the first such file for all.
    anything = F.broadcast(b.agg(F.min(F.struct("ord", "name")).alias("f")).where("f IS NOT NULL"))
    nothing = F.broadcast(first_of.where("cb = ''").select("f"))
    empty = canons.where("ca = ''").crossJoin(anything).unionByName(canons.crossJoin(nothing)).select("source_name", "f")  # one row each
    shared = most_shared(a.select("source_name", "ws"), b.select("name", "ord", F.array_distinct("ws").alias("ws")))
    pairs = met("k1").unionByName(met("k2")).unionByName(met("k3")).unionByName(contained).unionByName(empty).unionByName(shared)
    pairs = pairs.select("source_name", "f.name", "f.ord").distinct().withColumn("score", name_score(F.col("source_name"), F.col("name"))).where("score > 0")
    best = pairs.groupBy("source_name").agg(F.max_by(F.struct("name", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("b"))
    return best.select("source_name", "b.name", F.col("b.score").cast("long").alias("score"))


def snippets(members: DataFrame, pages: int = 5, most: int = 14_000) -> DataFrame:
    """What a reviewer sees of members: path, snippet (null with an error), error.

    members: path, pages (texts of a PDF's pages), lead (a Word file's lead text),
    read_error and extract_error (messages, null if all went well).
    """
    ext = extension(F.col("path"))
    head = F.left(F.regexp_replace(F.array_join(F.slice("pages", 1, pages), "\n"), r"(?U)^\s+|\s+$", ""), F.lit(most))
    error = (
        F.when(F.col("read_error").isNotNull(), F.concat(F.lit("read_failed: "), "read_error"))
        .when(~ext.isin("pdf", "docx"), "unsupported_type")
        .when(F.col("extract_error").isNotNull(), F.concat(ext, F.lit("_extract_failed: "), "extract_error"))
    )
    return members.withColumn("error", error).select("path", F.when(F.col("error").isNull(), F.when(ext == "pdf", head).otherwise(F.col("lead"))).alias("snippet"), "error")


def job_listing(files: DataFrame, results: str = "json", assets: str = "assets", sources: str = "pdf") -> DataFrame:
    """Jobs that have a result, from all files (path, size) of the three folders: job_name, json_file, pdf_file (null if there is none), asset_count, json_size_bytes."""
    job = lambda form: F.regexp_extract("path", form, 1)
    found = [job(rf"^{results}/([^/]+)\.json$"), job(rf"^{assets}/([^/]+)/[^/]+\.png$"), job(rf"^{sources}/([^/]+)\.pdf$")]
    name = F.coalesce(*[F.nullif(x, F.lit("")) for x in found])
    rows = files.select(name.alias("job_name"), F.when(found[0] != "", F.col("size")).alias("size"), (found[1] != "").alias("asset"), (found[2] != "").alias("source")).where("job_name IS NOT NULL")
    jobs = rows.groupBy("job_name").agg(F.max("size").alias("json_size_bytes"), F.count_if("asset").alias("asset_count"), F.bool_or("source").alias("source")).where("json_size_bytes IS NOT NULL")
    return jobs.select("job_name", F.concat("job_name", F.lit(".json")).alias("json_file"), F.when(F.col("source"), F.concat("job_name", F.lit(".pdf"))).alias("pdf_file"), "asset_count", "json_size_bytes")


def count_files(nodes: DataFrame) -> DataFrame:
    """One row with the number of files in a tree."""
    return nodes.agg(F.count_if(F.col("type") == "file").alias("files"))


def one_per_module(files: DataFrame, module: str = "module", order: str = "ord") -> DataFrame:
    """The last file of each module, by order."""
    columns = [c for c in files.columns if c != module]
    return files.groupBy(module).agg(F.max_by(F.struct(*columns), order).alias("f")).select(module, "f.*")
