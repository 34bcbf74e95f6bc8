"""Look-ups in a registry of approved products, and names of products in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import finditer, let

# Results depend on each of them, and on their order.
NAME_ANCHORS = (
    r"product\s+name\s*[:]",
    r"name\s+of\s+(?:the\s+)?product\s*[:]",
    r"proposed\s+name\s*[:]",
    r"invented\s+name\s*[:]",
    r"proprietary\s*[,]?\s*commercial\s*or\s*trade\s*name\s*[:]",
)
COMMON_DRUGS = ("Paracetamol", "Ibuprofen", "Aspirin", "Metformin", "Omeprazole", "Amlodipine", "Atorvastatin", "Ciprofloxacin", "Levofloxacin", "Metronidazole", "Losartan", "Ranitidine", "Ceftriaxone", "Azithromycin", "Prednisone", "Dexamethasone", "Pantoprazole", "Cephalexin", "Amoxicillin", "Amphotericin")
NOISE_LINES = ("ovations", "table", "content", "page", "module", "not applicable", "n/a")
MOST_ANCHORS, AHEAD, MOST_CHARS = 25, 1000, 500
BLANKS = " \t\r\n\f\x0b"


def grams(x: Column, n: int) -> Column:
    """Distinct runs of n characters; none of a shorter text.  The text is cut into characters once, so the cost is linear in its length."""

    def runs(chars: Column) -> Column:
        last = F.size(chars) - (n - 1)
        found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), "")))
        return F.when(last > 0, found).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), runs)


def containing(needles: DataFrame, hays: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (needle, hay) of distinct texts where hay contains needle; needles: needle, hays: hay; empty needles meet nothing.

    A contained text has all its runs of ``most`` characters (or itself, if it is
    shorter) in the other one.  Each needle meets the hays over the one of its
    runs that the fewest hays have, so a common run gathers nothing.  Where texts
    are mainly numbers, all runs of three are common, and longer ones are needed.
    """
    needles = needles.where(F.length("needle") > 0).distinct()
    hays = hays.where(F.col("hay").isNotNull()).distinct()
    of = lambda x: F.when(F.length(x) >= most, grams(x, most)).otherwise(F.array(x))
    wanted = needles.select("needle", F.explode(of(F.col("needle"))).alias("gram"))
    sizes = [r[0] for r in needles.select(F.least(F.length("needle"), F.lit(most)).alias("n")).distinct().collect()]  # of 1 to most
    if not sizes:
        return needles.select("needle", F.lit(None).cast("string").alias("hay")).limit(0)
    held = hays.select("hay", F.explode(F.concat(*[grams(F.col("hay"), n) for n in sorted(sizes)])).alias("gram"))
    often = held.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "gram").groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rarest.join(held, "gram").where(F.col("hay").contains(F.col("needle"))).select("needle", "hay")


def look_up(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """For each query (query_id, name, strength) the first row of registry (row_id, drug_name, strength) whose name contains its name, without case.

    With a strength, the row's name or strength must contain that as well; a
    missing value of the registry reads "nan".  Empty names match nothing, and a
    query without a match has nulls.  Names are looked up once, however many
    queries ask for them.
    """
    text = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("nan")))
    given = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    db = registry.select("row_id", text(F.col("drug_name")).alias("hay"), text(F.col("strength")).alias("db_strength"))
    asked = queries.select("query_id", given("name").alias("needle"), given("strength").alias("q_strength"))
    distinct = asked.select("needle", "q_strength").distinct()
    met = containing(distinct.select("needle"), db.select("hay")).join(distinct, "needle").join(db, "hay")
    met = met.where((F.col("q_strength") == "") | F.col("hay").contains(F.col("q_strength")) | F.col("db_strength").contains(F.col("q_strength")))
    best = met.groupBy("needle", "q_strength").agg(F.min("row_id").alias("row_id"))
    known = registry.select("row_id", "drug_name", F.col("strength").alias("db_strength"))
    return asked.join(best, ["needle", "q_strength"], "left").join(known, "row_id", "left").select("query_id", "row_id", "drug_name", "db_strength", F.col("row_id").isNotNull().alias("eligible"))


def product_in(text: Column) -> Column:
    """A product's name from a text; or null.

    Anchors count in order of their place.  Of the lines within 1,000 characters
    from one, without the anchors themselves, the first counts that has three
    characters or more, is no heading of a section, table or figure and no noise.
    Only a text without any anchor is searched for a common drug.
    """
    starts = F.array_sort(F.transform(F.concat(*[finditer(text, f"(?iU)({a})") for a in NAME_ANCHORS]), lambda m: m["start"]))

    def cleaned(x: Column) -> Column:
        for a in NAME_ANCHORS:
            x = F.btrim(F.regexp_replace(x, f"(?iU){a}", ""), F.lit(BLANKS))
        return x

    lines = lambda at: F.transform(F.split(F.substring(text, at + 1, F.lit(AHEAD)), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), cleaned)
    good = lambda x: (F.length(x) >= 3) & ~x.rlike(r"(?iU)^(section|table|figure)\b") & ~F.lower(x).isin(*NOISE_LINES)

    def first(found: Column) -> Column:
        names = F.flatten(F.transform(F.slice(found, 1, MOST_ANCHORS), lambda at: F.filter(lines(at), good)))
        common = F.nullif(F.regexp_extract(text, r"(?iU)\b(" + "|".join(COMMON_DRUGS) + r")\b", 1), F.lit(""))
        return F.when(F.size(found) > 0, F.regexp_replace(F.left(F.get(names, F.lit(0)), F.lit(MOST_CHARS)), r"(?U)\s+", " ")).otherwise(common)

    return let(starts, first)


def headings_check(text: Column, headings: dict[str, str]) -> Column:
    """Whether a specification has its headings (name: pattern): struct of passed and the missing ones' names."""
    missing = F.filter(F.array(*[F.when(~F.coalesce(text, F.lit("")).rlike(f"(?i){p}"), F.lit(n)) for n, p in headings.items()]), lambda x: x.isNotNull())
    return F.struct((F.size(missing) == 0).alias("passed"), missing.alias("missing"))
