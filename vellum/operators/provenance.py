"""Where a snippet comes from: passages in texts, and the items of a page that hold them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import let
from vellum.operators.registry import grams
from vellum.session import tasks

#: Words of a passage between its first and its last one that texts are searched for, at most.
KEY_WORDS = 4
#: Rows and characters of passages that are sent to all tasks at most.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 50_000_000
#: Distinct passages that texts are searched for one after the other, at most; more of them meet texts over runs of words or, without inside words, of characters.
SCANNED = 1_000
# Words that don't count as hits.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "were", "was", "are", "have", "has", "had", "into", "onto", "about", "after", "before", "report")


def normal(text: Column) -> Column:
    """Lower case, with runs of white space as one blank."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[\s]+", " "))


def _runs(words: Column, n: int) -> Column:
    """Distinct hashes of runs of n words."""
    return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.size(words) >= n), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(words, i, F.lit(n)), " "))))


def located(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Where passages (item_id, text) stand in normalised texts (doc_id, text): item_id, doc_id, pos (from 1, of the first place).

    A passage may begin and end within words, so it meets texts over words from
    its inside, up to four of them.  One of one or two words has no inside: it
    meets them over its first three characters (or all, if there are fewer).
    Empty passages are nowhere.  Texts without an id are met as others are.
    """
    words = lambda c: F.split(c, " ")
    b = passages.select("item_id", normal(F.col("text")).alias("b")).where("b <> ''")
    size = F.least(F.size(words(F.col("b"))) - 2, F.lit(KEY_WORDS))
    b = b.withColumn("n", F.when(size > 0, size).otherwise(-F.least(F.length("b"), F.lit(3)))).withColumn("key", F.when(F.col("n") > 0, F.xxhash64("n", F.array_join(F.slice(words(F.col("b")), F.lit(2), F.greatest("n", F.lit(1))), " "))).otherwise(F.xxhash64("n", F.left("b", F.lit(3)))))
    stats = b.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("b")), F.lit(0)).alias("chars"), F.collect_set("n").alias("sizes"), F.count_if(F.col("n") < 0).alias("brief")).first()
    small = stats["rows"] <= BROADCAST_ROWS and stats["chars"] <= BROADCAST_CHARS
    sent = F.broadcast if small else lambda df: df
    d = texts.select("doc_id", normal(F.col("text")).alias("d"))
    if not stats["sizes"]:
        return b.select("item_id", F.lit(None).cast(dict(texts.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).cast("long").alias("pos")).limit(0)
    place = F.instr(F.col("d"), F.col("b")).cast("long").alias("pos")
    every = small and b.select("b").distinct().count() <= SCANNED
    which = F.lit(True) if every else F.col("n") < 0
    sought = b.where(which).select("b").distinct()
    scanned = every or small and stats["brief"] > 0 and sought.count() <= SCANNED
    by_words = [] if every else [n for n in stats["sizes"] if n > 0]
    by_chars = [] if scanned else [-n for n in stats["sizes"] if n < 0]
    parts = []
    if scanned:
        dealt = texts.select("doc_id", "text").repartition(tasks(texts.sparkSession)).select("doc_id", normal(F.col("text")).alias("d"))
        found = dealt.join(F.broadcast(sought), F.col("d").contains(F.col("b"))).select("doc_id", "b", place)
        parts.append(found.join(F.broadcast(b.where(which).select("item_id", "b")), "b").select("item_id", "doc_id", "pos"))
        b = b.where(~which)

    def keys(text: Column) -> Column:
        runs = let(words(text), lambda w: F.concat(*[_runs(w, n) for n in sorted(by_words)])) if by_words else F.array().cast("array<bigint>")
        hashed = lambda n: F.transform(grams(text, n), lambda g: F.xxhash64(F.lit(-n), g))
        return F.concat(runs, *[hashed(n) for n in sorted(by_chars)])

    if by_words or by_chars:
        hits = d.select("doc_id", F.explode(keys(F.col("d"))).alias("key")).join(sent(b.select("item_id", "key")), "key").select(F.col("doc_id").alias("_doc"), "item_id").distinct()
        met = d.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(sent(b.select("item_id", "b")), "item_id").where(F.col("d").contains(F.col("b")))
        parts.append(met.select("item_id", "doc_id", place))
    return reduce(DataFrame.unionByName, parts)


_BLANK = r"[\s\x00-\x1f\x7f]+"


def page_of(items: Column) -> Column:
    """What items_of compares with any snippet: struct of ``hay``, the items joined and normalised, and ``low``, each in lower case."""
    return F.struct(F.ltrim(F.regexp_replace(F.lower(F.array_join(items, " ")), _BLANK, " ")).alias("hay"), F.transform(items, F.lower).alias("low"))


def items_of(snippet: Column, items: Column, page: Column | None = None) -> Column:
    """Struct of ``strong`` and ``weak``: places (from 0) of the items of a page that hold a snippet.

    Items are joined by blanks.  If the snippet, normalised, stands in them, all
    items that it touches are strong.  Otherwise an item with two hits or more is
    weak: a hit is a word of the snippet, of four characters or more and no stop
    word, that stands anywhere in the item; words count as often as they occur.
    ``page`` is page_of(items), where it is at hand for several snippets.
    """
    page = page_of(items) if page is None else page
    plain = lambda x: F.regexp_replace(F.lower(x), _BLANK, " ")
    needle = F.btrim(plain(snippet))

    def strong(at: Column) -> Column:
        # In normalised text, item i begins behind all items before it; one of blanks only has no characters and is never touched.
        upto = lambda i: F.length(F.ltrim(plain(F.concat(F.array_join(F.slice(items, 1, i), " "), F.when(i > 0, " ").otherwise("")))))
        own = lambda x: F.length(F.btrim(plain(x)))
        return F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (own(F.get(items, i)) > 0) & (upto(i) < at - 1 + F.length(needle)) & (upto(i) + own(F.get(items, i)) > at - 1))

    wanted = F.filter(F.split(F.lower(snippet), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))
    none = F.array().cast("array<int>")
    enough = lambda x, tokens: (F.btrim(x) != "") & (F.size(F.filter(tokens, lambda w: x.contains(w))) >= 2)
    held = lambda tokens: F.filter(F.transform(page["low"], lambda x, i: F.when(enough(x, tokens), i)), lambda i: i.isNotNull())
    usable = (needle != "") & (F.size(items) > 0)
    # Words of the snippet and the place are each worked out once, not for each use.
    weak = F.when(F.size(items) > 0, let(wanted, lambda tokens: F.when(F.size(tokens) >= 2, held(tokens)).otherwise(none)))
    place = F.when(usable, F.instr(page["hay"], needle)).otherwise(F.lit(0))
    return let(place, lambda found: F.struct(F.when(found > 0, strong(found)).otherwise(none).alias("strong"), F.when((found == 0) & usable, weak).otherwise(none).alias("weak")))


def alnum_form(text: Column) -> Column:
    """Letters and digits of ASCII in lower case, with runs of anything else as one blank."""
    return F.btrim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9]+", " ")))


def original_range(text: Column, form: Column, needle: Column) -> Column:
    """Where needle's first place in form, the alnum_form of text, stands in text itself: struct of start and end (code points, half open); null if nowhere.

    Letters and digits of the form are those of the text, in order, so the place
    of the n-th one in the text maps a place back.
    """
    letters = lambda x: F.length(F.translate(x, " ", ""))
    at = F.instr(form, needle)
    own = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("^[a-zA-Z0-9]"), i)), lambda i: i.isNotNull())
    first = letters(F.left(form, at - 1))
    pair = lambda places: F.struct(F.get(places, first).cast("int").alias("start"), (F.get(places, first + letters(needle) - 1) + 1).cast("int").alias("end"))
    return F.when((needle != "") & (at > 0), let(own, pair))


def in_word_files(snippets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where snippets (doc_id, snippet_id, snippet, page) stand in Word files, given as blocks (doc_id, block, page, text) in order.

    The look-up has three stages: the whole document, its blocks without a
    separator between them; then the first block that holds the snippet; then the page that was asked
    for, if there is one.  Letter case and all characters but ASCII letters and
    digits are no difference, in dots for what is left out neither.  Gives
    doc_id, snippet_id, stage (document, block, page, none), start and end in the document's
    text (null for a page), and block, the first that is touched or the page's
    first.  Rows that share doc_id and snippet_id are taken for one: the one with
    the least snippet and page counts.  Rows without doc_id are one document.

    A document is put together only where a snippet asks for it, in one row, as its reader shows it.
    """
    asked = snippets.groupBy("doc_id", "snippet_id").agg(F.min(F.struct(F.coalesce("snippet", F.lit("")).alias("snippet"), "page")).alias("a"))
    asked = asked.select(F.col("doc_id").alias("_doc"), "snippet_id", alnum_form(F.col("a.snippet")).alias("needle"), F.col("a.page").alias("asked_page"))
    used = blocks.join(asked.select(F.col("_doc").alias("_d")).distinct(), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    whole = F.array_sort(F.collect_list(F.struct("block", F.coalesce("text", F.lit("")).alias("text"), "page")))
    docs = used.groupBy("doc_id").agg(whole.alias("bs"))
    docs = docs.withColumn("text", F.array_join(F.transform("bs", lambda b: b["text"]), "")).withColumn("form", alnum_form(F.col("text")))
    rows = asked.join(docs, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    rows = rows.withColumn("found", original_range(F.col("text"), F.col("form"), F.col("needle")))
    holds = F.filter("bs", lambda b: alnum_form(b["text"]).contains(F.col("needle")))
    rows = rows.withColumn("held", F.when(F.col("found").isNull() & (F.col("needle") != ""), F.get(holds, F.lit(0))))
    of_page = F.get(F.filter("bs", lambda b: b["page"] == F.col("asked_page")), F.lit(0))
    rows = rows.withColumn("shown", F.when(F.col("found").isNull() & F.col("held").isNull(), of_page))
    before = lambda i: F.aggregate(F.filter("bs", lambda b: b["block"] < i), F.lit(0), lambda n, b: n + F.length(b["text"]))
    inside = original_range(F.col("held.text"), alnum_form(F.col("held.text")), F.col("needle"))
    shifted = F.when(F.col("held").isNotNull(), let(before(F.col("held.block")), lambda n: F.struct((inside["start"] + n).alias("start"), (inside["end"] + n).alias("end"))))
    rows = rows.withColumn("at", F.coalesce("found", shifted))
    # The first block that reaches beyond the start.
    step = lambda a, b: F.struct((a["n"] + F.length(b["text"])).alias("n"), F.when(a["block"].isNull() & (a["n"] + F.length(b["text"]) > F.col("found.start")), b["block"]).otherwise(a["block"]).alias("block"))
    kind = blocks.schema["block"].dataType.simpleString()
    touched = F.aggregate("bs", F.struct(F.lit(0).alias("n"), F.lit(None).cast(kind).alias("block")), step, lambda a: a["block"])
    stage = F.when(F.col("found").isNotNull(), "document").when(F.col("held").isNotNull(), "block").when(F.col("shown").isNotNull(), "page").otherwise("none")
    block = F.when(F.col("found").isNotNull(), touched).otherwise(F.coalesce("held.block", "shown.block"))
    return rows.select(F.col("_doc").alias("doc_id"), "snippet_id", stage.alias("stage"), "at.start", "at.end", block.alias("block"))
