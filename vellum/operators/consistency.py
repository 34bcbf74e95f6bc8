"""Fields of a dossier: anchors, normal forms, comparison across modules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import finditer, let, lower_alnum
from vellum.session import tasks

# Results depend on each of them, and on their order.
NOT_FOUND = "Not found"
ALIASES = {"acetaminophen": "paracetamol", "apap": "paracetamol", "paracetamol": "paracetamol", "acetylsalicylic acid": "aspirin", "asa": "aspirin", "aspirin": "aspirin", "salbutamol": "albuterol", "albuterol": "albuterol"}
SALTS = ("hydrochloride", "hcl", "sodium", "maleate", "mesylate", "besylate", "tartrate", "citrate", "fumarate", "succinate", "sulfate", "phosphate", "acetate")
FORMS = {
    "OS-TAB": ("extended-release tablet", "immediate release tablet", "film-coated tablet", "fc tablet", "coated tablet", "oral tablet", "tablet"),
    "OS-CAP": ("hard gelatin capsule", "hard capsule", "hgc", "capsule"),
    "PAR": ("solution for iv infusion", "iv infusion", "solution for injection", "sterile solution", "lyophilized powder for injection", "powder for injection", "injection", "infusion"),
    "OL": ("oral suspension", "oral solution", "suspension", "syrup"),
    "TOP": ("topical cream", "topical gel", "ointment", "cream", "gel"),
}
SUBTYPES = {
    "OS-TAB": ("film-coated", "extended-release", "immediate release", "chewable", "dispersible", "orodispersible"),
    "OS-CAP": ("hard gelatin", "soft capsule", "modified release"),
    "PAR": ("lyophilized", "powder for", "concentrate for", "emulsion for injection"),
}
INDICATIONS = {
    "hypertension": ("high blood pressure", "htn", "arterial hypertension", "essential hypertension"),
    "type 2 diabetes mellitus": ("t2dm", "niddm", "non-insulin dependent diabetes", "diabetes type 2", "type ii diabetes", "type 2 diabetes"),
    "pneumonia": ("community-acquired pneumonia", "cap", "lower respiratory tract infection"),
}
LEGAL = ("limited", "ltd", "incorporated", "inc", "corporation", "corp", "llc", "gmbh", "private", "pvt", "plc", "ag", "s.a.", "sa", "bv", "nv", "pty")
DIVISIONS = ("division", "department", "plant", "facility", "plot", "survey", "pin", "zip", "india", "usa", "china")
COUNTRIES = ("india", "usa", "united states", "china", "germany", "ireland", "italy", "spain", "france", "uk", "united kingdom", "japan")
STUDIES = {
    "BE-INVIVO": ("bioequivalence study", "be study", "comparative ba study", "comparative bioavailability", "in vivo be", "in-vivo be"),
    "BE-WAIVER": ("bcs-based waiver", "bcs class", "biowaiver", "bio-waiver", "be waiver", "in vitro waiver"),
    "BE-FAST": ("fasting be study", "be study under fasted", "fasted conditions", "fasting study"),
    "BE-FED": ("fed state be study", "post-prandial be", "fed be", "fed study"),
    "NO-BE": ("not applicable", " not required", "n/a", "na ", "no be"),
}
FIELDS = {1: "Strength of product", 2: "Name of product", 3: "Dosage form", 4: "Applicant name", 5: "Finished product manufacturer site", 6: "Drug substance manufacturer site", 7: "Indication", 8: "Stability data (months)", 9: "Shelf life", 10: "Bioequivalence tests"}
ANCHORS = {
    1: (r"strength\s*[:]", r"\bdose\s*[:]", r"dosage\s+strength", r"potency\s*[:]"),
    2: (r"product\s+name\s*[:]", r"name\s+of\s+(?:the\s+)?product\s*[:]", r"proposed\s+name\s*[:]", r"invented\s+name\s*[:]"),
    3: (r"dosage\s+form\s*[:]", r"pharmaceutical\s+form\s*[:]", r"formulation\s*[:]", r"dosage\s+form\b"),
    4: (r"applicant\s*[:]", r"sponsor\s*[:]", r"marketing\s+authori[sz]ation\s+holder", r"mah\s*[:]"),
    5: (r"finished\s+product\s+manufacturer", r"manufacturing\s+site", r"manufacturing\s+facility", r"drug\s+product\s+manufacturer"),
    6: (r"drug\s+substance\s+manufacturer", r"active\s+substance\s+manufacturer", r"api\s+manufacturer", r"substance\s+manufacturer"),
    7: (r"indication\s*[:]", r"therapeutic\s+indication\s*[:]", r"intended\s+use\s*[:]", r"clinical\s+indication"),
    8: (r"stability\s+data", r"stability\s+study", r"stability\s+period", r"long\s*[- ]?term\s+stability"),
    9: (r"shelf\s*[- ]?life\s*[:]", r"shelf\s+life\b", r"expiry\s*[:]", r"retest\s+date"),
    10: (r"bioequivalence", r"\bbe\s+study\b", r"biowaiver", r"bioavailability", r"bcs\s+based"),
}
MOST_ANCHORS, WINDOW, MOST_CHARS = 25, 200, 8000

NORMAL = "struct<display:string,canonical:string,unit:string,number:double,dosage_group:string,subtype:string,be_code:string,lt:int,acc:int,shelf:int,dmf_cep:boolean,multi_site:boolean,conditional:boolean>"
_FIELDS = [f.split(":") for f in NORMAL[7:-1].split(",")]


def _normal(**given: Column) -> Column:
    return F.struct(*[given.get(n, F.lit(False) if t == "boolean" else F.lit(None)).cast(t).alias(n) for n, t in _FIELDS])


def _first_of(choices: list[tuple[Column, Column | str]], otherwise: Column) -> Column:
    out = otherwise
    for test, value in reversed(choices):
        out = F.when(test, F.lit(value) if isinstance(value, str) else value).otherwise(out)
    return out


def _any(low: Column, phrases) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: low.contains(p))


def strength(t: Column) -> Column:
    s = F.regexp_replace(F.translate(F.lower(t), "µμ", "uu"), r"\s+", " ")
    for pattern, unit in ((r"milligrams?", "mg"), (r"micrograms?", "mcg"), (r"\bgrams?\b", "g")):
        s = F.regexp_replace(s, pattern, unit)
    return let(s, lambda s: _strength(t, s))


def _strength(t: Column, s: Column) -> Column:
    p = r"(\d+(?:\.\d+)?)\s*(mg|mcg|g|iu|units?|%|w/w|w/v|ml)\b"
    number, unit = F.nullif(F.regexp_extract(s, p, 1), F.lit("")).cast("double"), F.nullif(F.regexp_extract(s, p, 2), F.lit(""))
    shown = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    canonical = F.coalesce(F.concat(shown, F.lit(" "), unit), lower_alnum(s))
    return _normal(display=F.when(canonical != "", canonical).otherwise(F.left(t, F.lit(120))), canonical=canonical, unit=unit, number=number)


def product_name(t: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " "), r"\s+", " "))
    s = F.regexp_replace(s, r"^(?:tab|tablet|cap|capsule|inj|injection|syrup|oral\s+solution)\s+", "")
    s = F.regexp_replace(s, r"\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)\s*$", "")
    words = F.filter(F.split(s, " "), lambda w: (w != "") & ~w.isin(*SALTS))
    base = F.array_join(words, " ")
    key = _first_of([(F.array_contains(words, k), v) for k, v in ALIASES.items()] + [(base == k, v) for k, v in ALIASES.items()], base)
    return _normal(display=F.when(base != "", F.left(base, F.lit(200))).otherwise(F.left(t, F.lit(200))), canonical=F.when(key != "", key).otherwise(lower_alnum(t)))


def dosage_form(t: Column) -> Column:
    low = F.lower(t)
    group = _first_of([(_any(low, phrases), name) for name, phrases in FORMS.items()], F.lit(None))
    subtype = _first_of([((group == name) & low.contains(h), h) for name, hs in SUBTYPES.items() for h in hs], F.lit(None))
    return _normal(display=F.left(t, F.lit(120)), canonical=F.coalesce(group, F.left(lower_alnum(t), F.lit(80))), dosage_group=group, subtype=subtype)


def applicant(t: Column) -> Column:
    s = F.regexp_replace(F.lower(t), r"(?U)[^\w\s\-]", " ")
    at = F.instr(s, " - ")
    tail = F.substring(s, at + 3, F.length(s))
    s = F.when((at > 0) & _any(tail, DIVISIONS), F.substring(s, F.lit(1), at - 1)).otherwise(s)
    root = F.array_join(F.filter(F.split(s, r"\s+"), lambda w: (w != "") & ~F.rtrim(w, F.lit(".")).isin(*LEGAL)), " ")
    return _normal(display=F.left(t, F.lit(160)), canonical=F.when(root != "", root).otherwise(lower_alnum(t)))


def site(t: Column) -> Column:
    s = t
    for pattern in (r"(?i)\bplot\s*no\.?\s*\d+[\w\-/]*", r"(?i)\bsurvey\s*no\.?\s*\d+[\w\-/]*", r"(?i)\b(?:pin|postal)\s*:?\s*\d{3,10}\b"):
        s = F.regexp_replace(s, pattern, " ")
    s = F.btrim(F.regexp_replace(s, r"\s+", " "))
    low = F.lower(s)

    def around(c: str) -> Column:
        at = F.length(low) - F.instr(F.reverse(low), c[::-1]) - len(c) + 1  # of the last one, from 0
        start = F.greatest(F.lit(0), at - 40)
        return F.left(lower_alnum(F.substring(s, start + 1, at + len(c) + 20 - start)), F.lit(120))

    place = _first_of([(low.contains(c), around(c)) for c in COUNTRIES], lower_alnum(F.right(s, F.lit(120))))
    flagged = t.rlike(r"(?i)\bDMF\s*[A-Z0-9\-]+") | t.rlike(r"(?i)\bCEP\s*[A-Z0-9\-]+")
    return _normal(display=F.left(t, F.lit(200)), canonical=place, dmf_cep=flagged, multi_site=s.rlike(r"(?i)\band\b|\n|;") & (F.length(s) > 80))


def indication(t: Column) -> Column:
    low = F.lower(t)
    known = _first_of([(_any(low, (name, *others)), name) for name, others in INDICATIONS.items()], F.left(lower_alnum(t), F.lit(120)))
    return _normal(display=F.left(t, F.lit(200)), canonical=known)


def months(t: Column) -> Column:
    """The first duration of a text, in months; of several kinds, months before years before days before "36M"."""
    return let(F.btrim(F.lower(t)), _months)


def _months(s: Column) -> Column:
    part = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit("")).cast("double")
    days = part(r"(\d+(?:\.\d+)?)\s*(?:day|days)\b")
    return F.coalesce(
        F.floor(part(r"(\d+(?:\.\d+)?)\s*(?:month|months|mo\b|m\b)")),
        F.bround(part(r"(\d+(?:\.\d+)?)\s*(?:year|years|yr|yrs)\b") * 12),
        F.when(days.isNotNull(), F.greatest(F.lit(1), F.bround(days / 30.5))),
        part(r"\b(\d{2,3})\s*m\b"),
    ).cast("int")


def stability(t: Column) -> Column:
    low = F.lower(t)
    long_term, accelerated = low.rlike(r"long\s*[- ]?term|real\s*time|lt\s*stability"), low.rlike(r"accelerat|stress|acc\s*stability")
    m = months(t)
    acc = F.when(accelerated, m)
    lt = F.when(long_term | acc.isNull(), m)
    none = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    return _normal(display=F.left(t, F.lit(200)), canonical=F.concat(F.lit("LT:"), none(lt), F.lit("|ACC:"), none(acc)), lt=lt, acc=acc)


def shelf_life(t: Column) -> Column:
    m = months(t)
    return _normal(display=F.left(t, F.lit(200)), canonical=F.coalesce(m.cast("string"), F.left(lower_alnum(t), F.lit(80))), shelf=m, conditional=F.lower(t).rlike(r"after\s+opening|reconstitut|storage\s+condition|if\s+stored"))


def bioequivalence(t: Column) -> Column:
    low = F.lower(t)
    code = _first_of([(_any(low, phrases), name) for name, phrases in STUDIES.items()], F.lit(None))
    return _normal(display=F.left(t, F.lit(200)), canonical=F.coalesce(code, F.left(lower_alnum(t), F.lit(80))), be_code=code)


NORMALISERS = {1: strength, 2: product_name, 3: dosage_form, 4: applicant, 5: site, 6: site, 7: indication, 8: stability, 9: shelf_life, 10: bioequivalence}


def normalised(number: Column, raw: Column) -> Column:
    """The normal form of a field's raw value; empty values are "Not found"."""
    t = F.btrim(F.coalesce(raw, F.lit("")), F.lit(" \t\r\n"))
    out = _normal(display=F.left(t, F.lit(200)), canonical=lower_alnum(t))
    for n, f in reversed(NORMALISERS.items()):
        out = F.when(number == n, f(t)).otherwise(out)
    return F.when(t == "", _normal(display=F.lit(NOT_FOUND), canonical=F.lit(""))).otherwise(out)


def with_normal(fields: DataFrame) -> DataFrame:
    """fields (dossier_id, module, field_number, raw) with ``v``, the normal form of raw."""
    return fields.withColumn("v", normalised(F.col("field_number"), F.col("raw")))


def snippets(text: Column, number: int) -> Column:
    """What follows the anchors of a field: from each anchor (25 at most) to 200 characters behind it."""
    spans = F.array_sort(F.array_distinct(F.transform(F.concat(*[finditer(text, f"(?iU)({p})") for p in ANCHORS[number]]), lambda m: F.struct(m["start"], m["end"]))))
    pieces = F.transform(F.slice(spans, 1, MOST_ANCHORS), lambda m: F.substring(text, m["start"] + 1, m["end"] + WINDOW - m["start"]))
    return F.left(F.array_join(pieces, "\n---\n"), F.lit(MOST_CHARS))


def line_value(snippet: Column) -> Column:
    """The first of up to twelve lines that says something: three characters or more, and no heading of a section, table or figure; without one, the first 500 characters."""
    lines = F.slice(F.filter(F.transform(F.split(snippet, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != ""), 1, 12)
    good = F.filter(lines, lambda x: (F.length(x) >= 3) & ~x.rlike(r"(?i)^(section|table|figure)\b"))
    return F.coalesce(F.left(F.get(good, F.lit(0)), F.lit(500)), F.btrim(F.left(snippet, F.lit(500)), F.lit(" \t\r\n")))


def extract_fields(modules: DataFrame, numbers: Iterable[int] = tuple(FIELDS)) -> DataFrame:
    """modules (dossier_id, module, text) to rows dossier_id, module, field_number, raw, of all fields or of those that are asked for.

    Anchors are cheap only for short texts, so rows are dealt to tasks for all cores, whatever file they come from.
    """
    found = F.array(*[F.struct(F.lit(n).alias("field_number"), let(snippets(F.col("text"), n), line_value).alias("raw")) for n in numbers])
    return modules.repartition(tasks(modules.sparkSession)).select("dossier_id", "module", F.inline_outer(found))


def compare(fields: DataFrame) -> DataFrame:
    """The verdict on each field of each dossier across its modules: result, canonical_group.

    fields as from ``with_normal``; modules count in their order.
    """
    rows = fields.groupBy("dossier_id", "field_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("module", "v"))), lambda x: x["v"]).alias("vs"))
    n, vs = F.col("field_number"), F.col("vs")
    values = lambda name: F.transform(vs, lambda v: v[name])
    known = lambda name: F.filter(values(name), lambda x: x.isNotNull())
    several = lambda name: F.size(F.array_distinct(known(name))) > 1
    some = lambda name: F.exists(vs, lambda v: v[name])
    cans = F.array_sort(F.array_distinct(values("canonical")))
    joined, first = F.array_join(cans, "|"), F.get(values("canonical"), F.lit(0))
    verdict = lambda result, group="": F.struct(F.lit(result).alias("result"), (F.lit(group) if isinstance(group, str) else group).cast("string").alias("canonical_group"))
    review, differ, agree = "NEEDS_REVIEW", "INCONSISTENT", "CONSISTENT"
    one = F.size(cans) == 1
    listed = lambda name: F.array_join(F.transform(values(name), lambda x: F.coalesce(x, F.lit("None"))), "|")
    numbers = known("number")
    rules = {
        1: _first_of([((F.size(vs) >= 2) & (F.size(numbers) < F.size(vs)), verdict(review)), (F.size(numbers) == 0, verdict(review)), (several("number"), verdict(differ, first)), (several("unit"), verdict(review, first)), (one, verdict(agree, first))], verdict(differ, joined)),
        3: _first_of([(F.size(known("dosage_group")) < F.size(vs), verdict(review, listed("dosage_group"))), (several("dosage_group"), verdict(differ, listed("dosage_group"))), (several("subtype"), verdict(review, F.get(values("dosage_group"), F.lit(0))))], verdict(agree, F.get(values("dosage_group"), F.lit(0)))),
        8: _first_of([(F.size(known("lt")) == 0, verdict(review)), (several("lt"), verdict(differ, F.array_join(F.array_sort(F.array_distinct(known("lt"))).cast("array<string>"), "|")))], verdict(agree, F.get(known("lt"), F.lit(0)))),
        9: _first_of([(F.size(known("shelf")) == 0, verdict(review)), (several("shelf"), verdict(differ, F.array_join(F.array_sort(F.array_distinct(known("shelf"))).cast("array<string>"), "|"))), (some("conditional"), verdict(review, F.get(known("shelf"), F.lit(0))))], verdict(agree, F.get(known("shelf"), F.lit(0)))),
        10: _first_of([(F.size(known("be_code")) == 0, verdict(review)), (several("be_code"), verdict(review, F.array_join(F.array_sort(F.array_distinct(known("be_code"))), "|")))], verdict(agree, F.get(known("be_code"), F.lit(0)))),
    }
    sites = _first_of([(some("dmf_cep"), verdict(review, first)), (some("multi_site"), verdict(review, first)), (one, verdict(agree, first))], verdict(differ, joined))
    named = _first_of([(one, verdict(agree, first))], verdict(review, joined))
    out = _first_of([(n == k, r) for k, r in rules.items()] + [(n.isin(5, 6), sites), (n.isin(2, 4, 7), named)], verdict(agree, first))
    out = F.when(F.exists(vs, lambda v: v["display"] == NOT_FOUND), verdict(review)).otherwise(out)
    return rows.select("dossier_id", "field_number", let(out, lambda x: x).alias("o")).select("dossier_id", "field_number", "o.result", "o.canonical_group")


def refined(verdicts: DataFrame, fields: DataFrame) -> DataFrame:
    """verdicts after the rules across fields: shelf life against stability, and the bioequivalence claims of modules 2 and 5."""
    month = fields.where("field_number IN (8, 9)").groupBy("dossier_id", "module").agg(F.max(F.when(F.col("field_number") == 8, F.col("v.lt"))).alias("lt"), F.max(F.when(F.col("field_number") == 9, F.col("v.shelf"))).alias("shelf"), F.bool_or(F.when(F.col("field_number") == 9, F.col("v.conditional"))).alias("conditional"))
    shelf = month.groupBy("dossier_id").agg(F.coalesce(F.bool_or(F.col("shelf") > F.col("lt")), F.lit(False)).alias("too_long"), F.coalesce(F.bool_or("conditional"), F.lit(False)).alias("conditional"))
    code = lambda m: F.max(F.when(F.upper("module") == m, F.coalesce(F.col("v.be_code"), F.lit("?"))))
    claims = fields.where("field_number = 10").groupBy("dossier_id").agg(code("M2").alias("c2"), code("M5").alias("c5"))
    rows = verdicts.join(shelf, "dossier_id", "left").join(claims, "dossier_id", "left")
    alive = ("BE-INVIVO", "BE-FAST", "BE-FED")
    is9, is10 = F.col("field_number") == 9, F.col("field_number") == 10
    result = _first_of([(is9 & F.col("too_long"), "INCONSISTENT"), (is9 & F.col("conditional"), "NEEDS_REVIEW"), (is10 & F.col("c2").isin(*alive) & F.col("c5").isin("?", "NO-BE"), "INCONSISTENT"), (is10 & F.col("c2").isin(*alive) & F.col("c5").isin(*alive), "CONSISTENT")], F.col("result"))
    group = F.when(is10 & F.col("c2").isin(*alive) & F.col("c5").isin(*alive), F.col("c2")).otherwise(F.col("canonical_group"))
    return rows.select("dossier_id", "field_number", result.alias("result"), group.alias("canonical_group"))


def consistent_ratio(verdicts: DataFrame, *keys: str) -> DataFrame:
    return verdicts.groupBy(*keys).agg(F.count_if(F.col("result") == "CONSISTENT").alias("consistent"), F.count("*").alias("total"))
