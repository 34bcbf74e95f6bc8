"""Named queries over case report forms made of customers: over thirty types of entities, rejected values and overlaps, with their SQL.

A form has a line for each field.  The lines are given once, as templates, from
which both the Spark columns and the SQL are built; what is found in them, and where, follows in SQL
from the fields' lengths, not from any pattern.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.operators import entities
from vellum.plans.catalogue import SALT, query, table

_DAY = "DATE '1950-01-01' + CAST(c_custkey % 20000 + {n} AS INTEGER)"
#: Names in templates: SQL that Spark and DuckDB both read.
_NAMES = {
    "k": "CAST(c_custkey AS VARCHAR(20))",
    "n": "CAST(c_nationkey AS VARCHAR(20))",
    "k6": "lpad(CAST(c_custkey % 1000000 AS VARCHAR(20)), 6, '0')",
    "k4": "lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0')",
    "byte": "CAST(c_custkey % 256 AS VARCHAR(20))",
    "age": "CAST(c_custkey % 140 AS VARCHAR(20))",
} | {f"d{i}": f"CAST({_DAY.format(n=30 * i)} AS VARCHAR(20))" for i in range(5)}

#: (what stands before the value, type, score, source, values that take turns by number: the value and when it counts, in SQL).
_YES = "true"
LINES: list[tuple[str, str, float, str, list[tuple[str, str]]]] = [
    ("Date of birth: ", "DATE_OF_BIRTH", 0.94, "regex", [("{d0}", _YES)]),
    ("Admission date: ", "HOSPITALIZATION_ADMISSION_DATE", 0.92, "regex", [("{d1}", _YES)]),
    ("ICF date # ", "INFORMED_CONSENT_DATE", 0.92, "regex", [("{d2}", _YES)]),
    ("Screening date: ", "SCREENING_ENROLLMENT_DATE", 0.91, "regex", [("{d3}", _YES)]),
    ("Withdrawal date: ", "FOLLOW_UP_WITHDRAWAL_DATE", 0.91, "regex", [("{d4}", _YES)]),
    ("Protocol number: ", "PROTOCOL_NUMBER", 0.93, "regex", [("PRX-{k}", _YES)]),
    ("EudraCT: ", "EUDRACT_NUMBER", 0.95, "regex", [("2021-{k6}-11", _YES)]),
    ("Patient ID: ", "PATIENT_SUBJECT_ID", 0.91, "regex", [("PX{k}7", _YES), ("unknown", "false")]),
    ("MRN: ", "MEDICAL_RECORD_NUMBER", 0.91, "regex", [("MX{k}00", _YES)]),
    ("Randomization code: ", "RANDOMIZATION_CODE", 0.90, "regex", [("RZ{k}Q", _YES)]),
    ("Investigator number: ", "INVESTIGATOR_NUMBER", 0.89, "regex", [("77-{k}", _YES)]),
    ("Study report number: ", "STUDY_REPORT_NUMBER", 0.88, "regex", [("SRX{k}", _YES)]),
    ("Batch number: ", "BATCH_LOT_NUMBER_IF_TRACEABLE", 0.85, "regex", [("BX{k}55", _YES)]),
    ("Donor ID: ", "HUMAN_DERIVED_DONOR_INFO", 0.88, "regex", [("DX{k}-1", _YES)]),
    ("Policy number: ", "HEALTH_PLAN_INSURANCE_ID", 0.88, "regex", [("QL{k}99", _YES)]),
    ("Aadhaar: ", "AADHAAR", 0.96, "regex", [("1234 5678 {k4}", _YES)]),
    ("PAN: ", "PAN", 0.96, "regex", [("ABCDE{k4}F", _YES)]),
    ("Age: ", "AGE", 0.90, "regex", [("{age} years", "c_custkey % 140 BETWEEN 10 AND 120")]),
    ("Gender: ", "GENDER", 0.88, "regex", [("Male", _YES), ("Female", _YES)]),
    ("Diagnosis: ", "DIAGNOSIS_CONDITION", 0.82, "regex", [("Type-2 diabetes mellitus", _YES), ("Hypertension", "false"), ("seasonal cold with fever", "false")]),
    ("Dosage: ", "MEDICATION_DOSAGE", 0.84, "regex", [("10 mg twice daily by mouth", _YES), ("as told by the nurse", "false")]),
    ("BP: ", "VITAL_SIGNS", 0.85, "regex", [("120/80 mmHg supine at rest", _YES), ("120/80 mmHg", "false")]),
    ("Mental health: ", "MENTAL_HEALTH_INFO", 0.78, "regex", [("calm and well", _YES), ("n/a", "false")]),
    ("Alcohol: ", "SUBSTANCE_USE", 0.78, "regex", [("two glasses a week", _YES)]),
    ("Surgery: ", "SURGERY_DETAILS", 0.80, "regex", [("hip joint in {d0}", _YES), ("[post-dose] later", "false")]),
    ("Document author: ", "DOCUMENT_AUTHOR", 0.80, "regex", [("Dr Roe {k}", _YES), ("........", "false")]),
    ("Manufacturer name: ", "MANUFACTURER_NAME", 0.80, "regex", [("Works of {n}", _YES)]),
    ("Patient address: ", "PATIENT_ADDRESS", 0.82, "regex", [("{n} High street", _YES)]),
    ("Watermark: ", "WATERMARK_TEXT", 0.75, "regex", [("draft copy {k}", _YES)]),
    ("Contact number: ", "PHONE", 0.92, "regex", [("+1 (212) 555-{k4}", _YES)]),
    ("Written by ", "EMAIL", 0.96, "regex", [("user{k}@example.org", _YES)]),
    # Found twice, by its label and by itself: one span of the higher score, from both.
    ("IP address: ", "IP_ADDRESS", 0.90, "hybrid", [("10.0.{byte}.7", _YES)]),
    # A second definition finds the rest of these lines: it begins later and scores no more, so it gives way.
    ("Lab results ", "LAB_RESULTS", 0.84, "regex", [("(summary: all within range {k}", _YES)]),
    ("Document author ", "DOCUMENT_AUTHOR", 0.80, "regex", [("/ approver: Jane Roe {n}", _YES)]),
    ("Sponsor name / address: ", "SPONSOR_NAME_ADDRESS", 0.80, "regex", [("Acme, {n} Main road", _YES)]),
]


def _sql(template: str) -> str:
    """A template as SQL that both engines read."""
    parts = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(_NAMES[p] if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p) + ")"


def _turns(values: list[tuple[str, str]], which: int) -> str:
    """The value (0) or its condition (1) that is a customer's turn."""
    made = [_sql(v) if which == 0 else f"({c})" for v, c in values]
    made = [f"({m})" for m in made]
    return made[0] if len(made) == 1 else f"CASE c_custkey % {len(made)} " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(made)) + " END"


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: a form for each customer."""
    lines = [F.expr(f"concat('{before}', {_turns(values, 0)})") for before, _, _, _, values in LINES]
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))


_SPAN_ROWS = "WITH l AS (" + " UNION ALL ".join(f"SELECT c_custkey AS doc_id, {i} AS i, '{before}' AS before, '{kind}' AS entity_type, {score}::DOUBLE AS score, '{source}' AS source, {_turns(values, 0)} AS value, {_turns(values, 1)} AS valid FROM customer" for i, (before, kind, score, source, values) in enumerate(LINES)) + """),
p AS (SELECT *, CAST(sum(length(before) + length(value) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM l)"""


def _bytes(raw: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in raw) + "'::BLOB"


_KEY = (hashlib.sha256(SALT.encode()).digest() if len(SALT.encode()) > 64 else SALT.encode()).ljust(64, b"\0")
_HMAC = f"sha256({_bytes(bytes(b ^ 0x5C for b in _KEY))} || unhex(sha256({_bytes(bytes(b ^ 0x36 for b in _KEY))} || encode(value))))"
_PREFIX = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.PREFIXES.items()) + " ELSE 'ENT' END"
_TOKEN = f"({_PREFIX} || '_' || upper(left({_HMAC}, 8)))"
_GENERAL = f"""CASE WHEN entity_type IN ({", ".join(f"'{d}'" for d in P.PHI_DATES)}) THEN '[DATE_REDACTED]' WHEN entity_type = 'AGE' THEN (doc_id % 140 // 10 * 10) || '-' || (doc_id % 140 // 10 * 10 + 9)
 WHEN entity_type = 'EMAIL' THEN '****@example.org' WHEN entity_type = 'DIAGNOSIS_CONDITION' THEN 'common endocrine disorder' WHEN entity_type = 'PHONE' THEN 'XXXX-XXXX-XX' WHEN entity_type = 'AADHAAR' THEN 'XXXX XXXX XXXX'
 WHEN entity_type = 'PAN' THEN 'XXXXX9999X' WHEN entity_type = 'IP_ADDRESS' THEN 'XXX.XXX.XXX.XXX' ELSE '[' || entity_type || '_REDACTED]' END"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.detect(forms(spark, sf_dir))


@query(_SPAN_ROWS + """ SELECT doc_id, entity_type, value, CAST(upto - length(value) - 1 AS INTEGER) AS "start", CAST(upto - 1 AS INTEGER) AS "end", score, source FROM p WHERE valid""")
def form_entities(spark, sf_dir):
    """Fused entities of forms, with their places: all definitions, rejected values and overlaps."""
    return entities.exploded(_detected(spark, sf_dir)).select("doc_id", "entity_type", F.col("text").alias("value"), "start", "end", "score", "source")


@query(_SPAN_ROWS + f""" SELECT doc_id, string_agg(before || CASE WHEN valid THEN {_TOKEN} ELSE value END, chr(10) ORDER BY i) AS pseudo_text, count(DISTINCT value) FILTER (valid) AS n_tokens FROM p GROUP BY doc_id""")
def form_pseudonymised(spark, sf_dir):
    """Forms with the keyed tokens of their values."""
    done = entities.anonymise(_detected(spark, sf_dir), SALT, "pseudo")
    return done.select("doc_id", "pseudo_text", F.size("mapping").cast("long").alias("n_tokens"))


@query(_SPAN_ROWS + f""" SELECT doc_id, string_agg(before || CASE WHEN valid THEN {_GENERAL} ELSE value END, chr(10) ORDER BY i) AS full_text FROM p GROUP BY doc_id""")
def form_generalised(spark, sf_dir):
    """Forms with the general forms of their values."""
    return entities.full_texts(forms(spark, sf_dir)).select("doc_id", "full_text")


@query(_SPAN_ROWS + f""" SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS serial_no, entity_type, value AS original_value, {_TOKEN} AS pseudo_value, {_GENERAL} AS full_anon_value,
 source AS detection_source, score AS confidence, 1::BIGINT AS occurrences FROM p WHERE valid""")
def form_change_report(spark, sf_dir):
    """The report of changes of forms, numbered by first occurrence, with tokens and general forms."""
    return entities.reported(forms(spark, sf_dir), SALT)


@query(_SPAN_ROWS + " SELECT entity_type, count(*) AS n, count(DISTINCT value) AS n_values FROM p WHERE valid GROUP BY 1")
def form_type_summary(spark, sf_dir):
    return entities.type_summary(entities.exploded(_detected(spark, sf_dir)))


@query(_SPAN_ROWS + " SELECT source, count(*) AS n FROM p WHERE valid GROUP BY 1")
def form_source_summary(spark, sf_dir):
    return entities.source_summary(entities.exploded(_detected(spark, sf_dir)))
