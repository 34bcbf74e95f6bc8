"""Small inline tables for rules that the driver tables don't reach, and the results that the rules give on them by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "paths": ("path string", [("Dossier/m1/a.PDF",), ("x/Module 2/b.docx",), ("x/m3_quality/c.pdf",), ("__MACOSX/m4/x",), ("/abs/m4/d.pdf",), ("a/../m5/e.pdf",), ("misc/readme.txt",), ("x/m5.pdf",), ("x/m1/",)]),
    "paths_out": (
        "path string, m string, usable boolean",
        [("Dossier/m1/a.PDF", "m1", True), ("x/Module 2/b.docx", "m2", True), ("x/m3_quality/c.pdf", "m3", True), ("__MACOSX/m4/x", "m4", False), ("/abs/m4/d.pdf", "m4", False), ("a/../m5/e.pdf", "m5", False), ("misc/readme.txt", None, True), ("x/m5.pdf", "m5", True), ("x/m1/", "m1", False)],
    ),
    "fields": (
        "dossier_id int, module string, field_number int, raw string",
        [
            (1, "M2", 1, "10.0 milligrams"), (1, "M3", 1, "10 mg"),
            (2, "M2", 1, "10 mg"), (2, "M3", 1, "20 mg"),
            (3, "M2", 1, "10 mg"), (3, "M3", 1, "10 mcg"),
            (4, "M2", 1, "5%"), (4, "M3", 1, ""),
            (1, "M2", 2, "Tab. Acetaminophen 500 mg"), (1, "M3", 2, "Paracetamol"),
            (2, "M2", 2, "Amlodipine Besylate"), (2, "M3", 2, "Nifedipine"),
            (1, "M2", 3, "Film-coated tablets"), (1, "M3", 3, "oral tablet"),
            (2, "M2", 3, "Hard capsule"), (2, "M3", 3, "solution for injection"),
            (1, "M2", 4, "Acme Pharma Pvt Ltd"), (1, "M3", 4, "Acme Pharma Limited"),
            (1, "M2", 5, "Acme, Pune, India"), (1, "M3", 5, "Acme, Pune, India"),
            (2, "M2", 6, "DMF 1234, Basel, Germany"), (2, "M3", 6, "Basel, Germany"),
            (1, "M2", 7, "Capsule for pain"), (1, "M3", 7, "community-acquired pneumonia"),
            (1, "M2", 8, "Long-term 24 months, accelerated 6 months"), (1, "M3", 8, "24 months"),
            (1, "M2", 9, "36 months"), (1, "M3", 9, "3 years"),
            (2, "M2", 9, "24 months after opening"), (2, "M3", 9, "2 years"),
            (1, "M2", 10, "Fasting BE study"), (1, "M5", 10, "Not applicable"),
            (2, "M2", 10, "Biowaiver granted"), (2, "M5", 10, "BCS class I waiver"),
        ],
    ),
    "fields_out": (
        "dossier_id int, module string, field_number int, canonical string",
        [
            (1, "M2", 1, "10 mg"), (1, "M3", 1, "10 mg"),
            (2, "M2", 1, "10 mg"), (2, "M3", 1, "20 mg"),
            (3, "M2", 1, "10 mg"), (3, "M3", 1, "10 mcg"),
            (4, "M2", 1, "5"), (4, "M3", 1, ""),
            (1, "M2", 2, "paracetamol"), (1, "M3", 2, "paracetamol"),
            (2, "M2", 2, "amlodipine"), (2, "M3", 2, "nifedipine"),
            (1, "M2", 3, "OS-TAB"), (1, "M3", 3, "OS-TAB"),
            (2, "M2", 3, "OS-CAP"), (2, "M3", 3, "PAR"),
            (1, "M2", 4, "acme pharma"), (1, "M3", 4, "acme pharma"),
            (1, "M2", 5, "acme pune india"), (1, "M3", 5, "acme pune india"),
            (2, "M2", 6, "dmf 1234 basel germany"), (2, "M3", 6, "basel germany"),
            (1, "M2", 7, "pneumonia"), (1, "M3", 7, "pneumonia"),
            (1, "M2", 8, "LT:24|ACC:24"), (1, "M3", 8, "LT:24|ACC:None"),
            (1, "M2", 9, "36"), (1, "M3", 9, "36"),
            (2, "M2", 9, "24"), (2, "M3", 9, "24"),
            (1, "M2", 10, "BE-INVIVO"), (1, "M5", 10, "NO-BE"),
            (2, "M2", 10, "BE-WAIVER"), (2, "M5", 10, "BE-WAIVER"),
        ],
    ),
    "verdicts_out": (
        "dossier_id int, field_number int, result string",
        [
            (1, 1, "CONSISTENT"), (2, 1, "INCONSISTENT"), (3, 1, "NEEDS_REVIEW"), (4, 1, "NEEDS_REVIEW"),
            (1, 2, "CONSISTENT"), (2, 2, "NEEDS_REVIEW"),
            (1, 3, "CONSISTENT"), (2, 3, "INCONSISTENT"),
            (1, 4, "CONSISTENT"), (1, 5, "CONSISTENT"), (2, 6, "NEEDS_REVIEW"), (1, 7, "CONSISTENT"),
            (1, 8, "CONSISTENT"), (1, 9, "INCONSISTENT"), (2, 9, "NEEDS_REVIEW"),
            (1, 10, "INCONSISTENT"), (2, 10, "CONSISTENT"),
        ],
    ),
    "dossiers": (
        "dossier_id int, module string, text string",
        [(1, "M2", "Section 2\nProduct name: Acmedol\nStrength: 10 mg\nShelf life: 24 months after opening"), (1, "M3", "Dosage form: film-coated tablet\nIndication: essential hypertension"), (2, "M2", ""), (2, "M3", "nothing here")],
    ),
    "blocks": (
        "page_id int, block_id string, block_ord int, type string, x1 double, y1 double, x2 double, y2 double",
        [(1, "b1", 1, "text", 0.0, 0.0, 10.0, 10.0), (1, "b2", 2, "text", 5.0, 5.0, 15.0, 15.0), (1, "b3", 3, "text", 0.0, 0.0, 10.0, 9.5), (1, "t1", 4, "table", 0.0, 20.0, 30.0, 40.0), (1, "i1", 5, "image", 0.0, 50.0, 10.0, 60.0), (2, "b1", 1, "text", 0.0, 0.0, 10.0, 10.0), (2, "b2", 2, "text", 0.0, 0.0, 10.0, 10.0)],
    ),
    "lines": (
        "page_id int, line_ord int, text string, x1 double, y1 double, x2 double, y2 double, confidence double",
        [(1, 1, "a", 0.0, 0.0, 10.0, 5.0, 0.9), (1, 2, "a again", 0.0, 0.0, 10.0, 5.1, 0.8), (1, 3, "b", 8.0, 8.0, 14.0, 14.0, 0.9), (1, 4, "cell", 1.0, 21.0, 29.0, 39.0, 0.95), (1, 5, "far", 80.0, 80.0, 90.0, 84.0, 0.9), (2, 1, "x", 1.0, 1.0, 9.0, 9.0, 0.9)],
    ),
    "words": (
        "page_id int, x0 double, y0 double, x1 double, y1 double, text string",
        [(1, 0.0, 0.0, 30.0, 10.0, "Name"), (1, 34.0, 1.0, 60.0, 11.0, "John"), (1, 0.0, 20.0, 20.0, 30.0, "Age"), (1, 60.0, 21.0, 75.0, 31.0, "47"), (1, 79.0, 20.0, 100.0, 30.0, "years")],
    ),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(*names: str) -> str:
    """The beginning of a query with these tables as common table expressions."""
    parts = []
    for name in names:
        schema, rows = TABLES[name]
        columns = [c.split() for c in schema.split(", ")]
        kinds = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
        chosen = ", ".join(f"CAST({c} AS {kinds[t]}) AS {c}" for c, t in columns)
        body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        parts.append(f"{name} AS (SELECT {chosen} FROM (VALUES {body}) t({', '.join(c for c, _ in columns)}))")
    return "WITH " + ", ".join(parts)
