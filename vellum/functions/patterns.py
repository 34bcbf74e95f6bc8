"""Fixed values of entity detection: patterns, catalogue, hints and prefixes.

The values in this module are fixed: results depend on each of them.
"""

from __future__ import annotations

DATE = r"(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[-.,\s]+\d{2,4})"
PHONE_US = r"(?:\+1[\s\-.]?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4})\b"
PHONE_IN = r"(?:\+91[\s\-]?[6-9]\d{9})\b"
PHONE_GENERAL = r"(?:\+\d{1,3}[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]?)\d{2,4}[\s\-]?\d{2,8}\b"
PHONE = rf"(?:{PHONE_US}|{PHONE_IN}|{PHONE_GENERAL})"
IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}"


#: (type, label, value, score): a value counts behind its label, a colon or # may stand between.
LABELLED: tuple[tuple[str, str, str, float], ...] = (
    ("DATE_OF_BIRTH", r"Date\s*of\s*birth|D\.?\s*O\.?\s*B\.?|DOB|Born\s*(?:on)?", DATE, 0.94),
    ("HOSPITALIZATION_ADMISSION_DATE", r"Hospitalization\s*date|Admission\s*date|Date\s*of\s*admission|Admitted\s*(?:on)?", DATE, 0.92),
    ("INFORMED_CONSENT_DATE", r"Informed\s*consent\s*date|Consent\s*date|ICF\s*date", DATE, 0.92),
    ("SCREENING_ENROLLMENT_DATE", r"Screening\s*date|Enrollment\s*date|Date\s*of\s*enrollment|Enrolled\s*(?:on)?", DATE, 0.91),
    ("FOLLOW_UP_WITHDRAWAL_DATE", r"Follow[\s-]*up\s*date|Withdrawal\s*date|Date\s*of\s*withdrawal", DATE, 0.91),
    ("DEATH_DATE", r"Date\s*of\s*death|Death\s*date(?:\s*\([^)]{0,120}\))?|D\.?\s*O\.?\s*D\.?|Date\s*death", DATE, 0.93),
    ("STUDY_DATES", r"Study\s*dates?", rf"{DATE}(?:\s*[-–to,]+\s*{DATE})?", 0.88),
    ("PROTOCOL_NUMBER", r"Protocol\s*(?:number|no\.?|#|ID|Code)|Study\s*protocol|PROT\.?", r"[A-Z0-9][A-Z0-9\-]{2,40}", 0.93),
    ("EUDRACT_NUMBER", r"Eudra\s*CT|EUDRACT", r"\d{4}-\d{6}-\d{2}", 0.95),
    ("IND_NDA_NUMBER", r"\bIND\b(?:\s*/\s*\bNDA\b)?\s*(?:number|no\.?|#)?|\bNDA\b\s*(?:number|no\.?|#)?", r"[A-Z]{0,8}[\-/]?\d{4,12}|[A-Z]*\d{4,12}", 0.92),
    ("SUBJECT_ID", r"Subject\s*ID|Subj(?:ect)?\.?\s*ID|SUB[\s\-]*ID|Subject\s*No\.?", r"[A-Z0-9][A-Z0-9\-]{2,24}", 0.92),
    ("PATIENT_SUBJECT_ID", r"Patient\s*/\s*Subject\s*ID|Patient\s*ID|Pt\.?\s*ID|Patient\s*number", r"[A-Z0-9][A-Z0-9\-]{2,24}", 0.91),
    ("MEDICAL_RECORD_NUMBER", r"\bMRN\b|Medical\s*record\s*(?:number|no\.?)?|Hospital\s*record\s*#", r"[A-Z0-9][A-Z0-9\-]{3,19}", 0.91),
    ("RANDOMIZATION_CODE", r"Random(?:ization)?\s*(?:code|number|ID)|RND[\s\-]*(?:code|no\.?)?", r"[A-Z0-9]{3,20}", 0.90),
    ("INVESTIGATOR_NUMBER", r"\bInvestigator\s*(?:number|no\.?|#|ID)|(?<![A-Za-z])INV(?![A-Za-z])[\s\-]*(?:NO|Number|ID)?", r"[A-Z0-9\-]{2,20}", 0.89),
    ("SITE_NAME_NUMBER", r"\bSite\s*name\b|\bSite\s*(?:number|no\.?|#|ID)\b|(?<![A-Za-z])SITE[\s\-]*(?:ID|NO|Number)(?![A-Za-z])", r"[A-Za-z0-9][A-Za-z0-9\s\-',.&]{2,80}", 0.88),
    ("STUDY_REPORT_NUMBER", r"Study\s*report\s*(?:number|no\.?|#)?", r"[A-Z0-9][A-Z0-9\-]{3,30}", 0.88),
    ("BATCH_LOT_NUMBER_IF_TRACEABLE", r"Batch\s*(?:number|no\.?|#)?|Lot\s*(?:number|no\.?|#)?", r"[A-Z0-9][A-Z0-9\-]{3,30}", 0.85),
    ("HUMAN_DERIVED_DONOR_INFO", r"Donor\s*ID|Donor\s*[:#]", r"[A-Z0-9\-]{3,24}", 0.88),
    ("HUMAN_DERIVED_SAMPLE_DONOR", r"Sample\s*donor|Donor\s*sample", r"[A-Z0-9\-]{3,24}", 0.88),
    ("HEALTH_PLAN_INSURANCE_ID", r"Health\s*plan|Insurance\s*ID|Member\s*ID|Policy\s*#|Policy\s*number|HP[\s\-]*ID", r"[A-Z0-9][A-Z0-9\-]{4,22}", 0.88),
    ("AADHAAR", r"Aadhaar|Aadhar|UID(?:\s*(?:number|no\.?))?|Unique\s*ID\s*(?:number)?", r"\d{4}[ -]?\d{4}[ -]?\d{4}", 0.96),
    ("PAN", r"PAN|P\.?\s*A\.?\s*N\.?|Permanent\s*account\s*(?:number|no\.?)?", r"[A-Z]{5}[0-9]{4}[A-Z]", 0.96),
    ("PHONE", r"Sponsor\s*contact\s*(?:phone|tel|mobile|number)|Regulatory\s*contact\s*(?:phone|tel|mobile|number)|\bMobile\b|\bPhone\b|Tel(?:ephone)?|Contact\s*(?:number|no\.?)?|\bCell\b", PHONE, 0.92),
    ("IP_ADDRESS", r"IP\s*address|IPAddress", IPV4, 0.90),
    ("IP_ADDRESS", "", rf"\b({IPV4})\b", 0.82),
    ("FILE_PATH_WATERMARK", r"File\s*path|Path\s*[:#]?", r"(?:[A-Za-z]:|\\\\[\w\-.\\]+|/)[^\n\r]{0,240}|'[^'\n\r]{1,240}'|\"[^\"\n\r]{1,240}\"", 0.86),
    ("VERSION_FILE_PATH", r"Version\s*/\s*file\s*path", r"[A-Za-z]:\\[^\n\r]{1,200}|/[^\n\r]{1,200}", 0.86),
    ("SPONSOR_CONTACT_EMAIL_PHONE", r"Sponsor\s*contact\s*(?:e[\s-]*mail|email|phone)|Regulatory\s*contact\s*(?:e[\s-]*mail|email)", rf"(?:{EMAIL}|{PHONE})", 0.93),
    ("AGE", r"\bAge\b|Patient\s*age", r"\d{1,3}(?:\s*(?:years?|yrs?))?(?:\s*old)?", 0.90),
    ("GENDER", r"Gender|Sex", r"(?:Male\s*/\s*Female|Female\s*/\s*Male|Female|Male|Intersex|Other|Non[\s-]*binary|\bM\b|\bF\b)\.?", 0.88),
    ("VITAL_SIGNS", r"Vital\s*signs|BP|Blood\s*pressure|Heart\s*rate|SpO2|Temperature", r"[^\n\r\t]{1,80}", 0.85),
    ("LAB_RESULTS", r"Lab\s*results?|Laboratory\s*results?|HbA1c", r"[^\n\r\t]{1,120}", 0.84),
    ("MEDICATION_DOSAGE", r"Medication|Dosage|Prescribed|Dose", r"[^\n\r\t]{1,120}", 0.84),
    ("DIAGNOSIS_CONDITION", r"Diagnosis|Condition|Primary\s*diagnosis|Secondary\s*diagnosis", r"[^\n\r\t]{2,160}", 0.82),
    ("ADVERSE_EVENT_NARRATIVE", r"Adverse\s*event\s*(?:narrative|description|text)|AE\s*narrative", r"[^\n\r\t]{2,300}", 0.80),
    ("GENETIC_INFORMATION", r"Genetic\s*(?:information|test|mutation|variant)|BRCA", r"[^\n\r\t]{2,120}", 0.82),
    ("PREGNANCY_STATUS", r"Pregnancy|Pregnant|Gestational", r"[^\n\r\t]{2,80}", 0.82),
    ("SURGERY_DETAILS", r"Surgery|Surgical\s*procedure|Operation", r"[^\n\r\t]{2,120}", 0.80),
    ("MENTAL_HEALTH_INFO", r"Mental\s*health|Psychiatric|Depression|Anxiety\s*(?:disorder)?", r"[^\n\r\t]{2,120}", 0.78),
    ("SUBSTANCE_USE", r"Substance\s*use|Alcohol|Drug\s*use", r"[^\n\r\t]{2,100}", 0.78),
    ("APPLICANT_SPONSOR_NAME", r"Applicant\s*/\s*Sponsor\s*name", r"[^\n\r\t]{2,120}", 0.82),
    ("SPONSOR_NAME", r"\bSponsor\s*/\s*Applicant\b(?!\s*address)|\bSponsor\s*name\b(?!\s*/\s*address)|Name\s*of\s*sponsor", r"[^\n\r\t]{2,120}", 0.82),
    ("CRO_NAME", r"CRO\s*(?:name)?|Contract\s*research\s*org(?:anisation)?", r"[^\n\r\t]{2,120}", 0.82),
    ("PRINCIPAL_INVESTIGATOR", r"Principal\s*investigator|PI\s*name", r"[^\n\r\t]{2,120}", 0.82),
    ("INVESTIGATOR_NAME", r"\bInvestigator\s+name(?!\s*/\s*number)", r"[^\n\r\t]{2,120}", 0.81),
    ("STUDY_DIRECTOR_NAME", r"Study\s*director", r"[^\n\r\t]{2,120}", 0.81),
    ("QUALIFIED_PERSON_QP_NAME", r"Qualified\s*person|QP\s*name", r"[^\n\r\t]{2,120}", 0.81),
    ("SIGNATORY_NAME", r"Signatory\s*name", r"[^\n\r\t]{2,120}", 0.81),
    ("LEGAL_REPRESENTATIVE", r"Legal\s*representative", r"[^\n\r\t]{2,120}", 0.80),
    ("REGULATORY_CONTACT", r"\bRegulatory\s+contact\b", r"[^\n\r\t]{2,160}", 0.80),
    ("DOCUMENT_AUTHOR", r"Document\s*author", r"[^\n\r\t]{2,120}", 0.80),
    ("DOCUMENT_APPROVER", r"Document\s*approver", r"[^\n\r\t]{2,120}", 0.80),
    ("DOCUMENT_AUTHOR_APPROVER", r"Document\s*author\s*/\s*approver", r"[^\n\r\t]{2,120}", 0.80),
    ("AUTHOR_NAME", r"Author\s*name", r"[^\n\r\t]{2,120}", 0.80),
    ("REVIEWER_NAME", r"Reviewer\s*name", r"[^\n\r\t]{2,120}", 0.80),
    ("MANUFACTURER_NAME", r"Manufacturer\s*name", r"[^\n\r\t]{2,120}", 0.80),
    ("CONTRACT_LAB_NAME", r"Contract\s*lab(?:\s*\([^)]{0,60}\))?(?:\s*name)?(?!\s*/\s*address)", r"[^\n\r\t]{2,200}", 0.80),
    ("LAB_PERSONNEL_NAMES", r"Lab\s*personnel", r"[^\n\r\t]{2,120}", 0.78),
    ("ETHICS_COMMITTEE_NAME", r"Ethics\s*committee|\bIRB\b|\bIEC\b|Institutional\s*review\s*board", r"[^\n\r\t]{2,120}", 0.80),
    ("SUBJECT_FULL_NAME", r"Subject\s*full\s*name|Subject\s*name", r"[^\n\r\t]{2,120}", 0.85),
    ("PATIENT_NAME_REGIONAL_FORMS", r"Patient\s*name", r"[^\n\r\t]{2,120}", 0.84),
    ("SPONSOR_ADDRESS", r"Sponsor\s*address", r"[^\n\r\t]{5,200}", 0.80),
    ("PATIENT_ADDRESS", r"Patient\s*address", r"[^\n\r\t]{5,200}", 0.82),
    ("SITE_ADDRESS", r"\bSite\s*address\b", r"[^\n\r\t]{5,200}", 0.80),
    ("MANUFACTURER_ADDRESS", r"Manufacturer\s*address", r"[^\n\r\t]{5,200}", 0.80),
    ("CONTRACT_LAB_ADDRESS", r"Contract\s*lab\s*address", r"[^\n\r\t]{5,200}", 0.80),
    ("SPONSOR_NAME_ADDRESS", r"Sponsor\s*name\s*/\s*address", r"[^\n\r\t]{5,220}", 0.80),
    ("CONTRACT_LAB_NAME_ADDRESS", r"Contract\s*lab\s*name\s*/\s*address", r"[^\n\r\t]{5,220}", 0.80),
    ("WATERMARK_TEXT", r"Watermark|Confidential\s*[-–]\s*", r"[^\n\r\t]{2,100}", 0.75),
    ("PATIENT_IDENTIFIERS_CLINICAL_SUMMARY", r"Patient\s*identifiers?", r"[^\n\r\t]{2,120}", 0.78),
    ("DONOR_GENETIC_INFO", r"Donor\s*genetic(?:\s*info(?:rmation)?)?", r"[^\n\r\t]{2,120}", 0.82),
    ("LAB_RESULTS_SUMMARY_TABLES", r"Lab\s*results?\s*\(?summary", r"[^\n\r\t]{2,200}", 0.80),
    ("SIGNATORY_INITIALS", r"Signatory\s*initials", r"[A-Z](?:\s*\.?\s*[A-Z]){0,4}", 0.78),
    ("QP_SIGNATURE", r"QP\s*signature", r"[^\n\r\t]{1,80}", 0.72),
    ("EMAIL", "", rf"\b({EMAIL})\b", 0.96),
)

PHI_DATES = ("DATE_OF_BIRTH", "HOSPITALIZATION_ADMISSION_DATE", "INFORMED_CONSENT_DATE", "SCREENING_ENROLLMENT_DATE", "FOLLOW_UP_WITHDRAWAL_DATE", "DEATH_DATE", "STUDY_DATES")
BROAD = ("VITAL_SIGNS", "LAB_RESULTS", "LAB_RESULTS_SUMMARY_TABLES", "MEDICATION_DOSAGE", "DIAGNOSIS_CONDITION", "ADVERSE_EVENT_NARRATIVE", "MENTAL_HEALTH_INFO", "SUBSTANCE_USE", "SURGERY_DETAILS", "PREGNANCY_STATUS", "GENETIC_INFORMATION")
SHORT_REJECTED = ("VITAL_SIGNS", "MEDICATION_DOSAGE", "SUBSTANCE_USE", "DIAGNOSIS_CONDITION")
NUMBERED_IDS = ("SUBJECT_ID", "PATIENT_SUBJECT_ID", "PATIENT_ID", "MEDICAL_RECORD_NUMBER")
NOISE = ("management by laboratory methods", "as well as blood sugar", "consumption can cause raised uric acid", "history parameters", "compliance assessment checklist", "record datetime", "fit status", "test reading", "details [adverse event monitoring]", "[post study safety]", "collect volume (ml)")
MEDICATION_HINTS = (" mg", "mcg", " g", " ml", "iu", "unit", "mg/kg", "mcg/kg", "tablet", "capsule", "dose", "dosage", "route", "amphotericin")
VITAL_HINTS = ("bp", "blood pressure", "heart rate", "pulse", "spo2", "temperature", "systolic", "diastolic")
#: Patterns of validity.
DOTS = r"\.{4,}"
MARKS_ONLY = r"^[-–—.:;,\s\[\]()/_]+$"
BRACKETED = r"\[(study|check[- ]?in|check[- ]?out|pre[- ]?enrollment|post[- ]?dose)\]"
SHORT_NUMBER = r"^\d{1,3}$"
DOSE = r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|iu|units?|mg/kg|mcg/kg)\b"
READING = r"\b\d{2,3}(?:/\d{2,3})?\b"
DIAGNOSIS_WORDS = r"(diagnos|condition|diabet|hypertension|cancer|tb|tuberculosis|hiv|aids|covid|asthma|hepatitis)"

#: Token prefixes by type; other types have ENT.
PREFIXES = {"PERSON": "PER", "AADHAAR": "AAD", "PAN": "PAN", "PHONE": "PHN", "EMAIL": "EML", "DATE": "DTE", "AGE": "AGE", "IP_ADDRESS": "IPA", "LOCATION": "LOC", "DIAGNOSIS": "DXN", "MEDICAL_CONDITION": "MCN", "PASSPORT": "PSP", "BANK_ACCOUNT": "BNK", "PATIENT_ID": "PID", "ORGANISATION": "ORG", "MISC": "MSC"}
#: Types whose generalised form is a constant.
CONSTANT_FORMS = {"PERSON": "<PATIENT_ID>", "AADHAAR": "XXXX XXXX XXXX", "PAN": "XXXXX9999X", "PHONE": "XXXX-XXXX-XX", "DATE": "[DATE_REDACTED]", "IP_ADDRESS": "XXX.XXX.XXX.XXX", "LOCATION": "<LOCATION>", "PASSPORT": "XXXXXXXXX", "BANK_ACCOUNT": "XXXXXXXXXXXXXXXX", "PATIENT_ID": "<PATIENT_ID>"}
DIAGNOSES = ("DIAGNOSIS", "DIAGNOSIS_CONDITION", "MEDICAL_CONDITION")
CONDITIONS = ((r"type[\s-]?1\s+diabet", "autoimmune endocrine disorder"), (r"type[\s-]?2\s+diabet", "common endocrine disorder"), (r"hypertension", "cardiovascular condition"), (r"cancer", "oncological condition"), (r"tuberculosis|tb", "infectious respiratory condition"), (r"hiv|aids", "immunological condition"), (r"covid|sars", "viral respiratory condition"))

#: Canonical names of entity labels that a recogniser may give; other labels stay as they are.
RECOGNISER_LABELS = {
    "PER": "PERSON",
    "B-PER": "PERSON",
    "I-PER": "PERSON",
    "PERSON": "PERSON",
    "ORG": "ORGANISATION",
    "B-ORG": "ORGANISATION",
    "I-ORG": "ORGANISATION",
    "LOC": "LOCATION",
    "B-LOC": "LOCATION",
    "I-LOC": "LOCATION",
    "MISC": "MISC",
    "B-MISC": "MISC",
    "I-MISC": "MISC",
    "AADHAAR": "AADHAAR",
    "DATE": "DATE",
    "AGE": "AGE",
    "MEDICAL_CONDITION": "MEDICAL_CONDITION",
    "DIAGNOSIS": "DIAGNOSIS",
    "PHONE_NUMBER": "PHONE",
    "PATIENT_ID": "PATIENT_ID",
    "ORGANIZATION": "ORGANISATION",
    "B-ORGANIZATION": "ORGANISATION",
    "I-ORGANIZATION": "ORGANISATION",
    "E-ORG": "ORGANISATION",
    "E-PER": "PERSON",
    "E-LOC": "LOCATION",
    "B-DISEASE": "DIAGNOSIS",
    "I-DISEASE": "DIAGNOSIS",
    "DISEASE": "DIAGNOSIS",
    "B-CONDITION": "MEDICAL_CONDITION",
    "I-CONDITION": "MEDICAL_CONDITION",
    "CONDITION": "MEDICAL_CONDITION",
    "B-TREATMENT": "MEDICAL_CONDITION",
    "I-TREATMENT": "MEDICAL_CONDITION",
    "DRUG": "MEDICAL_CONDITION",
    "B-DRUG": "MEDICAL_CONDITION",
}
RECOGNISER_SPURIOUS = (
    "applicant", "sponsor", "contact", "regulatory", "legal", "representative", "identifier", "identifiers", "protocol", "investigator", "subject", "patient", "signature",
    "signatory", "manufacturer", "cro", "version", "document", "author", "reviewer", "name", "address", "phone", "email", "site", "nda", "ind", "eudract", "report", "study", "lot", "batch",
    "donor", "gender", "age", "death", "screening", "enrollment", "consent", "manager", "affairs", "principal", "qualified", "person", "committee", "ethics", "lab", "contract",
    "watermark", "confidential", "org", "ltd", "inc", "corp", "plc", "gmbh", "path", "file", "medical", "mental", "health", "applicable", "repeat", "title", "signed", "number", "record",
)

#: The catalogue of fields: labels by category.
CATALOGUE = {
    "PII": (
        "Applicant / sponsor name", "Signatory name", "Signatory initials", "Signature", "Sponsor address", "Sponsor contact email / phone", "Legal representative", "Regulatory contact",
        "Document author", "Document approver", "Creation / revision date", "Watermark text", "Author name", "Reviewer name", "Investigator name", "Sponsor name", "Protocol number",
        "EudraCT number", "CRO name", "Document version / date", "Manufacturer name", "Manufacturer address", "Qualified person (QP) name", "QP signature", "Contract lab name",
        "Contract lab address", "Sponsor name / address", "Document author / approver", "Batch / lot number (if traceable)", "File path / watermark", "Study director name",
        "Lab personnel names", "Contract lab name / address", "Principal investigator", "Study report number", "Study dates", "Version / file path", "Investigator number",
        "Site name / number", "Site address", "Ethics committee name", "Health plan / insurance ID", "IP address",
    ),
    "PHI": (
        "Patient name (regional forms)", "Patient address", "IND/NDA number", "Patient identifiers (clinical summary)", "Subject ID", "Diagnosis / condition", "Adverse event narrative",
        "Lab results (summary tables)", "Human-derived donor info", "Human-derived sample donor", "Donor genetic info", "Gender", "Medical record number", "Randomization code",
        "Medication / dosage", "Lab results", "Vital signs", "Hospitalization / admission date", "Screening / enrollment date", "Follow-up / withdrawal date", "Death date",
        "Genetic information", "Mental health info", "Substance use", "Pregnancy status", "Surgery details",
    ),
    "PII+PHI": ("Patient / subject ID", "Subject full name", "Date of birth", "Age", "Informed consent date"),
}


def pattern(label: str, value: str) -> str:
    """The pattern of a definition, in Unicode mode: word characters, digits and cases as in any script."""
    return f"(?iU)(?:{label})\\s*[:#]?\\s*({value})" if label else f"(?iU){value}"


#: Parts of a document in reading order.
PARTS = ("body", "table", "header", "first_page_header", "even_page_header", "footer", "first_page_footer", "even_page_footer")
