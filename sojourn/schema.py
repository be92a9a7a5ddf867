"""Row schemas and the fixed token tables of the event-sequence model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("code", T.StringType()),
        T.StructField("numeric_value", T.DoubleType()),
        T.StructField("visit_id", T.LongType()),
        T.StructField("visit_type", T.StringType()),
    ]
)

EVENT_COLUMNS = EVENT.fieldNames()

# Total order of a subject's events, nulls first. The last three columns only break ties.
EVENT_ORDER = ["time", "visit_id", "code", "numeric_value", "visit_type"]

SEQUENCE = T.StructType(
    [T.StructField("subject_id", T.LongType()), T.StructField("text", T.StringType())]
)

TASK_CODES = T.StructType(
    [T.StructField("task", T.StringType()), T.StructField("concept_id", T.LongType())]
)

# ---- Fixed values: code prefixes, tokens and visit names that make up the data format ----

CONDITION, PROCEDURE, MEASUREMENT, DRUG = "CDzz", "PRzz", "MSzz", "DRzz"
VISIT, GENDER, SEX, RACE = "VSzz", "GENzz", "SEXzz", "RACzz"
BIRTH_CODE = "MEDSzzBIRTH"

EXPORTED_VISITS = ["Inpatient Visit", "Emergency Room Visit"]

VISIT_END = "VIEnd"
UNMAPPED_VISIT = "Other"
NO_GAP = "DUMMY"
UNKNOWN, BOS, EOS, PAD = "<unk>", "<s>", "</s>", "<pad>"
IGNORED_LABEL = -100

VISIT_GROUPS = {
    "VIOP": [
        "Outpatient Visit",
        "Office Visit",
        "Outpatient Hospital",
        "Ambulatory Surgical Center",
        "Ambulatory Clinic / Center",
        "Ambulatory Rehabilitation Visit",
        "Health examination",
        "Case Management Visit",
        "Comprehensive Outpatient Rehabilitation Facility",
    ],
    "VIIP": [
        "Inpatient Visit",
        "Inpatient Hospital",
        "Hospital",
        "Rehabilitation Hospital",
        "Inpatient Psychiatric Facility",
        "Comprehensive Inpatient Rehabilitation Facility",
        "Psychiatric Hospital",
        "Intensive Care",
        "Inpatient Hospice",
    ],
    "VIER": [
        "Emergency Room and Inpatient Visit",
        "Emergency Room Visit",
        "Emergency Room - Hospital",
        "Urgent Care Facility",
    ],
    "VITele": ["Telehealth"],
    "VIPharm": ["Pharmacy visit", "Pharmacy"],
    "VIAmb": [
        "Observation Room",
        "Laboratory Visit",
        "Ambulatory Radiology Clinic / Center",
        "Ambulatory Infusion Therapy Clinic / Center",
        "Ambulatory Endoscopy Cinic / Center",
        "Ambulatory Oncology Clinic / Center",
        "Ambulatory Oncological Radiation Clinic / Center",
        "Ambulatory Magnetic Resonance Imaging (MRI) Clinic / Center",
        "Ambulatory Mammography Clinic / Center",
        "Ambulatory Pain Clinic / Center",
        "Ambulatory Occupational Medicine Clinic / Center",
        "Ambulatory Physical Therapy Clinic / Center",
        "Ambulatory Ophthalmologic Surgery Clinic / Center",
        "Ambulatory Research Clinic / Center",
        "Ambulatory Podiatric Clinic / CenterRadiation Therapy Center",
    ],
    "VIHome": [
        "Home Visit",
        "Nursing Facility",
        "Hospice",
        "Behavioral Disturbances Assisted Living Facility",
    ],
    "VIOther": [
        "Ambulance Visit",
        "Ambulance - Land",
        "Place of Employment-Worksite",
        "Other Place of Service",
        "Unknown Value (but present in data)",
        "Mass Immunization Center",
    ],
    "VIEnd": ["VIEnd"],
}

CODE_CATEGORIES = {
    CONDITION: "Condition",
    PROCEDURE: "Procedure",
    MEASUREMENT: "Measurement",
    DRUG: "Drug",
    VISIT: "Visit",
    GENDER: "Gender",
    SEX: "Sex",
    RACE: "Race",
}

VISIT_LABELS = {
    "VIOP": "Outpatient",
    "VIIP": "Inpatient",
    "VIER": "Emergency",
    "VITele": "Telehealth",
    "VIPharm": "Pharmacy",
    "VIAmb": "Ambulatory",
    "VIHome": "Home",
    "VIOther": "Other",
    "VIEnd": "End-of-Visit",
}

# Gap units: name, days in one unit, largest multiple that has a token.
GAP_UNITS = [("D", 1, 6), ("W", 7, 4), ("M", 30, 11), ("Y", 365, 9), ("10Y", 3650, 8)]

AGE_BUCKETS = [
    (18, "<18"),
    (25, "18-25"),
    (35, "25-35"),
    (45, "35-45"),
    (55, "45-55"),
    (65, "55-65"),
    (None, "65+"),
]

# ---- End of fixed values ----

GAP_DAYS = {
    f"TIME_{unit}_{i}": i * days for unit, days, top in GAP_UNITS for i in range(1, top + 1)
}
DECILE_TOKENS = [f"Q{i}" for i in range(10)]


@dataclass(frozen=True)
class Thresholds:
    """Frequency limits of the curation filters, named by what they bound."""

    min_subjects_per_code: int = 100
    min_events_per_subject: int = 200
    max_events_per_subject: int = 2000
    rounds: int = 2
    codes_only: bool = False


@dataclass(frozen=True)
class Augmentation:
    """Visit-drop settings of the training split."""

    target_tokens: int | None = 2048
    copies: int = 5
    max_extra_visits: int = 3
    zero_prs_copy: bool = False

    def __post_init__(self):
        if not self.drops_visits and self.copies > 1:
            raise ValueError("several copies per row need a target length or extra visit drops")

    @property
    def drops_visits(self) -> bool:
        return self.target_tokens is not None or self.max_extra_visits > 0


SPLIT_SEED = 866
ROW_SPLIT_SEED = 42
TEST_FRACTION = 0.2
ROW_TEST_FRACTION = 0.1
WINDOW_TOKENS = 2048
NEW_TOKENS = 128
PRS_CLIP = 1000.0
