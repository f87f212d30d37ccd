"""Survey specification: roles of columns, item groups and fixed code tables.

Every operator in the library is parameterised by a :class:`SurveySpec`
instead of module-level lists, so the same code serves the parity
definitions (global reserve list, raw-code label) and the corrected ones
(per-column reserve codes, recoded label).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# Fixed values of the analysed survey (they must equal the source analysis).
# --------------------------------------------------------------------------

# Reserve codes ("valid skip", "don't know", "refusal", "not stated") by width.
RESERVE_CODES = (6, 9, 96, 99, 996, 999, 9996, 9999, 99996, 99999, 999996, 999999)

# Answer labels that denote a reserve code; dropped from decode tables.
RESERVE_LABELS = ("Valid skip", "Don't know", "Refusal", "Not stated")

# Out-of-pocket expense brackets.
EXPENSE_RANGES = {
    1: "Less than $200",
    2: "$200 to $499",
    3: "$500 to $999",
    4: "$1,000 to $1,999",
    5: "$2,000 to $4,999",
    6: "$5,000 or more",
}

# Hours-of-care bands.
HOURS_BANDS = {
    0: "No hours",
    1: "Less than 10 hours",
    2: "10-19 hours",
    3: "20-29 hours",
    4: "30-39 hours",
    5: "40-49 hours",
    6: "50+ hours",
}

# Household income groups.
INCOME_BRACKETS = {
    1: "Less than $20,000",
    2: "$20,000 to $39,999",
    3: "$40,000 to $59,999",
    4: "$60,000 to $79,999",
    5: "$80,000 to $99,999",
    6: "$100,000 to $119,999",
    7: "$120,000 to $139,999",
    8: "$140,000 or more",
}

# Strain items and their display labels.
STRAIN_LABELS = {
    "ICS_40": "Overall caregiving is Very/Somewhat stressful",
    "FIS_10A": "Reduced time for other family members",
    "FIS_10B": "Caused family conflict or tension",
    "FIS_10C": "Other family members took on extra duties",
    "FIS_10D": "Limited ability to do things as a family",
    "FIS_10E": "Caused financial difficulties for family",
    "FIS_10F": "Affected family members' school or work",
    "FIS_10G": "Affected caregiver's own health",
    "FIS_10H": "Reduced caregiver's social activities",
    "CRH_10": "Relationship with care receiver became harder",
    "CRH_20": "Felt resentment or frustration toward care receiver",
    "CRH_30": "Considered stopping or reducing caregiving",
}

# Composite score items: positive flags and the one subtracted flag.
FWA_POS = ("FWA_132", "FWA_133", "FWA_134", "FWA_136", "FWA_137")
FWA_NEG = "FWA_150"
ITE_POS = ("ITE_30A", "ITE_30B", "ITE_30C", "ITE_30D", "ITE_30E")
ITE_NEG = "ITE_10"

# Activity gateway flags, expense columns, demographic columns.
ACTIVITY_GATEWAY = {
    "ARO_10": "House maintenance",
    "ARP_10": "Personal care",
    "ARM_10": "Medical treatments",
    "ARS_10": "Social / recreational activities",
    "ARB_10": "Behavioural support",
    "ARV_10": "Vision / hearing assistance",
    "ARX_10": "Other assistance",
}
EXPENSE_COLS = {
    "HOME_EXP": "Home modifications",
    "HLTH_EXP": "Health care costs",
    "HELP_EXP": "Paid help / services",
    "TRNS_EXP": "Transportation",
    "AID_EXP": "Assistive devices / aids",
    "MED_EXP": "Medications",
}
DEMO_VARS = {
    "SEX": "Sex",
    "PRV": "Province / Territory",
    "FAMINCG1": "Household Income Group",
    "MARSTAT": "Marital Status",
    "VISMIN": "Visible Minority Status",
    "SENFLAG": "Senior (65+) Flag",
}
CLUSTER_DEMO_COLS = ("SEX", "MARSTAT", "PRV", "FAMINCG1", "VISMIN", "BPR_16",
                     "LAN_01", "SENFLAG", "COW_10", "UWS230GR")

# Computed variables appended to the variable dictionary.
COMPUTED_DESCRIPTIONS = {
    "flexibility_score": "Workplace Flexibility Score",
    "ite_score": "Work-Enabling Circumstances Score",
}

# Recode maps: binary yes/no to strain 1/0, 4-point scale to 1 .. 0.
YES_NO = {1: 1.0, 2: 0.0}
FOUR_POINT = {1: 1.0, 2: 2 / 3, 3: 1 / 3, 4: 0.0}

# Narrative caregiver profiles (name, description), in profile order 1..5.
PROFILES = (
    ("Solo Caregiver, High Risk",
     "No support network, high hours, employment affected, financially strained. "
     "Highest burnout risk. Requires immediate intervention."),
    ("Overburdened Balancer",
     "Moderate hours with inconsistent support. Managing work and caregiving "
     "simultaneously with no reliable relief. Elevated and escalating burnout risk."),
    ("Supported but Fatigued",
     "Consistent support network present, higher hours, but fatigue is accumulating "
     "over time. Moderate burnout risk with a clear trajectory if support is not maintained."),
    ("High Emotional Load, Low Visibility",
     "Lower caregiving hours but severe psychological impact. Often invisible in standard "
     "burnout assessments because hours appear manageable. Moderate to high risk."),
    ("Stable Long-Term Caregiver",
     "Long caregiving duration, adapted routines, reliable support. Lowest acute burnout "
     "risk but should be monitored for cumulative fatigue."),
)

# What each profile looks like on the intake form, in standard units of (weekly
# hours, employment 1 full-time .. 3 none, support 1 strong .. 3 little, years).
PROFILE_SIGNATURES = (
    (1.2, 0.6, 1.2, 0.0),      # many hours, work affected, no support
    (0.2, -0.9, 0.4, -0.2),    # moderate hours beside work, uneven support
    (0.8, 0.0, -1.2, 0.2),     # more hours, steady support
    (-1.2, 0.0, 0.4, -0.4),    # few hours
    (-0.2, 0.4, -1.0, 1.4),    # many years, reliable support
)

# --------------------------------------------------------------------------


def _lower(names):
    return tuple(n.lower() for n in names)


@dataclass(frozen=True)
class SurveySpec:
    """Roles of the columns of one coded survey table.

    ``reserve`` is either a sequence (applied to every cleaned column, the
    width-blind parity behaviour) or a mapping column -> codes (per-column).
    ``strain_recode`` maps each strain item to its recode map; ``None`` keeps
    raw codes (the raw-code label definition).
    """

    id_col: str
    weight_col: str | None
    features: tuple[str, ...]
    strain_items: tuple[str, ...]
    strain_recode: dict | None
    fwa_pos: tuple[str, ...]
    fwa_neg: str
    ite_pos: tuple[str, ...]
    ite_neg: str
    activity: dict = field(default_factory=dict)
    expenses: dict = field(default_factory=dict)
    demographics: dict = field(default_factory=dict)
    reserve: object = RESERVE_CODES
    drop_prefixes: tuple[str, ...] = ("wtbs_",)
    score_col: str = "burnout_score"
    label_col: str = "burnout_high"
    composites: tuple[str, ...] = ("flexibility_score", "ite_score")

    def reserve_for(self, col: str):
        if isinstance(self.reserve, dict):
            return tuple(self.reserve.get(col, ()))
        return tuple(self.reserve)

    @property
    def composite_items(self) -> tuple[str, ...]:
        return (*self.fwa_pos, self.fwa_neg, *self.ite_pos, self.ite_neg)


def coded_spec(raw_label: bool = False, reserve=RESERVE_CODES) -> SurveySpec:
    """Spec of the survey-shaped ``coded`` table (lower-case column names)."""
    strain = _lower(STRAIN_LABELS)
    recode = None
    if not raw_label:
        recode = {c: (FOUR_POINT if c == "ics_40" else YES_NO) for c in strain}
    activity = {k.lower(): v for k, v in ACTIVITY_GATEWAY.items()}
    expenses = {k.lower(): v for k, v in EXPENSE_COLS.items()}
    demographics = {k.lower(): v for k, v in DEMO_VARS.items()}
    features = ("sex", "prv", "marstat", "famincg1", *activity, *expenses,
                "flexibility_score", "ite_score")
    return SurveySpec(
        id_col="pumfid",
        weight_col="wght_per",
        features=features,
        strain_items=strain,
        strain_recode=recode,
        fwa_pos=_lower(FWA_POS),
        fwa_neg=FWA_NEG.lower(),
        ite_pos=_lower(ITE_POS),
        ite_neg=ITE_NEG.lower(),
        activity=activity,
        expenses=expenses,
        demographics=demographics,
        reserve=reserve,
    )
