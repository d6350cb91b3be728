"""Fixed values.

Scoring weights, provider priors and text signals.

These strings decide results, so they are stated exactly and in matching order.
"""

WEIGHTS = {
    "desirabilityDiscount": 0.3,
    "discoveryFriction": 0.25,
    "qualificationFriction": 0.2,
    "applicationFriction": 0.15,
    "freshness": 0.1,
}

PROVIDER_DISCOVERY = {
    "greenhouse": 0.3,
    "lever": 0.35,
    "ashby": 0.4,
    "smartrecruiters": 0.6,
    "workable": 0.65,
    "bamboohr": 0.75,
    "ukg": 0.8,
    "recruitee": 0.8,
    "teamtailor": 0.8,
    "workday": 0.75,
    "personio": 0.75,
    "breezy": 0.85,
    "rippling": 0.85,
    "oracle": 0.8,
    "eightfold": 0.75,
    "icims": 0.85,
    "usajobs": 0.85,
    "socrata": 0.9,
    "amazon": 0.2,
}

PROVIDER_APPLICATION = {
    "greenhouse": 0.25,
    "lever": 0.2,
    "ashby": 0.2,
    "breezy": 0.35,
    "workable": 0.4,
    "personio": 0.5,
    "bamboohr": 0.35,
    "ukg": 0.75,
    "recruitee": 0.3,
    "teamtailor": 0.3,
    "smartrecruiters": 0.55,
    "workday": 1.0,
    "rippling": 0.4,
    "oracle": 0.9,
    "eightfold": 0.7,
    "icims": 0.7,
    "usajobs": 0.95,
    "socrata": 0.8,
    "amazon": 0.45,
}

HUB_CITIES = (
    r"\b(san francisco|bay area|new york|nyc|london|berlin|bengaluru|bangalore|seattle|austin|"
    r"toronto|amsterdam|singapore|dublin|paris|sydney|tel aviv|boston|los angeles|chicago|"
    r"hyderabad|pune|noida|gurgaon|mumbai|delhi)\b"
)

NICHE_SKILLS = (
    r"\b(cobol|mainframe|abap|sap\b|apex|elixir|clojure|erlang|ocaml|haskell|labview|verilog|"
    r"vhdl|fpga|matlab|\bsas\b|fortran|delphi|perl|assembly|plc|scada|autocad|solidworks|"
    r"revit|catia|ansys|actuarial|hl7|fhir|dicom|iso 13485|\bgmp\b|\bgxp\b|hipaa|\baml\b|"
    r"\bkyc\b|basel|solvency)\b"
)

CREDENTIALS = (
    r"\b(security clearance|ts/sci|top secret|public trust|cissp|cisa|cpa\b|\bcfa\b|"
    r"\bpe\b license|registered nurse|\brn\b license|pharmd|\bmd\b required|licensed|"
    r"certification required|board certified)\b"
)

EVERGREEN = (
    r"\b(always accepting|general application|talent (pool|pipeline|community)|"
    r"future opportunities|speculative|open application|expression of interest|"
    r"we are always)\b"
)

STAFFING = (
    r"\b(staffing|recruitment agency|consultancy|c2c|corp to corp|w2 only|multiple positions|"
    r"various clients)\b"
)

