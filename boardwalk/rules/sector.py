"""Fixed values.

Sector language: alternatives per sector, in deciding order.

These strings decide results, so they are stated exactly and in matching order.
"""

SECTOR_ORDER = ["education", "health", "nonprofit", "government", "research"]

STRONG = {
    "education": [
        r"\b(our|the)\s+(university|college|campus|institution)\b",
        r"\b(faculty|provost|dean of|tenure[- ]track|registrar|academic affairs)\b",
        r"\b(our|the|its)\s+students\b",
        r"\b(school district|higher education|land[- ]grant|undergraduate|postgraduate)\b",
        r"\b(equal opportunity employer and educator|title ix|ferpa)\b",
    ],
    "health": [
        r"\b(our|the)\s+(hospital|health system|medical cent(er|re)|clinic)\b",
        r"\b(our|its)\s+patients\b",
        r"\b(academic medical cent(er|re)|bedside|inpatient|outpatient|ambulatory)\b",
        r"\b(clinical staff|care team|nursing staff|attending physician|patient care)\b",
        r"\b(nhs\s+(trust|foundation|england|scotland)|magnet[- ]designated)\b",
    ],
    "nonprofit": [
        r"\b501\s*\(\s*c\s*\)\s*\(?\s*3",
        r"\b(non[- ]?profit|not[- ]for[- ]profit)\s+(organi[sz]ation|organisation|employer|status)\b",
        r"\b(our donors|donor[- ]funded|grant[- ]funded)\b",
        r"\b(our|the) fundraising\b|\bfundrais(ing (team|department|campaign|target|strategy)|er)\b",
        r"\bphilanthropic (support|income|gifts|giving|funding)\b",
        r"\b(registered charity|charity number|charitable (trust|foundation|organi[sz]ation))\b",
        r"\b(our mission[- ]driven|mission[- ]driven non)\b",
    ],
    "government": [
        r"\b(civil service|government agency|local authority)\b",
        r"\bpublic sector (employer|body|organi[sz]ation|role|post|position|pension|employee|worker)\b",
        r"\b(work|working|career|employment|experience) (in|for|within) the public sector\b",
        r"\b(merit system|classified service|gs[- ]?\d{1,2}\s+(level|scale|grade))\b",
        r"\b(department of (transportation|health|education|human services))\b",
    ],
    "research": [
        r"\b(our|the)\s+(research institute|laboratory|observatory|museum)\b",
        r"\b(principal investigator|peer[- ]reviewed|research grant|national laborator)",
        r"\b(scientific staff|research programme|postdoctoral)\b",
    ],
}

# case-sensitive
CASED = {
    "government": r"\b(City|County|State|Commonwealth|Municipality|Borough|Parish|Town|Village|District)\s+of\s+[A-Z][a-z]",
}

NAME_HINT = {
    "education": r"(universit|college|school|academy|campus|polytech|\bisd\b|\bunisa\b|\.edu\b)",
    "health": r"(hospital|health\s?system|medical|clinic|\bnhs\b|healthcare|infirmary|hospice)",
    "nonprofit": r"(foundation|charity|charitable|ministries|diocese|\bymca\b|goodwill|habitat|society|council|trust)",
    "government": r"(county|municipal|\bcity of\b|\bstate of\b|\bgov\b|borough|district|library|authority)",
    "research": r"(research|institute|laborator|museum|observatory)",
}

VENDOR = [
    r"\b(series [a-e]\b|seed[- ]stage|venture[- ]backed|our investors|yc\s?[swf]\d{2})\b",
    r"\b(our (platform|product|saas|software|customers|clients|users))\b",
    r"\b(b2b|go[- ]to[- ]market|arr\b|mrr\b|product[- ]market fit)\b",
    r"\b(we (are building|build|sell)|our customers include)\b",
    r"\b(health\s?(tech|care) (startup|company)|ed\s?tech)\b",
    r"\bstart[- ]?up\b",
    r"\b(our|the)\s+(\w+\s+){0,2}(partners?|customers?|clients?)\b",
    r"\b(hospital|health system|clinic|universit\w+|school|district)\s+(partners?|customers?|clients?)\b",
    r"\b(deployed|rolled out|live)\s+(at|across|in)\s+(top\s+)?(hospitals|health systems|universities|schools)\b",
]

BOILERPLATE = (
    r"[^.!?]*\b(fair chance (ordinance|initiative|act)|ban[- ]the[- ]box|"
    r"arrest and conviction record|conviction record|criminal histor(y|ies))\b[^.!?]*[.!?]"
)

# Phrases inside BOILERPLATE; without one of them nothing is cut.
BOILERPLATE_PHRASES = (
    r"\b(fair chance (ordinance|initiative|act)|ban[- ]the[- ]box|"
    r"conviction record|criminal histor(y|ies))\b"
)
