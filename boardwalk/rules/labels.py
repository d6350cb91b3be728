"""Fixed values.

Workplace, seniority and markup patterns.

These strings decide results, so they are stated exactly and in matching order.
"""

ESCAPED_TAG = (
    r"&(amp;)*lt;\s*/?(p|div|br|li|ul|ol|h[1-6]|span|strong|em|a|b|i|u|table|tbody|thead|tr|"
    r"td|th|section|article|blockquote|pre|code|hr|img|figure|small)\b"
)

NEGATED_REMOTE = r"\b(no|not|non|isn'?t)[- ]?remote\b|\bremote\s+(work\s+)?(is\s+)?not\b"

REMOTE_WORDS = r"\b(remote|telecommut\w*|work from home|wfh)\b|100%\s*remote"

HYBRID_WORDS = r"\bhybrid\b"

ONSITE_WORDS = r"\b(on[- ]?site|in[- ]?office|in[- ]?person)\b"

VAGUE_LOCATION = (
    r"^\s*(\d+\s+locations?|multiple.*|various.*|anywhere|nationwide|field.*|global|worldwide|"
    r"emea|apac|latam|americas|europe|n/a|tbd)\s*$"
)

BARE_COUNTRY = (
    r"^\s*(united states( of america)?|usa|u\.s\.a?\.?|us|united kingdom|uk|great britain|"
    r"canada|india|australia|new zealand|ireland|germany|france|spain|italy|portugal|"
    r"netherlands|belgium|poland|romania|czechia|czech republic|hungary|austria|switzerland|"
    r"sweden|denmark|norway|finland|japan|china|singapore|hong kong|taiwan|south korea|"
    r"vietnam|thailand|indonesia|malaysia|philippines|israel|uae|united arab emirates|"
    r"saudi arabia|egypt|south africa|kenya|nigeria|mexico|brazil|argentina|colombia|chile|"
    r"costa rica)\s*$"
)

SENIORITY_RULES = [
    (r"\b(chief|cto|ceo|cfo|coo|vp|vice president)\b", "executive"),
    (r"\bdirector\b", "director"),
    (r"\b(principal|distinguished|fellow)\b", "principal"),
    (r"\bstaff\b", "staff"),
    (r"\b(senior|sr\.?|snr)\b", "senior"),
    (r"\bnon[\s-]?manager\b", "mid"),
    (r"\b(manager|head of|lead)\b", "lead"),
    (r"\b(junior|jr\.?|entry|graduate|associate|intern(ship)?|trainee)\b", "entry"),
]

EXPLICIT_SENIORITY = [
    (r"^not applicable$|^n/?a$", ""),
    (r"\b(intern(ship)?|student|trainee)\b", "entry"),
    (r"\b(entry|junior|graduate|new grad)\b", "entry"),
    (r"\bassociate\b", "entry"),
    (r"\bmid[- ]senior\b", "senior"),
    (r"\b(mid|intermediate|experienced)\b", "mid"),
    (r"\b(executive|chief|vp|vice president)\b", "executive"),
    (r"\bdirector\b", "director"),
    (r"\b(principal|distinguished|fellow)\b", "principal"),
    (r"\bstaff\b", "staff"),
    (r"\b(manager|head of|lead)\b", "lead"),
    (r"\bsenior\b", "senior"),
]

ENTITIES = {
    "mdash": '—',
    "ndash": '–',
    "lsquo": '‘',
    "rsquo": '’',
    "ldquo": '“',
    "rdquo": '”',
    "hellip": '…',
    "bull": '•',
    "middot": '·',
    "deg": '°',
    "trade": '™',
    "reg": '®',
    "copy": '©',
    "eacute": 'é',
    "egrave": 'è',
    "uuml": 'ü',
    "ouml": 'ö',
    "auml": 'ä',
    "szlig": 'ß',
    "amp": '&',
    "lt": '<',
    "gt": '>',
    "quot": '"',
    "apos": "'",
    "nbsp": ' ',
    "#39": "'",
    "#x27": "'",
    "#x2F": '/',
}
