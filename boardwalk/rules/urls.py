"""Fixed values.

Board URL patterns, reserved words and known platforms.

These strings decide results, so they are stated exactly and in matching order.
"""

# (provider, archive pattern, extraction pattern, case-insensitive)
PATTERNS = [
    ("greenhouse", "job-boards.greenhouse.io/*", r"job-boards\.greenhouse\.io/([A-Za-z0-9][A-Za-z0-9_-]*)", False),
    ("greenhouse", "boards.greenhouse.io/*", r"boards\.greenhouse\.io/([A-Za-z0-9][A-Za-z0-9_-]*)", False),
    ("ashby", "jobs.ashbyhq.com/*", r"jobs\.ashbyhq\.com/([A-Za-z0-9][A-Za-z0-9_.-]*)", False),
    ("workday", "*.myworkdayjobs.com/*", r"https?://([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:([a-z]{2}(?:[-_][A-Za-z]{2})?)/)?([A-Za-z0-9_-]+)", False),
    ("smartrecruiters", "jobs.smartrecruiters.com/*", r"jobs\.smartrecruiters\.com/([A-Za-z0-9][A-Za-z0-9_-]*)", False),
    ("smartrecruiters", "careers.smartrecruiters.com/*", r"careers\.smartrecruiters\.com/([A-Za-z0-9][A-Za-z0-9_-]*)", False),
    ("workable", "apply.workable.com/*", r"apply\.workable\.com/([A-Za-z0-9][A-Za-z0-9_-]*)", False),
    ("personio", "*.jobs.personio.de/*", r"https?://([a-z0-9][a-z0-9-]*)\.jobs\.personio\.de", True),
    ("personio", "*.jobs.personio.com/*", r"https?://([a-z0-9][a-z0-9-]*)\.jobs\.personio\.com", True),
    ("bamboohr", "*.bamboohr.com/*", r"https?://([a-z0-9][a-z0-9-]*)\.bamboohr\.com/(?:careers|jobs)", True),
    ("recruitee", "*.recruitee.com/*", r"https?://([a-z0-9][a-z0-9-]*)\.recruitee\.com", True),
    ("teamtailor", "*.teamtailor.com/*", r"https?://([a-z0-9][a-z0-9-]*)\.teamtailor\.com", True),
    ("rippling", "ats.rippling.com/*", r"ats\.rippling\.com/([A-Za-z0-9][A-Za-z0-9_-]*)", False),
    ("icims", "*.icims.com/*", r"https?://([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.icims\.com)/", True),
    ("ukg", "recruiting.ultipro.com/*", r"(recruiting2?\.ultipro\.com)/([A-Za-z0-9_]+)/JobBoard/([0-9a-f-]{36})", True),
    ("ukg", "recruiting2.ultipro.com/*", r"(recruiting2?\.ultipro\.com)/([A-Za-z0-9_]+)/JobBoard/([0-9a-f-]{36})", True),
    ("workday", "*.myworkdaysite.com/*", r"https?://wd\d+\.myworkdaysite\.com/(?:[A-Za-z]{2}-[A-Za-z]{2}/)?recruiting/([A-Za-z0-9_-]+)/([A-Za-z0-9_-]+)", False),
    ("oracle", "*.oraclecloud.com/*", r"https?://([a-z0-9-]+\.fa\.[a-z0-9-]+\.oraclecloud\.com)/hcmUI/CandidateExperience/[A-Za-z_-]+/sites/([A-Za-z0-9_]+)", True),
    ("eightfold", "*.eightfold.ai/*", r"https?://([a-z0-9][a-z0-9-]*)\.eightfold\.ai/[^?#]*\?(?:[^#]*&)?domain=([a-z0-9][a-z0-9.-]*\.[a-z]{2,})", True),
]

NOT_A_TOKEN = (
    r"^(embed|api|jobs?|search|apply|login|home|about|robots\.txt|sitemap\.xml|assets|static|"
    r"images?|css|js|wday|en|en-us)$"
)

BARE_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MAX_TOKEN_CHARS = 100

KNOWN_UNSUPPORTED = [
    (r"\.myworkdayjobs\.com$|\.wd\d+\.myworkdayjobs\.com$", "workday", "json_api_unbuilt"),
    (r"\.oraclecloud\.com$", "oracle_hcm", "json_api_unbuilt"),
    (r"\.recruitee\.com$", "recruitee", "json_api_unbuilt"),
    (r"\.teamtailor\.com$", "teamtailor", "json_api_unbuilt"),
    (r"\.applytojob\.com$", "jazzhr", "json_api_unbuilt"),
    (r"(^|\.)ats\.rippling\.com$", "rippling", "json_api_unbuilt"),
    (r"\.bamboohr\.com$", "bamboohr", "json_api_unbuilt"),
    (r"(^|\.)comeet\.co$", "comeet", "json_api_unbuilt"),
    (r"\.taleo\.net$", "taleo", "browser"),
    (r"successfactors\.(com|eu)$", "successfactors", "browser"),
    (r"(^|\.)recruiting\.paylocity\.com$", "paylocity", "browser"),
    (r"\.paycomonline\.net$", "paycom", "browser"),
    (r"(^|\.)ukg\.com$|\.ultipro\.com$", "ukg", "browser"),
    (r"workforcenow\.adp\.com$", "adp", "browser"),
    (r"\.dayforcehcm\.com$", "dayforce", "browser"),
]
