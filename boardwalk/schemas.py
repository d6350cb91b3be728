"""Table schemas and the feed query."""

from dataclasses import dataclass, field, fields

UNKNOWN = "__unknown__"
MAX_AGE_DAYS = 21

POSTINGS = (
    "key string, provider string, board_token string, company string, title string, "
    "location string, country string, region string, remote_type string, seniority string, "
    "employment_type string, department string, salary_min double, salary_max double, "
    "salary_currency string, posted_at timestamp_ntz, apply_url string, family string, "
    "adjacent boolean, sector string, specialization string, specialization_reason string, "
    "classification_version string, ai boolean, quiet boolean, matched_skills array<string>, "
    "skill_score int, ghost_risk double, salary_usd double, first_seen_at timestamp_ntz, "
    "last_seen_at timestamp_ntz, closed_at timestamp_ntz"
)
# What a vendor reader produces.  NULL means "not stated".
NORMALISED = (
    "provider string, board_token string, external_id string, title string, "
    "description string, location string, country string, region string, city string, "
    "remote_type string, employment_type string, department string, team string, "
    "seniority string, salary_min double, salary_max double, salary_currency string, "
    "apply_url string, listing_url string, posted_at timestamp_ntz, page int, pos int"
)
# Landed payloads: one row per fetched page.
LANDED = (
    "provider string, board_token string, extra map<string,string>, page int, body string"
)
BOARDS = (
    "provider string, token string, company string, extra map<string,string>, active boolean, "
    "source string, domain string, job_count int, consecutive_failures int, last_error string, "
    "last_ok_at timestamp_ntz, last_crawled_at timestamp_ntz, verified_at timestamp_ntz"
)
OUTCOMES = (
    "provider string, token string, site string, jobs int, error string, failure string"
)
RUNS = (
    "started_at timestamp_ntz, finished_at timestamp_ntz, boards_total long, boards_ok long, "
    "boards_failed long, jobs_scanned long, jobs_upserted long, jobs_closed long"
)
EXCLUSIONS = (
    "reason string, title string, n long, sample_company string, "
    "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
)

SORTS = ("newest", "salary", "fit", "score")
ADJACENT = (None, "include", "only")


def names(ddl: str) -> list[str]:
    """Column names of a DDL string."""
    return [part.split()[0] for part in ddl.split(", ")]


@dataclass(frozen=True)
class FeedQuery:
    """One read of the feed.  Dates are strings in UTC; ``now`` is never implied."""

    now: str
    max_age_days: int = MAX_AGE_DAYS
    in_scope: bool = True
    family: str | None = None
    country: str | None = None
    remote: str | None = None
    seniority: str | None = None
    employment: str | None = None
    provider: str | None = None
    q: str | None = None
    has_salary: bool = False
    min_salary: float | None = None
    min_salary_in_usd: bool = False
    within_days: int | None = None
    ai: bool = False
    hide_ghosts: bool = False
    keep_unknown: bool = True
    stack: str | None = None
    specialization: str | None = None
    adjacent: str | None = None
    sort: str = "newest"
    offset: int = 0
    limit: int = 50
    skills: tuple[str, ...] = field(default=())
    min_fit: float | None = None

    def __post_init__(self):
        problems = []
        if self.sort not in SORTS:
            problems.append(f"sort must be one of {SORTS}")
        if self.adjacent not in ADJACENT:
            problems.append("adjacent must be 'include', 'only' or absent")
        if self.offset < 0 or not 0 < self.limit <= 1000:
            problems.append("offset must not be negative and limit must be 1-1000")
        if self.within_days is not None and self.within_days <= 0:
            problems.append("within_days must be positive")
        if self.specialization and self.specialization != UNKNOWN and self.family:
            from boardwalk.rules.specializations import SPECIALIZATIONS_BY_FAMILY

            if self.specialization not in SPECIALIZATIONS_BY_FAMILY.get(self.family, []):
                problems.append(f"{self.specialization} does not belong to {self.family}")
        if problems:
            raise ValueError("; ".join(problems))

    def is_default_except(self, *names_: str) -> bool:
        """No filter is set apart from the named ones."""
        paging = {"now", "max_age_days", "sort", "offset", "limit", *names_}
        return all(
            getattr(self, f.name) == f.default
            for f in fields(self)
            if f.name not in paging
        )
