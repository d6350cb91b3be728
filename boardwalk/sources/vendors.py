"""Vendor payloads to normalised postings.

Each reader takes landed pages and returns ``schemas.NORMALISED``.  A reader is a JSON
schema and a select; vendors that repeat postings across pages keep the first.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardwalk.functions import dates
from boardwalk.functions.labels import remote_type, resolved_remote_type, seniority
from boardwalk.functions.match import (
    join_distinct,
    join_parts,
    ladder,
    let,
    matches,
    non_empty,
    present,
    trim_all,
)
from boardwalk.functions.pay import by_interval, pay_in_summary
from boardwalk.functions.steps import computed
from boardwalk.functions.text import decode_entities, strip_html
from boardwalk.operators.keys import first_per_key
from boardwalk.sources.landed import normalised, postings_of, union_all

c = F.col
SALARY_HOURS, SALARY_DAYS = 2080, 260


def _quote(part: Column) -> Column:
    """Percent-encode one path or query part."""
    return F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))


def _text(*pieces) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def _extra(name: str) -> Column:
    return F.element_at("extra", name)


def _first_of_board(df: DataFrame) -> DataFrame:
    """First sighting of each posting id over the pages of one board."""
    site = F.coalesce(_extra("site"), F.lit(""))
    keyed = df.withColumn("_site", site)
    return first_per_key(keyed, ["board_token", "_site", "_id"], [c("page"), c("pos")])


def greenhouse(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "greenhouse",
        "jobs array<struct<id string, title string, updated_at string, first_published string, "
        "absolute_url string, location struct<name string>, content string, "
        "departments array<struct<name string>>, offices array<struct<location string>>>>",
        "_b.jobs",
    )
    office = F.get(F.filter("j.offices", lambda o: F.length(o["location"]) > 0), F.lit(0))["location"]
    df = rows.withColumn("_place", F.coalesce(office, c("j.location.name")))
    return normalised(
        df, "greenhouse",
        external_id=c("j.id"), title=c("j.title"), description=strip_html(c("j.content")),
        location=c("_place"), department=F.get("j.departments", F.lit(0))["name"],
        remote_type=resolved_remote_type(None, c("_place"), c("j.title")),
        seniority=seniority(c("j.title")),
        apply_url=c("j.absolute_url"), listing_url=c("j.absolute_url"),
        posted_at=F.coalesce(dates.from_text(c("j.first_published")), dates.from_text(c("j.updated_at"))),
    )


def lever(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "lever",
        "array<struct<id string, text string, country string, workplaceType string, commitment string, "
        "categories struct<commitment string, department string, location string, team string, "
        "allLocations array<string>>, createdAt bigint, description string, descriptionPlain string, "
        "hostedUrl string, applyUrl string, "
        "salaryRange struct<min double, max double, currency string, interval string>>>",
    )
    place = F.coalesce(c("j.categories.location"), F.array_join("j.categories.allLocations", "; "))
    df = rows.withColumn("_place", place)
    interval = c("j.salaryRange.interval")
    annual = interval.isNull() | (interval == "") | (interval == "per-year-salary")

    def pay(name: str) -> Column:
        return F.when(annual, c(f"j.salaryRange.{name}"))

    return normalised(
        df, "lever",
        external_id=c("j.id"), title=c("j.text"),
        description=F.coalesce(c("j.descriptionPlain"), strip_html(c("j.description"))),
        location=c("_place"), country=c("j.country"), department=c("j.categories.department"),
        team=c("j.categories.team"),
        employment_type=F.coalesce("j.commitment", "j.categories.commitment"),
        remote_type=remote_type(c("j.workplaceType"), c("_place"), c("j.text")),
        seniority=seniority(c("j.text")),
        salary_min=pay("min"), salary_max=pay("max"), salary_currency=pay("currency"),
        apply_url=F.coalesce("j.applyUrl", "j.hostedUrl"), listing_url=c("j.hostedUrl"),
        posted_at=dates.from_epoch(c("j.createdAt")),
    )


def ashby(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "ashby",
        "jobs array<struct<id string, title string, department string, team string, employmentType string, "
        "location string, secondaryLocations array<struct<location string>>, publishedAt string, "
        "isListed boolean, isRemote boolean, workplaceType string, address struct<postalAddress "
        "struct<addressLocality string, addressRegion string, addressCountry string>>, jobUrl string, "
        "applyUrl string, descriptionHtml string, descriptionPlain string, compensation "
        "struct<scrapeableCompensationSalarySummary string, compensationTierSummary string>>>",
        "_b.jobs",
    ).where(F.coalesce("j.isListed", F.lit(True)))
    others = F.transform(
        F.coalesce("j.secondaryLocations", F.array().cast("array<struct<location:string>>")),
        lambda s: s["location"],
    )
    kept = F.filter(
        F.concat(F.array("j.location"), others), lambda p: F.coalesce(F.length(p) > 0, F.lit(False))
    )
    summary = F.coalesce(
        "j.compensation.scrapeableCompensationSalarySummary", "j.compensation.compensationTierSummary"
    )
    df = rows.withColumns(
        {"_place": non_empty(F.array_join(kept, "; ")), "_pay": pay_in_summary(summary)}
    )
    postal = "j.address.postalAddress"
    return normalised(
        df, "ashby",
        external_id=c("j.id"), title=c("j.title"),
        description=F.coalesce(c("j.descriptionPlain"), strip_html(c("j.descriptionHtml"))),
        location=c("_place"), city=c(f"{postal}.addressLocality"), region=c(f"{postal}.addressRegion"),
        country=c(f"{postal}.addressCountry"), department=c("j.department"), team=c("j.team"),
        employment_type=c("j.employmentType"),
        remote_type=remote_type(
            c("j.workplaceType"), c("_place"), c("j.title"),
            flag=F.when(c("j.workplaceType").isNull(), c("j.isRemote")),
        ),
        seniority=seniority(c("j.title")),
        salary_min=c("_pay.min"), salary_max=c("_pay.max"), salary_currency=c("_pay.currency"),
        apply_url=F.coalesce("j.applyUrl", "j.jobUrl"), listing_url=c("j.jobUrl"),
        posted_at=dates.from_text(c("j.publishedAt")),
    )


def workable(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "workable",
        "jobs array<struct<title string, shortcode string, employment_type string, telecommuting boolean, "
        "department string, url string, shortlink string, application_url string, published_on string, "
        "created_at string, country string, city string, state string, experience string>>",
        "_b.jobs",
    )
    df = rows.withColumn("_place", join_parts(", ", c("j.city"), c("j.state"), c("j.country")))
    return normalised(
        df, "workable",
        external_id=c("j.shortcode"), title=c("j.title"), location=c("_place"), city=c("j.city"),
        region=c("j.state"), country=c("j.country"), department=c("j.department"),
        employment_type=c("j.employment_type"),
        remote_type=remote_type(None, c("_place"), c("j.title"), flag=c("j.telecommuting")),
        seniority=seniority(c("j.title"), c("j.experience")),
        apply_url=F.coalesce("j.application_url", "j.shortlink", "j.url"),
        listing_url=F.coalesce("j.url", "j.shortlink"),
        posted_at=F.coalesce(dates.from_text(c("j.published_on")), dates.from_text(c("j.created_at"))),
    )


def smartrecruiters(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "smartrecruiters",
        "content array<struct<id string, name string, releasedDate string, location struct<city string, "
        "region string, country string, remote boolean, hybrid boolean, fullLocation string>, "
        "department struct<label string>, function struct<label string>, "
        "typeOfEmployment struct<label string>, experienceLevel struct<label string>>>",
        "_b.content",
    )
    parts = join_parts(", ", c("j.location.city"), c("j.location.region"), c("j.location.country"))
    df = rows.withColumn("_place", non_empty(F.coalesce(c("j.location.fullLocation"), parts)))
    explicit = F.when(c("j.location.hybrid"), "hybrid").when(c("j.location.remote"), "remote")
    url = _text("https://jobs.smartrecruiters.com/", c("board_token"), "/", c("j.id"))
    return normalised(
        df, "smartrecruiters",
        external_id=c("j.id"), title=c("j.name"), location=c("_place"), city=c("j.location.city"),
        region=c("j.location.region"), country=c("j.location.country"),
        department=c("j.department.label"), team=c("j.function.label"),
        employment_type=c("j.typeOfEmployment.label"),
        remote_type=remote_type(explicit, c("_place"), c("j.name")),
        seniority=seniority(c("j.name"), c("j.experienceLevel.label")),
        apply_url=url, listing_url=url, posted_at=dates.from_text(c("j.releasedDate")),
    )


def _name_or_text(field: Column) -> Column:
    """A field that is either plain text or an object with a name."""
    inside = F.get_json_object(field, "$.name")
    return non_empty(F.when(F.startswith(field, F.lit("{")), inside).otherwise(field))


def breezy(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "breezy",
        "array<struct<id string, _id string, friendly_id string, name string, url string, "
        "published_date string, type struct<name string>, location struct<country string, state string, "
        "city string, is_remote boolean, name string>, department string, description string>>",
    )
    df = rows.withColumns(
        {"_country": _name_or_text(c("j.location.country")), "_region": _name_or_text(c("j.location.state"))}
    )
    parts = join_parts(", ", c("j.location.city"), c("_region"), c("_country"))
    df = df.withColumn("_place", non_empty(F.coalesce(c("j.location.name"), parts)))
    page_url = F.when(
        F.length("j.friendly_id") > 0,
        _text("https://", c("board_token"), ".breezy.hr/p/", c("j.friendly_id")),
    )
    url = F.coalesce(c("j.url"), page_url)
    return normalised(
        df, "breezy",
        external_id=F.coalesce("j.id", "j._id", "j.friendly_id", "j.name"), title=c("j.name"),
        description=strip_html(c("j.description")), location=c("_place"), city=c("j.location.city"),
        region=c("_region"), country=c("_country"), department=c("j.department"),
        employment_type=c("j.type.name"),
        remote_type=remote_type(None, c("_place"), c("j.name"), flag=c("j.location.is_remote")),
        seniority=seniority(c("j.name")), apply_url=url, listing_url=url,
        posted_at=dates.from_text(c("j.published_date")),
    )


def workday(pages: DataFrame, now: Column) -> DataFrame:
    rows = postings_of(
        pages.where(F.length(_extra("site")) > 0), "workday",
        "jobPostings array<struct<title string, externalPath string, locationsText string, "
        "postedOn string, bulletFields array<string>>>",
        "_b.jobPostings",
    ).where(F.length("j.title") > 0)
    host = F.coalesce(_extra("host"), _text(c("board_token"), ".wd1.myworkdayjobs.com"))
    url = F.when(
        F.length("j.externalPath") > 0,
        _text("https://", host, "/", F.coalesce(_extra("locale"), F.lit("en-US")), "/", _extra("site"), c("j.externalPath")),
    )
    return normalised(
        rows, "workday",
        external_id=F.coalesce(
            non_empty(c("j.externalPath")), non_empty(F.get("j.bulletFields", F.lit(0))), c("j.title")
        ),
        title=c("j.title"), location=c("j.locationsText"),
        remote_type=resolved_remote_type(None, c("j.locationsText"), c("j.title")),
        seniority=seniority(c("j.title")), apply_url=url, listing_url=url,
        posted_at=dates.posted_on(c("j.postedOn"), now),
    )


def oracle(pages: DataFrame) -> DataFrame:
    usable = pages.where((F.length(_extra("host")) > 0) & (F.length(_extra("site")) > 0))
    rows = postings_of(
        usable, "oracle",
        "items array<struct<requisitionList array<struct<Id string, Title string, PostedDate string, "
        "PrimaryLocation string, PrimaryLocationCountry string, WorkplaceType string, "
        "WorkplaceTypeCode string, JobFamily string, Department string, "
        "secondaryLocations array<struct<Name string>>>>>>",
        "get(_b.items, 0).requisitionList",
    )
    df = rows.withColumns(
        {"_title": non_empty(trim_all(c("j.Title"))), "_place": trim_all(c("j.PrimaryLocation"))}
    ).where(c("_title").isNotNull() & c("j.Id").isNotNull())
    code = F.upper(c("j.WorkplaceTypeCode"))
    workplace = (
        F.when(code == "ORA_REMOTE", "remote").when(code == "ORA_HYBRID", "hybrid")
        .when(code == "ORA_ONSITE", "on-site")
    )
    others = F.transform("j.secondaryLocations", lambda s: trim_all(s["Name"]))
    elsewhere = F.array_join(F.filter(others, lambda n: F.coalesce(F.length(n) > 0, F.lit(False))), ", ")
    url = _text(
        "https://", _extra("host"), "/hcmUI/CandidateExperience/en/sites/", _quote(_extra("site")),
        "/job/", _quote(c("j.Id")),
    )
    return normalised(
        df, "oracle",
        external_id=c("j.Id"), title=c("_title"), location=c("_place"),
        country=c("j.PrimaryLocationCountry"), department=F.coalesce("j.Department", "j.JobFamily"),
        remote_type=resolved_remote_type(
            F.coalesce(workplace, c("j.WorkplaceType")), c("_place"), c("_title"), elsewhere
        ),
        seniority=seniority(c("_title")), apply_url=url, listing_url=url,
        posted_at=dates.from_text(c("j.PostedDate")),
    )


def eightfold(pages: DataFrame) -> DataFrame:
    domain = F.coalesce(_extra("domain"), _extra("site"))
    rows = postings_of(
        pages.where(F.length(domain) > 0), "eightfold",
        "positions array<struct<id string, name string, posting_name string, location string, "
        "locations array<string>, department string, business_unit string, t_create bigint, "
        "canonicalPositionUrl string, work_location_option string, location_flexibility string>>",
        "_b.positions",
    )
    listed = F.filter("j.locations", lambda p: F.coalesce(F.length(p) > 0, F.lit(False)))
    place = F.coalesce(c("j.location"), F.get(listed, F.lit(0)))
    df = rows.withColumns(
        {
            "_id": c("j.id"),
            "_title": trim_all(F.coalesce("j.name", "j.posting_name", F.lit(""))),
            "_place": non_empty(trim_all(place)),
        }
    ).where(c("_id").isNotNull() & (F.length("_title") > 0))
    option = F.lower(F.coalesce("j.work_location_option", "j.location_flexibility", F.lit("")))
    workplace = ladder(
        [
            (F.contains(option, F.lit("remote")), "remote"),
            (F.contains(option, F.lit("hybrid")), "hybrid"),
            (option.rlike("onsite|on-site|on_site"), "on-site"),
        ]
    )
    url = _text(
        "https://", c("board_token"), ".eightfold.ai/careers/job/", _quote(c("_id")), "?domain=", _quote(domain)
    )
    url = F.coalesce(non_empty(c("j.canonicalPositionUrl")), url)
    return normalised(
        _first_of_board(df), "eightfold",
        external_id=c("_id"), title=c("_title"), location=c("_place"),
        department=F.coalesce(non_empty(c("j.department")), non_empty(c("j.business_unit"))),
        remote_type=resolved_remote_type(workplace, c("_place"), c("_title"), F.array_join(listed, "; ")),
        seniority=seniority(c("_title")), apply_url=url, listing_url=url,
        posted_at=F.timestamp_seconds("j.t_create").cast("timestamp_ntz"),
    )


def _slot_remote(place: Column, title: Column, as_text: bool) -> Column:
    """Workplace for vendors whose place is read as the explicit value, not as text."""
    return remote_type(None, place, title) if as_text else remote_type(place, title)


def ukg(pages: DataFrame, location_as_text: bool = False) -> DataFrame:
    address = "Address struct<City string, State struct<Code string, Name string>, Country struct<Code string, Name string>>"
    rows = postings_of(
        pages.where(F.length(_extra("board")) > 0), "ukg",
        "opportunities array<struct<Id string, Title string, RequisitionNumber string, FullTime boolean, "
        "JobCategoryName string, PostedDate string, BriefDescription string, IsRemote boolean, "
        f"Locations array<struct<LocalizedDescription string, {address}, IsRemote boolean>>>>",
        "_b.opportunities",
    )
    first = F.get("j.Locations", F.lit(0))
    a = first["Address"]
    parts = join_distinct(
        ", ", a["City"], F.coalesce(a["State"]["Name"], a["State"]["Code"]),
        F.coalesce(a["Country"]["Name"], a["Country"]["Code"]),
    )
    df = rows.withColumns(
        {
            "_title": trim_all(F.coalesce("j.Title", F.lit(""))),
            "_id": F.coalesce("j.Id", "j.RequisitionNumber"),
            "_place": F.coalesce(parts, non_empty(trim_all(first["LocalizedDescription"]))),
        }
    ).where((F.length("_title") > 0) & (F.length("_id") > 0))
    away = F.coalesce("j.IsRemote", F.lit(False)) | F.coalesce(first["IsRemote"], F.lit(False))
    host = F.coalesce(_extra("host"), F.lit("recruiting.ultipro.com"))
    url = _text(
        "https://", host, "/", c("board_token"), "/JobBoard/", _extra("board"),
        "/OpportunityDetail?opportunityId=", c("_id"),
    )
    return normalised(
        _first_of_board(df), "ukg",
        external_id=c("_id"), title=c("_title"), location=c("_place"),
        remote_type=F.when(away, "fully_remote").otherwise(
            _slot_remote(c("_place"), c("_title"), location_as_text)
        ),
        employment_type=F.when(c("j.FullTime"), "Full-Time"),
        department=non_empty(c("j.JobCategoryName")), seniority=seniority(c("_title")),
        description=strip_html(c("j.BriefDescription")), apply_url=url, listing_url=url,
        posted_at=dates.from_text(c("j.PostedDate")),
    )


def bamboohr(pages: DataFrame, location_as_text: bool = False) -> DataFrame:
    place = "struct<city string, state string, country string, province string>"
    rows = postings_of(
        pages, "bamboohr",
        "result array<struct<id string, jobOpeningName string, departmentLabel string, "
        "employmentStatusLabel string, employmentType string, isRemote boolean, locationType string, "
        f"location {place}, atsLocation {place}>>",
        "_b.result",
    )
    where = join_distinct(
        ", ",
        F.coalesce("j.location.city", "j.atsLocation.city"),
        F.coalesce("j.location.state", "j.atsLocation.state", "j.atsLocation.province"),
        F.coalesce("j.location.country", "j.atsLocation.country"),
    )
    df = rows.withColumns(
        {"_title": trim_all(F.coalesce("j.jobOpeningName", F.lit(""))), "_place": where}
    ).where((F.length("_title") > 0) & c("j.id").isNotNull())
    away = (c("j.locationType") == "1") | c("j.isRemote")
    url = _text("https://", c("board_token"), ".bamboohr.com/careers/", c("j.id"))
    return normalised(
        df, "bamboohr",
        external_id=c("j.id"), title=c("_title"), location=c("_place"),
        remote_type=F.when(F.coalesce(away, F.lit(False)), "fully_remote")
        .when(c("j.locationType") == "2", "hybrid")
        .otherwise(_slot_remote(c("_place"), c("_title"), location_as_text)),
        employment_type=non_empty(F.coalesce("j.employmentStatusLabel", "j.employmentType")),
        department=non_empty(c("j.departmentLabel")), seniority=seniority(c("_title")),
        apply_url=url, listing_url=url,
    )


def recruitee(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "recruitee",
        "offers array<struct<id string, title string, remote boolean, hybrid boolean, on_site boolean, "
        "city string, state_name string, country string, country_code string, department string, "
        "employment_type_code string, experience_code string, published_at string, created_at string, "
        "careers_url string, careers_apply_url string, description string, requirements string, status string>>",
        "_b.offers",
    )
    df = rows.withColumn("_title", trim_all(F.coalesce("j.title", F.lit("")))).where(
        (F.length("_title") > 0)
        & c("j.id").isNotNull()
        & F.coalesce(F.lower("j.status").isin("published", ""), F.lit(True))
    )
    code = F.lower("j.employment_type_code")
    employment = ladder(
        [
            (code.rlike("intern"), "Internship"),
            (code.rlike("temp|contract|freelance"), "Contract"),
            (code.rlike("parttime|part_time"), "Part-time"),
            (code.rlike("fulltime|full_time"), "Full-time"),
        ]
    )
    return normalised(
        df, "recruitee",
        external_id=c("j.id"), title=c("_title"),
        location=join_distinct(", ", c("j.city"), c("j.state_name"), c("j.country")),
        country=non_empty(c("j.country_code")),
        remote_type=F.when(c("j.remote"), "fully_remote").when(c("j.hybrid"), "hybrid").when(c("j.on_site"), "on_site"),
        employment_type=employment, department=non_empty(c("j.department")),
        seniority=F.coalesce(
            non_empty(F.replace("j.experience_code", F.lit("_"), F.lit(" "))), seniority(c("_title"))
        ),
        posted_at=dates.from_text(F.coalesce("j.published_at", "j.created_at")),
        description=strip_html(join_parts("\n\n", c("j.description"), c("j.requirements"))),
        apply_url=F.coalesce("j.careers_apply_url", "j.careers_url"), listing_url=non_empty(c("j.careers_url")),
    )


def _one_or_first(field: Column) -> Column:
    """A JSON field that is a value or an array of values: the value, or the first."""
    listed = F.get_json_object(field, "$[0]")
    return F.when(F.startswith(field, F.lit("[")), listed).otherwise(field)


def teamtailor(pages: DataFrame, location_as_text: bool = False) -> DataFrame:
    rows = postings_of(
        pages, "teamtailor",
        "items array<struct<id string, title string, url string, date_published string, content_html string, "
        "_jobposting struct<title string, description string, datePosted string, employmentType string, "
        "jobLocation string, jobLocationType string>>>",
        "_b.items",
    )
    block = "j._jobposting"
    address = F.get_json_object(_one_or_first(c(f"{block}.jobLocation")), "$.address")
    df = rows.withColumns(
        {
            "_title": trim_all(F.coalesce("j.title", f"{block}.title", F.lit(""))),
            "_id": F.coalesce("j.id", "j.url"),
            "_address": address,
        }
    ).where((F.length("_title") > 0) & (F.length("_id") > 0))

    def part(name: str) -> Column:
        return F.get_json_object("_address", f"$.{name}")

    df = df.withColumn(
        "_place",
        join_distinct(
            ", ", part("addressLocality"), part("addressRegion"), _name_or_text(part("addressCountry"))
        ),
    )
    kind = F.upper(_one_or_first(c(f"{block}.employmentType")))
    employment = ladder(
        [
            (F.contains(kind, F.lit("FULL")), "Full-time"),
            (F.contains(kind, F.lit("PART")), "Part-time"),
            (kind.rlike("CONTRACT|TEMPORARY"), "Contract"),
            (F.contains(kind, F.lit("INTERN")), "Internship"),
        ]
    )
    return normalised(
        df, "teamtailor",
        external_id=c("_id"), title=c("_title"), location=c("_place"),
        remote_type=F.when(c(f"{block}.jobLocationType") == "TELECOMMUTE", "fully_remote").otherwise(
            _slot_remote(c("_place"), c("_title"), location_as_text)
        ),
        employment_type=employment, seniority=seniority(c("_title")),
        posted_at=dates.from_text(F.coalesce("j.date_published", f"{block}.datePosted")),
        description=strip_html(F.coalesce("j.content_html", f"{block}.description")),
        apply_url=non_empty(c("j.url")), listing_url=non_empty(c("j.url")),
    )


def rippling(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "rippling",
        "array<struct<uuid string, name string, department struct<label string>, url string, "
        "workLocation struct<label string>>>",
    )
    df = rows.withColumn("_title", trim_all(c("j.name"))).where(
        (F.length("_title") > 0) & ~matches(c("_title"), r"^copy of\b")
    )
    return normalised(
        df, "rippling",
        external_id=F.coalesce("j.uuid", "_title"), title=c("_title"), location=c("j.workLocation.label"),
        department=c("j.department.label"),
        remote_type=resolved_remote_type(None, c("j.workLocation.label"), c("_title")),
        seniority=seniority(c("_title")), apply_url=c("j.url"), listing_url=c("j.url"),
    )


def usajobs(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "usajobs",
        "SearchResult struct<SearchResultItems array<struct<MatchedObjectDescriptor struct<"
        "PositionTitle string, PositionURI string, ApplyURI array<string>, PositionLocationDisplay string, "
        "OrganizationName string, DepartmentName string, PositionSchedule array<struct<Name string>>, "
        "PositionRemuneration array<struct<MinimumRange string, MaximumRange string, RateIntervalCode string>>, "
        "PublicationStartDate string, UserArea struct<Details struct<JobSummary string, "
        "MajorDuties array<string>, Requirements string>>>>>>",
        "_b.SearchResult.SearchResultItems",
    )
    df = rows.withColumn("d", c("j.MatchedObjectDescriptor")).where(F.length("d.PositionTitle") > 0)
    pay = F.get("d.PositionRemuneration", F.lit(0))
    code = F.upper(F.coalesce(pay["RateIntervalCode"], F.lit("")))
    details = "d.UserArea.Details"
    duties = F.array_join(F.coalesce(f"{details}.MajorDuties", F.array().cast("array<string>")), " ")
    factors = {"PH": SALARY_HOURS, "PD": SALARY_DAYS, "PM": 12}
    return normalised(
        df, "usajobs",
        external_id=F.coalesce("d.PositionURI", _text(c("d.PositionTitle"), "-", c("d.OrganizationName"))),
        title=c("d.PositionTitle"),
        description=strip_html(join_parts("\n\n", c(f"{details}.JobSummary"), duties, c(f"{details}.Requirements"))),
        location=c("d.PositionLocationDisplay"), country=F.lit("US"),
        department=F.coalesce("d.DepartmentName", "d.OrganizationName"),
        employment_type=F.get("d.PositionSchedule", F.lit(0))["Name"],
        remote_type=resolved_remote_type(None, c("d.PositionLocationDisplay"), c("d.PositionTitle")),
        seniority=seniority(c("d.PositionTitle")),
        salary_min=by_interval(pay["MinimumRange"], code, factors, ("WC",)),
        salary_max=by_interval(pay["MaximumRange"], code, factors, ("WC",)),
        salary_currency=F.lit("USD"),
        apply_url=F.coalesce(F.get("d.ApplyURI", F.lit(0)), c("d.PositionURI")), listing_url=c("d.PositionURI"),
        posted_at=dates.from_text(c("d.PublicationStartDate")),
    )


def socrata(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages, "socrata",
        "array<struct<job_id string, business_title string, civil_service_title string, agency string, "
        "career_level string, full_time_part_time_indicator string, salary_range_from string, "
        "salary_range_to string, salary_frequency string, work_location string, job_description string, "
        "minimum_qual_requirements string, posting_date string, posting_type string>>",
    )
    df = rows.withColumns(
        {
            "_title": F.coalesce("j.business_title", "j.civil_service_title"),
            "_host": F.get(F.split("board_token", r"\|"), F.lit(0)),
            "_set": F.get(F.split("board_token", r"\|"), F.lit(1)),
        }
    ).where(
        (F.length("_title") > 0) & (F.lower(F.coalesce("j.posting_type", F.lit(""))) != "internal")
    )
    often = F.lower(F.coalesce("j.salary_frequency", F.lit("")))
    factors = {"hour": SALARY_HOURS, "dai": SALARY_DAYS}
    # Fixed value: the one portal with its own job pages.
    portal = F.when(
        (c("_host") == "data.cityofnewyork.us") & (F.length("j.job_id") > 0),
        _text("https://cityjobs.nyc.gov/jobs?keywords=", _quote(c("j.job_id"))),
    )
    url = F.coalesce(portal, _text("https://", c("_host"), "/d/", c("_set")))
    return normalised(
        df, "socrata",
        external_id=F.coalesce("j.job_id", _text(c("_title"), "-", F.coalesce("j.agency", "_host"))),
        title=c("_title"),
        description=strip_html(join_parts("\n\n", c("j.job_description"), c("j.minimum_qual_requirements"))),
        location=c("j.work_location"), department=c("j.agency"),
        employment_type=F.when(c("j.full_time_part_time_indicator") == "P", "Part-time").otherwise("Full-time"),
        remote_type=resolved_remote_type(None, c("j.work_location"), c("_title")),
        seniority=seniority(c("_title"), c("j.career_level")),
        salary_min=by_interval(c("j.salary_range_from"), often, factors),
        salary_max=by_interval(c("j.salary_range_to"), often, factors),
        salary_currency=F.lit("USD"), apply_url=url, listing_url=url,
        posted_at=dates.from_text(c("j.posting_date")),
    )


def amazon(pages: DataFrame) -> DataFrame:
    rows = postings_of(
        pages.where(F.length(_extra("stateName")) > 0), "amazon",
        "jobs array<struct<id string, title string, normalized_location string, location string, state string, "
        "posted_date string, job_path string, description string, basic_qualifications string, "
        "preferred_qualifications string, business_category string, job_category string, is_intern boolean>>",
        "_b.jobs",
    )
    state = F.upper(_extra("state"))
    df = rows.withColumns({"_id": c("j.id"), "_title": trim_all(c("j.title"))}).where(
        c("_id").isNotNull()
        & (F.length("_title") > 0)
        & (state.isNull() | (state == "") | F.coalesce(F.upper("j.state") == state, F.lit(False)))
    )

    def section(name: str, heading: str) -> Column:
        return F.when(F.length(name) > 0, _text(f"<h3>{heading}</h3>", c(name)))

    html = F.array_join(
        F.filter(
            F.array(
                c("j.description"),
                section("j.basic_qualifications", "Basic qualifications"),
                section("j.preferred_qualifications", "Preferred qualifications"),
            ),
            present,
        ),
        "\n",
    )
    df = df.withColumn(
        "_place", non_empty(trim_all(F.coalesce("j.normalized_location", "j.location")))
    )
    url = F.when(F.length("j.job_path") > 0, _text("https://www.amazon.jobs", c("j.job_path")))
    return normalised(
        _first_of_board(df), "amazon",
        external_id=c("_id"), title=c("_title"), description=strip_html(html), location=c("_place"),
        department=F.coalesce(non_empty(c("j.business_category")), non_empty(c("j.job_category"))),
        remote_type=resolved_remote_type(None, c("_place"), c("_title")),
        seniority=F.when(c("j.is_intern"), "entry").otherwise(seniority(c("_title"))),
        apply_url=url, listing_url=url,
        posted_at=dates.from_text(F.regexp_replace("j.posted_date", r"\s+", " ")),
    )


def personio(pages: DataFrame) -> DataFrame:
    """XML feed; named sections of the description are joined under headings."""
    schema = (
        "position array<struct<id string, office string, additionalOffices struct<office array<string>>, "
        "department string, name string, jobDescriptions struct<jobDescription array<struct<name string, "
        "value string>>>, employmentType string, seniority string, schedule string, createdAt string>>"
    )
    parsed = pages.where(c("provider") == "personio").withColumn("_b", F.from_xml("body", schema))
    rows = parsed.select("board_token", "extra", "page", F.posexplode("_b.position").alias("pos", "j"))
    rows = rows.where((F.length("j.name") > 0) & c("j.id").isNotNull())
    html = F.array_join(
        F.transform(
            "j.jobDescriptions.jobDescription",
            lambda s: F.when(
                F.length(s["name"]) > 0,
                _text("<h3>", s["name"], "</h3>", F.coalesce(s["value"], F.lit(""))),
            ).otherwise(F.coalesce(s["value"], F.lit(""))),
        ),
        "\n",
    )
    offices = F.concat(
        F.array("j.office"), F.coalesce("j.additionalOffices.office", F.array().cast("array<string>"))
    )
    place = F.array_join(F.filter(offices, lambda o: F.coalesce(F.length(o) > 0, F.lit(False))), "; ")
    df = rows.withColumns({"_text": strip_html(html), "_place": non_empty(place)})
    domain = F.coalesce(_extra("domain"), F.lit("jobs.personio.de"))
    url = _text("https://", c("board_token"), ".", domain, "/job/", c("j.id"))
    return normalised(
        df, "personio",
        external_id=c("j.id"), title=c("j.name"), description=c("_text"), location=c("_place"),
        city=c("j.office"), department=c("j.department"),
        employment_type=join_parts(" / ", c("j.employmentType"), c("j.schedule")),
        remote_type=remote_type(None, c("_place"), c("j.name"), c("_text")),
        seniority=seniority(c("j.name"), c("j.seniority")), apply_url=url, listing_url=url,
        posted_at=dates.from_text(c("j.createdAt")),
    )


def _plain_text(value: Column) -> Column:
    decoded = F.regexp_replace(decode_entities(value), r"<[^>]*>", " ")
    return let(F.trim(F.regexp_replace(decoded, r"\s+", " ")), non_empty)


def icims(pages: DataFrame, location_as_text: bool = False) -> DataFrame:
    """Listing HTML, one posting per card; a card seen on an earlier page is skipped."""
    card_start = r'(?i)<li[^>]*class="[^"]*iCIMS_JobCardItem[^"]*"[^>]*>'
    html = pages.where(c("provider") == "icims")
    parts = F.slice(F.split("body", card_start), 2, 2**31 - 1)
    cards = html.select("board_token", "extra", "page", F.posexplode(parts).alias("pos", "_card"))
    cards = cards.withColumn("_card", F.substring_index("_card", "</li>", 1))

    def grab(pattern: str, group: int = 1) -> Column:
        return non_empty(F.regexp_extract("_card", "(?i)" + pattern, group))

    def header(label: str) -> Column:
        return _plain_text(
            grab(rf'field-label"[^>]*>\s*(?:{label})\s*</span>\s*<span[^>]*>([\s\S]*?)</span>')
        )

    def field(label: str) -> Column:
        return _plain_text(
            grab(rf'iCIMS_JobHeaderField"[^>]*>\s*{label}\s*</dt>\s*<dd[^>]*>([\s\S]*?)</dd>')
        )

    link = r'href="([^"]*/jobs/(\d+)/[^"]*)"'
    found = cards.where(c("board_token").isNotNull()).withColumn("_number", grab(link, 2)).where(c("_number").isNotNull())
    # each field is read off its card once: neither the filter nor the choice of the page reads it again
    df = computed(
        found,
        {
            "_url": decode_entities(grab(link)),
            "_title": _plain_text(grab(r"<h3[^>]*>([\s\S]*?)</h3>")),
            "_place": header("Job Locations?|Locations?"),
            "_text": _plain_text(
                grab(r'class="[^"]*\bdescription\b[^"]*"[^>]*>([\s\S]*?)</div>')
            ),
            "_id": F.coalesce(field("ID"), header("ID"), c("_number")),
            "_category": field("Category"),
            "_kind": F.coalesce(field("Job Type"), field("Type")),
        },
    ).where(c("_title").isNotNull()).drop("_card")
    first = F.min("page").over(Window.partitionBy("board_token", "_url"))
    df = df.withColumn("_first", first).where(c("page") == c("_first"))
    near = _text(c("_title"), " ", F.coalesce("_text", F.lit("")))
    return normalised(
        df, "icims",
        external_id=c("_id"), title=c("_title"), description=strip_html(c("_text")), location=c("_place"),
        remote_type=_slot_remote(c("_place"), near, location_as_text),
        seniority=seniority(c("_title")), department=c("_category"), employment_type=c("_kind"),
        apply_url=c("_url"), listing_url=c("_url"),
    )


def icims_page_count(html: Column) -> Column:
    n = F.regexp_extract(html, r"(?i)Page\s+\d+\s+of\s+(\d+)", 1).try_cast("int")
    return F.when(n > 0, n).otherwise(1)


# ------------------------------------------------------------------------ company names

# What a careers-site title says besides the company.
ORG_CODE = "^([0-9]{2,}|[A-Z]{1,3}[0-9]{3,})\\s*[-–]"
NOT_A_NAME = (
    r"^(page not found|not found|error|404|403|access denied|forbidden|unauthori[sz]ed|loading|untitled|"
    r"home|welcome|sign in|login|redirecting|service unavailable|maintenance|our vacancies|vacancies|"
    r"job search|all open jobs|open jobs|jobs and|current opportunities|opportunities|apply now|search jobs)\.?\z"
)
NAME_PREFIX = (
    "^\\s*((careers?|jobs?|work|working)\\s*((at|with|for)\\s+|[-|:·–—@]\\s*)|check\\s+out\\s+|"
    "find\\s+jobs\\s*[-–:]\\s*|site\\s+carri[eè]re\\s+(externe\\s+)?)"
)
SITE_BOILERPLATE = (
    "(?:^|[\\s|·—–-]+)(candidate\\s+experience(\\s+site)?|careers?\\s+site(\\s*-\\s*new)?|"
    "careers?\\s+(portal|home|page|website)|external\\s+(careers?|site)|external|all\\s+open\\s+jobs|"
    "open\\s+jobs|recommended\\s+jobs|job\\s+search|job\\s+listings(\\s*-\\s*global)?|"
    "(administrative\\s+)?jobs|staff\\s+positions|employment|"
    "(talent\\s+acquisition|recruitment)\\s+(site|team)|e-?recruitment\\s+system|vacancies|careers?|"
    "recruiting)\\s*\\z"
)
SITE_DESCRIPTOR = r"(\S)\s+((external\s+)?career\s+(sites?|section)\b.*|jobs\s+and)\z"
DANGLING = "[\\s|:·–—_-]+\\z"
BARE_WORDS = r"^(our|the|my|your|all|current|welcome to)\z"


def oracle_company(body: Column) -> Column:
    """Company from the organisations facet, unless it is an internal code."""
    name = trim_all(F.get_json_object(body, "$.items[0].organizationsFacet[0].Name"))
    return F.when((F.length(name) > 0) & ~name.rlike(ORG_CODE), name)


def company_from_title(html: Column) -> Column:
    """Company in a careers page title, NULL for error pages and bare words."""
    title = non_empty(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)</title>", 1))
    plain = F.trim(F.regexp_replace(decode_entities(title, 1), r"\s+", " "))
    return let(plain, _clean_company)


def _clean_company(title: Column) -> Column:
    def cut(text: Column, pattern: str, by: str = "") -> Column:
        return F.trim(F.regexp_replace(text, "(?iu)" + pattern, by))

    name = cut(cut(title, NAME_PREFIX), SITE_DESCRIPTOR, "$1")
    for _ in range(3):
        name = cut(name, SITE_BOILERPLATE)
    return F.when(~title.rlike("(?i)" + NOT_A_NAME), let(F.regexp_replace(name, DANGLING, ""), _if_name))


def _if_name(name: Column) -> Column:
    refused = name.rlike("(?i)" + NOT_A_NAME) | name.rlike(ORG_CODE) | name.rlike("(?i)" + BARE_WORDS)
    return F.when((F.length(name) >= 2) & ~refused, name)


def icims_company(html: Column) -> Column:
    title = non_empty(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]{2,})</title>", 1))
    clean = F.trim(F.regexp_replace(decode_entities(title), r"\s+", " "))
    name = F.trim(F.regexp_extract(clean, r"(?i)^.*job listings at (.*)\z", 1))
    return F.when(F.length(name) >= 2, name)


def eightfold_company(body: Column) -> Column:
    return non_empty(trim_all(F.get_json_object(body, "$.branding.companyName")))


READERS = {
    f.__name__: f
    for f in (
        greenhouse, lever, ashby, workable, smartrecruiters, breezy, oracle, eightfold, ukg, bamboohr,
        recruitee, teamtailor, rippling, usajobs, socrata, amazon, personio, icims,
    )
}


def read_all(pages: DataFrame, now: Column, providers: list[str] | None = None) -> DataFrame:
    """Every vendor's postings from one landing zone.

    Each reader filters on ``provider``; land pages partitioned by it and a reader only
    opens its own partition.
    """
    wanted = providers or ["workday", *READERS]
    frames = [workday(pages, now) if p == "workday" else READERS[p](pages) for p in wanted]
    return union_all(frames)
