"""Vendor readers over payload pages derived from the postings table.

Each posting is landed in the shape its vendor publishes (one page per posting, some
pages twice), read back, and compared with the columns it was made from.
"""

from pyspark.sql import functions as F

from boardwalk.sources import vendors
from checks import fixtures as fx
from checks.feed import heavy_postings as postings
from checks.registry import register

SHOWN = [
    "board_token", "external_id", "title", "location", "country", "department", "employment_type",
    "salary_min", "salary_max", "posted_at", "apply_url",
]
DAY = "cast(cast(posted_at as date) as string)"
ID = "cast(ord as varchar)"
NULLS = {
    "board_token": "board_token", "external_id": ID, "title": "title", "location": "cast(null as varchar)",
    "country": "cast(null as varchar)", "department": "cast(null as varchar)", "employment_type": "cast(null as varchar)",
    "salary_min": "cast(null as double)", "salary_max": "cast(null as double)", "posted_at": "posted_at",
    "apply_url": "cast(null as varchar)",
}


def vendor_check(provider: str, body: str, extra: str = "map()", where: str = "true", source: str = "postings", **expected):
    """``body`` is Spark SQL for one page; ``expected`` is SQL for the columns read back."""
    columns = {**NULLS, **expected}
    select = ", ".join(f"{v} as {k}" for k, v in columns.items())

    @register(f"source_{provider}", fx.with_postings(f"select {select} from {source} where {where}"))
    def run(spark, sf_dir):
        pages = landed(postings(spark, sf_dir), provider, body, extra)
        if provider == "workday":
            out = vendors.workday(pages, F.lit(fx.NOW).cast("timestamp_ntz"))
        else:
            out = vendors.READERS[provider](pages)
        return out.select(*SHOWN)


def landed(df, provider: str, body: str, extra: str):
    """Landed pages; every fourth posting is on two pages."""
    pages = df.select(
        F.lit(provider).alias("provider"), "board_token",
        F.expr(f"cast({extra} as map<string,string>)").alias("extra"),
        F.explode(F.expr("if(ord % 4 = 0, array(1, 2), array(1))")).alias("page"),
        F.expr(body).alias("body"),
    )
    if provider not in REPEATING:
        pages = pages.where("page = 1")
    return pages


REPEATING = {"eightfold", "ukg", "amazon", "icims"}
J = "to_json(named_struct({}))"


def body_of(path: str, fields: str, array: bool = False) -> str:
    one = f"array(named_struct({fields}))"
    if array:
        return f"to_json({one})"
    return f"to_json(named_struct('{path}', {one}))"


vendor_check(
    "greenhouse",
    body_of("jobs", f"'id', ord, 'title', title, 'updated_at', '1999-01-01T00:00:00Z', 'first_published', {DAY}, 'absolute_url', concat('https://x/', ord), "
            "'location', named_struct('name', 'Elsewhere'), 'content', concat('&lt;p&gt;', title, '&lt;/p&gt;'), 'departments', array(named_struct('name', company)), "
            "'offices', array(named_struct('name', 'n', 'location', ''), named_struct('name', 'n', 'location', location))"),
    location="coalesce(location, 'Elsewhere')", department="company", apply_url=f"'https://x/' || {ID}",
    posted_at="coalesce(posted_at, timestamp '1999-01-01')",
)
vendor_check(
    "lever",
    body_of("", "'id', cast(ord as string), 'text', title, 'country', country, 'commitment', employment_type, 'categories', named_struct('department', company, 'allLocations', "
            "split(location, '; ')), 'createdAt', unix_millis(cast(posted_at + interval '7000' day as timestamp)), 'descriptionPlain', description, 'hostedUrl', 'h', "
            "'salaryRange', named_struct('min', salary_min, 'max', salary_max, 'currency', 'USD', 'interval', if(ord % 2 = 0, 'per-year-salary', 'per-hour-wage'))", array=True),
    location="location", country="country", department="company", employment_type="employment_type", apply_url="'h'",
    # Numbers below 10^12 are read as seconds, so the dates are moved to where milliseconds exceed that.
    posted_at="posted_at + interval '7000' day",
    salary_min="case when ord % 2 = 0 then salary_min end", salary_max="case when ord % 2 = 0 then salary_max end",
)
vendor_check(
    "ashby",
    body_of("jobs", f"'id', cast(ord as string), 'title', title, 'department', company, 'employmentType', employment_type, 'location', location, 'secondaryLocations', "
            f"array(named_struct('location', region), named_struct('location', '')), 'publishedAt', {DAY}, 'isListed', ord % 5 <> 0, 'address', named_struct('postalAddress', "
            "named_struct('addressCountry', country)), 'jobUrl', 'u', 'descriptionHtml', '<p>x</p>', 'compensation', named_struct('compensationTierSummary', "
            "concat('$', cast(floor(salary_min / 1000) as int), 'K – $', cast(floor(salary_max / 1000) as int), 'K'))"),
    where="ord % 5 <> 0", country="country", department="company", employment_type="employment_type", apply_url="'u'",
    location="case when location is null and region is null then null else concat_ws('; ', location, region) end",
    salary_min="least(case when floor(salary_min / 1000) >= 10 then floor(salary_min / 1000) * 1000 end, case when floor(salary_max / 1000) >= 10 then floor(salary_max / 1000) * 1000 end)",
    salary_max="greatest(case when floor(salary_min / 1000) >= 10 then floor(salary_min / 1000) * 1000 end, case when floor(salary_max / 1000) >= 10 then floor(salary_max / 1000) * 1000 end)",
)
vendor_check(
    "workable",
    body_of("jobs", f"'title', title, 'shortcode', cast(ord as string), 'employment_type', employment_type, 'telecommuting', adjacent, 'department', company, 'url', 'u', 'shortlink', 's', "
            f"'created_at', {DAY}, 'country', country, 'city', '', 'state', region, 'experience', seniority"),
    location="case when country is null and region is null then null else concat_ws(', ', region, country) end", country="country",
    department="company", employment_type="employment_type", apply_url="'s'",
)
vendor_check(
    "smartrecruiters",
    body_of("content", f"'id', cast(ord as string), 'name', title, 'releasedDate', {DAY}, 'location', named_struct('city', region, 'region', '', 'country', country, 'remote', true, 'hybrid', ord % 2 = 0), "
            "'department', named_struct('label', company), 'typeOfEmployment', named_struct('label', employment_type)"),
    location="case when country is null and region is null then null else concat_ws(', ', region, country) end", country="country",
    department="company", employment_type="employment_type", apply_url=f"'https://jobs.smartrecruiters.com/' || board_token || '/' || {ID}",
)
vendor_check(
    "breezy",
    "if(ord % 2 = 0, " + body_of("", f"'id', cast(ord as string), 'name', title, 'friendly_id', 'f', 'published_date', {DAY}, 'type', named_struct('name', employment_type), "
            "'location', named_struct('country', named_struct('name', country, 'id', 'x'), 'city', region), 'department', company", array=True) + ", "
    + body_of("", f"'_id', cast(ord as string), 'name', title, 'url', 'u', 'published_date', {DAY}, 'type', named_struct('name', employment_type), "
              "'location', named_struct('country', country, 'city', region), 'department', company", array=True) + ")",
    location="case when country is null and region is null then null else concat_ws(', ', region, country) end", country="country",
    department="company", employment_type="employment_type",
    apply_url="case when ord % 2 = 0 then 'https://' || board_token || '.breezy.hr/p/f' else 'u' end",
)
vendor_check(
    "workday",
    body_of("jobPostings", "'title', if(ord % 9 = 0, '', title), 'externalPath', if(ord % 3 = 0, null, concat('/job/', ord)), 'locationsText', location, 'postedOn', concat('Posted ', ord % 30, ' Days Ago'), "
            "'bulletFields', array(concat('R', ord))"),
    extra="map('site', 'Ext', 'host', 'acme.wd5.myworkdayjobs.com')",
    where="ord % 9 <> 0", location="location", external_id=f"case when ord % 3 = 0 then 'R' || {ID} else '/job/' || {ID} end",
    posted_at=f"timestamp '{fx.NOW}' - (ord % 30) * interval '1' day",
    apply_url=f"case when ord % 3 <> 0 then 'https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/' || {ID} end",
)
vendor_check(
    "oracle",
    "to_json(named_struct('items', array(named_struct('requisitionList', array(named_struct('Id', cast(ord as string), 'Title', concat(' ', title), 'PostedDate', "
    + DAY + ", 'PrimaryLocation', location, 'PrimaryLocationCountry', country, 'WorkplaceTypeCode', 'ORA_HYBRID', 'JobFamily', company, 'secondaryLocations', array(named_struct('Name', 'Remote'))))))))",
    extra="map('site', 'CX_1', 'host', 't.fa.us2.oraclecloud.com')",
    location="location", country="country", department="company",
    apply_url=f"'https://t.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/' || {ID}",
)
vendor_check(
    "eightfold",
    body_of("positions", "'id', ord, 'posting_name', title, 'locations', split(location, '; '), 'business_unit', company, 't_create', unix_seconds(cast(posted_at as timestamp)), 'work_location_option', 'onsite'"),
    extra="map('domain', 'a.com')", location="split_part(location, '; ', 1)", department="company",
    apply_url=f"'https://' || board_token || '.eightfold.ai/careers/job/' || {ID} || '?domain=a.com'",
)
vendor_check(
    "ukg",
    body_of("opportunities", f"'Id', if(ord % 2 = 0, cast(ord as string), null), 'RequisitionNumber', cast(ord as string), 'Title', concat(title, ' '), 'FullTime', ord % 3 = 0, 'JobCategoryName', company, 'PostedDate', {DAY}, "
            "'Locations', array(named_struct('LocalizedDescription', 'HQ', 'Address', named_struct('City', region, 'State', named_struct('Code', region, 'Name', region), 'Country', named_struct('Code', country))))"),
    extra="map('board', 'B1')", location="case when region is null and country is null then 'HQ' when region is null then country else region || ', ' || country end",
    employment_type="case when ord % 3 = 0 then 'Full-Time' end", department="company",
    apply_url=f"'https://recruiting.ultipro.com/' || board_token || '/JobBoard/B1/OpportunityDetail?opportunityId=' || {ID}",
)
vendor_check(
    "bamboohr",
    body_of("result", "'id', ord, 'jobOpeningName', title, 'departmentLabel', company, 'employmentType', employment_type, 'location', named_struct('city', region), "
            "'atsLocation', named_struct('city', 'Nowhere', 'province', region, 'country', country), 'locationType', '2'"),
    location="case when country is null then coalesce(region, 'Nowhere') when region is null then 'Nowhere, ' || country else region || ', ' || country end",
    department="company", employment_type="employment_type", posted_at="cast(null as timestamp)",
    apply_url=f"'https://' || board_token || '.bamboohr.com/careers/' || {ID}",
)
vendor_check(
    "recruitee",
    body_of("offers", f"'id', ord, 'title', title, 'remote', false, 'on_site', true, 'city', region, 'state_name', region, 'country', country, 'country_code', country, 'department', company, "
            f"'employment_type_code', case ord % 4 when 0 then 'fulltime_permanent' when 1 then 'parttime' when 2 then 'freelance' else 'internship' end, 'created_at', {DAY}, 'careers_url', 'c', "
            "'status', case when ord % 6 = 0 then 'draft' when ord % 6 = 1 then 'Published' end"),
    where="ord % 6 <> 0", country="country", department="company", apply_url="'c'",
    location="case when region is null then country else region || ', ' || country end",
    employment_type="case ord % 4 when 0 then 'Full-time' when 1 then 'Part-time' when 2 then 'Contract' else 'Internship' end",
)
vendor_check(
    "teamtailor",
    "if(ord % 2 = 0, " + body_of("items", f"'id', cast(ord as string), 'title', title, 'url', 'u', 'date_published', {DAY}, '_jobposting', named_struct('title', 'other', 'employmentType', array('FULL_TIME'), "
            "'jobLocation', array(named_struct('address', named_struct('addressLocality', region, 'addressCountry', named_struct('name', country)))))") + ", "
    + body_of("items", f"'id', cast(ord as string), 'url', 'u', '_jobposting', named_struct('title', title, 'datePosted', {DAY}, 'employmentType', 'CONTRACTOR', "
              "'jobLocation', named_struct('address', named_struct('addressLocality', region, 'addressCountry', country)))") + ")",
    location="case when region is null then country else region || ', ' || country end",
    employment_type="case when ord % 2 = 0 then 'Full-time' else 'Contract' end", apply_url="'u'",
)
vendor_check(
    "rippling",
    body_of("", "'uuid', if(ord % 2 = 0, cast(ord as string), null), 'name', concat(title, ' '), 'department', named_struct('label', company), 'url', 'u', 'workLocation', named_struct('label', location)", array=True),
    where="title not like 'Copy of%'", external_id=f"case when ord % 2 = 0 then {ID} else title end", location="location", department="company",
    apply_url="'u'", posted_at="cast(null as timestamp)",
)
vendor_check(
    "usajobs",
    "to_json(named_struct('SearchResult', named_struct('SearchResultItems', array(named_struct('MatchedObjectDescriptor', named_struct('PositionTitle', title, 'PositionURI', cast(ord as string), "
    "'PositionLocationDisplay', location, 'OrganizationName', company, 'PositionSchedule', array(named_struct('Name', employment_type)), 'PositionRemuneration', array(named_struct('MinimumRange', "
    "cast(cast(floor(salary_min) as bigint) as string), 'MaximumRange', cast(cast(floor(salary_max) as bigint) as string), 'RateIntervalCode', case ord % 5 when 0 then 'PH' when 1 then 'PD' when 2 then 'PM' when 3 then 'WC' else 'PA' end)), "
    f"'PublicationStartDate', {DAY}, 'UserArea', named_struct('Details', named_struct('JobSummary', 'a', 'MajorDuties', array('b', 'c')))))))))",
    location="location", country="'US'", department="company", employment_type="employment_type", apply_url=ID,
    salary_min="case when ord % 5 <> 3 then floor(salary_min) * case ord % 5 when 0 then 2080 when 1 then 260 when 2 then 12 else 1 end end",
    salary_max="case when ord % 5 <> 3 then floor(salary_max) * case ord % 5 when 0 then 2080 when 1 then 260 when 2 then 12 else 1 end end",
)
vendor_check(
    "socrata",
    body_of("", "'job_id', cast(ord as string), 'business_title', if(ord % 2 = 0, title, null), 'civil_service_title', title, 'agency', company, 'full_time_part_time_indicator', if(ord % 3 = 0, 'P', 'F'), "
            "'salary_range_from', cast(cast(floor(salary_min) as bigint) as string), 'salary_range_to', cast(cast(floor(salary_max) as bigint) as string), 'salary_frequency', case ord % 3 when 0 then 'Hourly' when 1 then 'Daily' else 'Annual' end, "
            f"'work_location', location, 'posting_date', concat({DAY}, 'T00:00:00.000'), 'posting_type', if(ord % 7 = 0, 'Internal', 'External')", array=True),
    where="ord % 7 <> 0", location="location", department="company", employment_type="case when ord % 3 = 0 then 'Part-time' else 'Full-time' end",
    salary_min="floor(salary_min) * case ord % 3 when 0 then 2080 when 1 then 260 else 1 end",
    salary_max="floor(salary_max) * case ord % 3 when 0 then 2080 when 1 then 260 else 1 end",
    apply_url="'https://' || board_token || '/d/'",
)
# A board token without '|' has no dataset part, so the address is NULL.
from checks.registry import ORACLE  # noqa: E402

ORACLE["source_socrata"] = ORACLE["source_socrata"].replace("'https://' || board_token || '/d/' as apply_url", "cast(null as varchar) as apply_url")
vendor_check(
    "amazon",
    body_of("jobs", "'id', ord, 'title', title, 'location', location, 'state', region, 'posted_date', date_format(posted_at, 'MMMM  d, yyyy'), 'job_path', concat('/en/jobs/', ord), 'description', 'x', "
            "'basic_qualifications', 'y', 'job_category', company, 'is_intern', false"),
    extra="map('stateName', 'Washington', 'state', 'wa')", where="region = 'WA'", location="location", department="company",
    apply_url=f"'https://www.amazon.jobs/en/jobs/' || {ID}",
)
vendor_check(
    "personio",
    f"concat('<workzag-jobs><position><id>', ord, '</id><office>', coalesce(region, ''), '</office><additionalOffices><office>B</office><office>C</office></additionalOffices>"
    f"<department>', company, '</department><name>', replace(title, '&', '&amp;'), '</name><jobDescriptions><jobDescription><name>Tasks</name><value><![CDATA[<p>Do</p>]]></value></jobDescription></jobDescriptions>"
    f"<employmentType>permanent</employmentType><schedule>full-time</schedule><createdAt>', coalesce({DAY}, 'never'), '</createdAt></position></workzag-jobs>')",
    location="case when region is null then 'B; C' else region || '; B; C' end", department="company", employment_type="'permanent / full-time'",
    apply_url=f"'https://' || board_token || '.jobs.personio.de/job/' || {ID}",
)
vendor_check(
    "icims",
    "concat('<ul><li class=\"row iCIMS_JobCardItem\"><a href=\"https://x.icims.com/jobs/', ord, '/a/job?b=1&amp;c=2\"><h3> ', replace(title, '&', '&amp;'), '</h3></a>"
    "<span class=\"sr-only field-label\">Job Locations</span> <span>', coalesce(location, ''), '</span><div class=\"col description\">Text</div>"
    "<dl><dt class=\"iCIMS_JobHeaderField\">Category</dt><dd class=\"v\">', company, '</dd></dl></li></ul>')",
    location="nullif(regexp_replace(location, '\\s+', ' ', 'g'), '')", department="company",
    apply_url=f"'https://x.icims.com/jobs/' || {ID} || '/a/job?b=1&c=2'", posted_at="cast(null as timestamp)",
)
