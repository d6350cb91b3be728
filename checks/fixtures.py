"""Posting tables derived from the driver's parquet.

The derivation is SQL text that Spark and DuckDB both read, so both sides of a
check start from the same rows.  It grows with ``orders``.
"""


NOW = "2001-08-02 00:00:00"
WIDE_DAYS = 365
SNAPSHOT_FAMILIES = ["cloud", "software", "data", "hris", "testing", "networking"]
SNAPSHOT_COUNTRIES = ["US"]

# title, family, specialization, skills (comma separated)
TITLES = [
    ("Senior Software Engineer", "software", "general_software", "Python,APIs"),
    ("Backend Engineer (Python)", "software", "backend", "Python,Python Web,Databases"),
    ("Front-End Developer", "software", "frontend", "JS/TS,Frontend FW,Web UI"),
    ("Full-Stack Engineer", "software", "fullstack", "Python,JS/TS,Frontend FW"),
    ("iOS Engineer", "software", "mobile", ""),
    ("Embedded Firmware Engineer", "software", "embedded_systems", "Linux"),
    ("Engineering Manager, Payments", "software", None, "APIs"),
    ("Salesforce Developer", "software", "application_integration", "Other Backend"),
    ("DevOps Engineer", "cloud", "devops_sre", "AWS,Kubernetes,Terraform"),
    ("Staff Site Reliability Engineer", "cloud", "devops_sre", "Kubernetes,Observability"),
    ("Platform Engineering Lead", "cloud", "platform_engineering", "Kubernetes,Helm,GitOps"),
    ("Cloud Security Architect", "cloud", "cloud_security", "AWS,Cloud Security"),
    ("Systems Administrator", "cloud", "systems_storage", "Windows/AD,Linux"),
    ("Production Engineer", "cloud", None, "Linux"),
    ("Mechanical Production Engineer", None, None, ""),
    ("Border Security Engineer", None, None, ""),
    ("Azure Integration Developer", "cloud", "cloud_infrastructure", "Azure"),
    ("GCP Instructor", None, None, ""),
    ("Data Engineer", "data", "data_engineering", "SQL,Big Data,Orchestration"),
    ("Principal Data Scientist", "data", "data_science", "Python Data,ML Frameworks"),
    ("Machine Learning Engineer", "data", "ml_engineering", "ML Frameworks,MLOps,Python"),
    ("MLOps Engineer", "data", "mlops", "MLOps,Kubernetes"),
    ("Junior Data Analyst - Reporting", "data", "analytics_bi", "SQL,BI Tools"),
    ("Database Administrator II", "data", "database_administration", "SQL,Databases"),
    ("Workday HCM Analyst", "hris", "workday", "Workday,HRIS/HCM"),
    ("Payroll Systems Specialist", "hris", "payroll_benefits", "Payroll/HRIS"),
    ("Workday Financials Consultant", "hris", None, "Workday"),
    ("People Analytics Manager", "hris", "general_hris", ""),
    ("QA Automation Engineer", "testing", "test_automation", "Testing"),
    ("Hardware Test Engineer", None, None, ""),
    ("Performance Test Engineer", "testing", "performance_testing", ""),
    ("Network Engineer", "networking", "network_engineering", "Networking"),
    ("NOC Technician", "networking", "network_operations", "Networking"),
    ("Neural Network Specialist", "unsorted", None, ""),
    ("Sales Engineer", None, None, ""),
    ("Technical Program Manager", "software", None, ""),
    ("Solutions Engineer", "cloud", None, "Kubernetes,Terraform"),
    ("GTM Engineer", "software", None, "Python"),
    ("Developer Advocate (Remote)", "software", None, "JS/TS"),
    ("IT Systems Engineer", "cloud", None, "Windows/AD"),
    ("Registered Nurse", None, None, ""),
    ("Marketing Manager", None, None, ""),
    ("Warehouse Controller Software Engineer", "software", "general_software", "Java"),
    ("Security Officer", None, None, ""),
    ("Forensics Technology Consultant", "unsorted", None, ""),
    ("Copy of Data Engineer", None, None, ""),
    ("Software Engineering Intern", None, None, ""),
    ("Ingénieur DevOps – Montréal", "cloud", "devops_sre", "Docker"),
    ("Customer Success Manager", None, None, ""),
    ("HRIS Implementation Consultant", "hris", "general_hris", "HRIS/HCM"),
    ("Landscape Architect", None, None, ""),
    ("Lead Engineer, Chemical Plants", None, None, ""),
    ("Applied AI Engineer", "software", "general_software", "LLM Tooling,Python"),
]

# location as published, country, region
LOCATIONS = [
    ("Seattle, WA", "US", "WA"),
    ("Spokane, WA; Tacoma, WA; Olympia, WA", "US", "WA"),
    ("Washington, DC", "US", "DC"),
    ("US-DC-Washington", "US", "DC"),
    ("Albuquerque, New Mexico", "US", "NM"),
    ("Mexico City", "MX", None),
    ("Pune, IN", "IN", None),
    ("Fort Wayne, IN", "US", "IN"),
    ("Vienna, Virginia, United States", "US", "VA"),
    ("Vienna", "AT", None),
    ("London, United Kingdom", "GB", None),
    ("Berlin, Germany; Munich, Germany", "DE", None),
    ("Zürich", "CH", None),
    ("Panamá City", None, None),
    ("Remote - US", "US", None),
    ("Remote", None, None),
    ("Hybrid - Austin, TX 78701", "US", "TX"),
    ("7000 Target Pkwy N,NCD-0375 Brooklyn Park,MN 55445", "US", "MN"),
    ("Bengaluru, Karnataka 560103", "IN", None),
    ("Multiple Locations", None, None),
    ("Paris, TX", "US", "TX"),
    ("Toronto, Ontario, Canada", "CA", None),
    (None, None, None),
]

# Three short tables, combined by different remainders, make a description.
ABOUT_PAY = [
    "The salary range is $150,000 - $190,000 per year.",
    "Base pay between $62.50 and $75 per hour, depending on experience.",
    "We raised a $50M Series C. Compensation: 120k to 150k USD annually.",
    "Annual compensation of £70,000 for the right person.",
    "Pay: €4,500 to €6,000 per month, plus equity.",
    "Our revenue is $10 million. Benefits include a 401(k) match.",
    "Salary: $12 - $900,000.",
    "Minimum of 5 years of experience; at least 3 years with Kubernetes.",
    "Founded over 25 years ago. 2+ years of relevant experience required.",
    "10+ years in industry experience and expertise in fine tuning models.",
    "Great for a recent graduate; entry-level applicants welcome.",
    "Requires a minimum of 8 years building services.",
    "",
]
ABOUT_WORK = [
    "You will run Kubernetes, Terraform and AWS with Prometheus and Grafana on Linux.",
    "You will build Spark and Airflow pipelines into Snowflake with dbt and SQL dashboards in Tableau.",
    "You will write Python services with Django, FastAPI, Postgres, Redis and REST APIs.",
    "You will ship React, TypeScript and CSS with our design system and accessibility team.",
    "You will train PyTorch models, fine-tune an LLM and track them in MLflow on SageMaker.",
    "You will configure Workday, run open enrollment and own payroll processing.",
    "You will test with Selenium, Cypress and Playwright and write a test plan for every regression test.",
    "You will operate BGP, OSPF and VPN firewalls from Cisco and Palo Alto, with SD-WAN.",
    "You will be on call, own the SLO and error budget, and lead incident response with Jenkins.",
    "Please send a cover letter and a portfolio. TS/SCI clearance required.",
    "This is a general application to our talent pool; we are always accepting people.",
    "A staffing agency role with multiple positions for various clients, COBOL and mainframe.",
    "Fully remote; occasional hybrid meetups.",
    "There is no remote work: this role is on-site in the office.",
    "Work with the naïve café crowd in São Paulo: C# and .NET, golang, Java Spring Boot.",
    "",
    "Linux, Docker, Windows Server, Active Directory, VMware and Intune administration.",
]
ABOUT_US = [
    "Our university serves undergraduate and postgraduate students; faculty governance matters.",
    "Our hospital gives bedside care; our patients come first across the health system.",
    "We are a registered charity and 501(c)(3); our donors fund the work.",
    "The City of Los Angeles offers classified service under the merit system.",
    "Money is correct and users are never misled about the state of their funds.",
    "A venture-backed start-up: our platform serves hospitals.",
    "We follow the City of Los Angeles Fair Chance Initiative for Hiring Ordinance. We bake bread.",
    "Our museum has scientific staff and a principal investigator for every research grant.",
    "At the academic medical center of our university, faculty teach at the bedside.",
    "We make software and enjoy it.",
    "",
]


def _text(value) -> str:
    return "cast(null as string)" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join(
        "(" + ", ".join([str(i), *(_text(v) for v in row)]) + ")" for i, row in enumerate(rows)
    )


def postings_sql(dialect: str) -> str:
    """The postings table over views orders, customer and nation."""
    if dialect == "spark":
        skills = "case when t.skills = '' then cast(array() as array<string>) else split(t.skills, ',') end"
    else:
        skills = "case when t.skills = '' then cast([] as varchar[]) else string_split(t.skills, ',') end"
    return f"""
select
  p.provider || ':' || p.board_token || ':' || cast(p.o_orderkey as string) as key,
  p.provider, p.board_token, p.o_orderkey as ord, p.c_name as company,
  t.title, t.family, t.specialization,
  l.location, l.country, l.region,
  case p.o_orderpriority when '1-URGENT' then 'fully_remote' when '2-HIGH' then 'hybrid'
    when '3-MEDIUM' then 'on_site' end as remote_type,
  case p.o_orderkey % 7 when 0 then 'entry' when 1 then 'senior' when 2 then 'staff'
    when 3 then 'lead' when 4 then 'mid' end as seniority,
  case p.o_orderkey % 4 when 0 then 'Full-Time' when 1 then 'Part time' when 2 then 'CONTRACT' end
    as employment_type,
  case when p.o_orderkey % 3 <> 0 then p.o_totalprice end as salary_min,
  case when p.o_orderkey % 3 <> 0 then p.o_totalprice * 1.2 end as salary_max,
  case p.n_regionkey when 0 then 'USD' when 1 then 'EUR' when 2 then 'INR' when 4 then 'GBP' end
    as salary_currency,
  case when p.o_orderkey % 11 <> 0 then p.o_orderdate end as posted_at,
  p.o_orderdate + (p.o_orderkey % 4) * interval '1' day as first_seen_at,
  case when p.o_orderstatus = 'F' and p.o_orderkey % 2 = 0 then p.o_orderdate + interval '10' day end
    as closed_at,
  p.o_orderkey % 13 = 0 as adjacent,
  p.o_orderkey % 9 = 0 as ai,
  p.o_orderkey % 5 <> 0 as quiet,
  case p.o_orderkey % 8 when 0 then 'education' when 1 then 'health' when 2 then 'government' end
    as sector,
  cast(p.o_orderkey % 10 as double) / 10 as ghost_risk,
  {skills} as matched_skills,
  case when p.o_orderkey % 17 <> 0 then a.pay || ' ' || w.work || ' ' || u.us end as description
from (
  select o.*, c.c_name, n.n_regionkey,
    case o_orderkey % 6 when 0 then 'greenhouse' when 1 then 'lever' when 2 then 'workday'
      when 3 then 'ukg' when 4 then 'icims' else 'ashby' end as provider,
    'c' || cast(o_custkey % 50 as string) as board_token
  from orders o
  join customer c on c.c_custkey = o.o_custkey
  join nation n on n.n_nationkey = c.c_nationkey
) p
join (values {_values(TITLES)}) as t(i, title, family, specialization, skills)
  on t.i = p.o_orderkey % {len(TITLES)}
join (values {_values(LOCATIONS)}) as l(i, location, country, region)
  on l.i = p.o_custkey % {len(LOCATIONS)}
join (values {_values([(x,) for x in ABOUT_PAY])}) as a(i, pay) on a.i = p.o_orderkey % {len(ABOUT_PAY)}
join (values {_values([(x,) for x in ABOUT_WORK])}) as w(i, work) on w.i = p.o_custkey % {len(ABOUT_WORK)}
join (values {_values([(x,) for x in ABOUT_US])}) as u(i, us) on u.i = p.o_orderkey % {len(ABOUT_US)}
"""


# One crawl result per event; a board is a user, a run is a day.
OUTCOMES_SQL = """
select event_id, ts,
  'p' || cast(user_id % 5 as string) as provider,
  'b' || cast(user_id as string) as token,
  cast(floor(value) as int) as jobs,
  case when event_type = 'error' then
    'p' || cast(user_id % 5 as string) || '/b' || cast(user_id as string) || ': HTTP ' ||
    case when value > 150 then '404' else '429' end end as error,
  case when event_type = 'error' then case when value > 150 then 'gone' else 'refused' end end
    as failure
from events
"""

# Seen and applied marks; the latest mark of a user on a posting counts.
MARKS_SQL = """
select 'u' || cast(user_id % 20 as string) as user_id,
  'k' || cast(event_id % 500 as string) as job_key,
  event_type in ('purchase', 'view', 'click') as seen,
  event_type = 'purchase' as applied, ts as at, event_id
from events
"""


def read(spark, sf_dir: str, *names: str):
    frames = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames


def from_sql(spark, sf_dir: str, sql: str, *names: str, spread_first: bool = False):
    """Run SQL over driver tables without leaving views behind.

    ``spread_first`` spreads the first table over all cores for costly rules.
    """
    frames = {n: read(spark, sf_dir, n) for n in names}
    if spread_first:
        frames[names[0]] = frames[names[0]].repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(sql_with_frames(sql, names), **frames)


def sql_with_frames(sql: str, names) -> str:
    """Point table names at named frames, keeping their aliases."""
    import re

    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = re.sub(rf"\b(from|join)\s+{n}\b(?=\s+[a-z]\b)", rf"\1 {{{n}}}", sql)
        sql = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}} as {n}", sql)
    return sql


def postings(spark, sf_dir: str, spread_first: bool = False):
    return from_sql(
        spark, sf_dir, postings_sql("spark"), "orders", "customer", "nation", spread_first=spread_first
    )


def outcomes(spark, sf_dir: str):
    return from_sql(spark, sf_dir, OUTCOMES_SQL, "events")


def marks(spark, sf_dir: str):
    return from_sql(spark, sf_dir, MARKS_SQL, "events")


def with_postings(sql: str) -> str:
    """Check SQL that reads ``postings``."""
    return f"with postings as materialized ({postings_sql('duck')})\n{sql}"


def with_postings_cte(ctes: str, sql: str) -> str:
    return f"with postings as materialized ({postings_sql('duck')}),\n{ctes}\n{sql}"


def with_outcomes(ctes: str, sql: str) -> str:
    extra = f",\n{ctes}" if ctes else ""
    return f"with outcomes as ({OUTCOMES_SQL}){extra}\n{sql}"


def with_marks(sql: str) -> str:
    return f"with marks as ({MARKS_SQL})\n{sql}"
