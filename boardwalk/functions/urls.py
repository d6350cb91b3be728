"""Job-board addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwalk.functions.match import let, matches, non_empty
from boardwalk.functions.text import looks_like_id, titleise
from boardwalk.rules import urls as rules

BOARD_TYPE = "struct<provider:string,token:string,extra:map<string,string>>"


def _segment(path: Column, index: int) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: F.length(p) > 0)
    return F.try_url_decode(F.get(parts, F.lit(index)))


def _subdomain(host: Column, suffix: str) -> Column:
    label = F.substring(host, F.lit(1), F.length(host) - len(suffix))
    label = F.regexp_replace(label, r"\.\z", "")
    return F.when(F.endswith(host, F.lit(suffix)) & (F.length(label) > 0) & (label != "www"), label)


def _query(url: Column, name: str) -> Column:
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def resolve_url(url: Column) -> Column:
    """struct(status, platform, tier, provider, token, extra, host) of an apply link."""
    return let(url, _resolve)


def _resolve(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.try_parse_url(url, F.lit("PATH"))
    return let(
        F.struct(host.alias("host"), path.alias("path"), url.alias("url")), _resolve_parts
    )


def _resolve_parts(u: Column) -> Column:
    host, path, url = u["host"], u["path"], u["url"]
    no_extra = F.lit(None).cast("map<string,string>")

    def board(provider: str, token: Column, extra: Column = no_extra) -> Column:
        return F.when(
            F.length(token) > 0,
            F.struct(
                F.lit(provider).alias("provider"), token.alias("token"), extra.alias("extra")
            ),
        )

    icims = _subdomain(host, ".icims.com")
    parts = F.filter(F.split(path, "/"), lambda p: F.length(p) > 0)
    at = F.array_position(parts, F.lit("sites")).cast("int")
    site = F.when(at > 0, F.get(parts, at))
    tenant = F.get(F.split(host, r"\."), F.lit(0))
    oracle_host = host.rlike(r"\.fa\.[a-z0-9-]+\.oraclecloud\.com\z")
    domain = F.lower(_query(url, "domain"))
    eightfold = _subdomain(host, ".eightfold.ai")
    hit = F.coalesce(
        board(
            "greenhouse",
            F.when(host.rlike(r"(^|\.)(boards|job-boards)\.greenhouse\.io\z"), _segment(path, 0))
            .when(host == "boards-api.greenhouse.io", _segment(path, 3)),
        ),
        board(
            "lever",
            F.when(host == "jobs.lever.co", _segment(path, 0))
            .when(host == "api.lever.co", _segment(path, 2)),
        ),
        board(
            "ashby",
            F.when(host == "jobs.ashbyhq.com", _segment(path, 0))
            .when(host == "api.ashbyhq.com", _segment(path, 2)),
        ),
        board(
            "workable",
            F.when(
                host == "apply.workable.com",
                F.when(_segment(path, 0) == "api", _segment(path, 4)).otherwise(_segment(path, 0)),
            ),
        ),
        board(
            "icims",
            F.when(icims != "careers", F.regexp_replace(icims, r"^(careers|jobs)-", "")),
        ),
        board(
            "smartrecruiters",
            F.when(host.rlike(r"(^|\.)(jobs|careers)\.smartrecruiters\.com\z"), _segment(path, 0))
            .when(host == "api.smartrecruiters.com", _segment(path, 2)),
        ),
        board(
            "oracle",
            F.when(oracle_host & (F.length(site) > 0), tenant),
            F.create_map(F.lit("host"), host, F.lit("site"), site),
        ),
        board(
            "eightfold",
            F.when(F.length(domain) > 0, eightfold),
            F.create_map(F.lit("domain"), domain, F.lit("site"), domain),
        ),
        board("breezy", _subdomain(host, ".breezy.hr")),
        board(
            "personio",
            F.coalesce(_subdomain(host, ".jobs.personio.de"), _subdomain(host, ".jobs.personio.com")),
        ),
    )
    return let(hit, lambda b: _verdict(b, host, url))


def _has_param(url: Column, *names: str) -> Column:
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.coalesce(query.rlike(r"(^|&)(" + "|".join(names) + r")(=|&|\z)"), F.lit(False))


def _verdict(b: Column, host: Column, url: Column) -> Column:
    platform = F.when(_has_param(url, "gh_jid", "gh_src"), "greenhouse_embedded").when(
        _has_param(url, "lever-origin"), "lever_embedded"
    )
    tier = F.when(platform.isNotNull(), "json_api_unbuilt")
    known_platform = known_tier = None
    for pattern, name, level in rules.KNOWN_UNSUPPORTED:
        hit = matches(host, pattern, ignore_case=False)
        known_platform = F.when(hit, name) if known_platform is None else known_platform.when(hit, name)
        known_tier = F.when(hit, level) if known_tier is None else known_tier.when(hit, level)
    platform = F.coalesce(b["provider"], platform, known_platform)
    tier = F.coalesce(F.when(b.isNotNull(), "supported"), tier, known_tier, F.lit("unknown"))
    status = (
        F.when(b.isNotNull(), "supported")
        .when(platform.isNotNull(), "unsupported")
        .otherwise("unknown")
    )
    return F.struct(
        status.alias("status"),
        platform.alias("platform"),
        tier.alias("tier"),
        b["provider"].alias("provider"),
        b["token"].alias("token"),
        b["extra"].alias("extra"),
        F.coalesce(host, url).alias("host"),
    )


WORKDAY_URL = (
    r"https?://([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:([a-z]{2}-[A-Z]{2})/)?([A-Za-z0-9_-]+)"
)


def workday_board(url: Column) -> Column:
    """Board of a Workday careers address, NULL for reserved site names."""
    def part(i: int) -> Column:
        return F.regexp_extract(url, WORKDAY_URL, i)

    site = part(4)
    usable = (F.length(site) > 0) & ~matches(site, r"^(wday|en|login|home)$")
    return F.when(
        usable,
        F.struct(
            F.lit("workday").alias("provider"),
            part(1).alias("token"),
            F.create_map(
                F.lit("host"), F.concat(part(1), F.lit("."), part(2), F.lit(".myworkdayjobs.com")),
                F.lit("site"), site,
                F.lit("locale"), F.coalesce(non_empty(part(3)), F.lit("en-US")),
            ).alias("extra"),
        ),
    )


def board_site(extra: Column) -> Column:
    return F.coalesce(F.element_at(extra, "site"), F.lit(""))


def board_identity(provider: Column, token: Column, extra: Column) -> Column:
    """One board however its token or site is spelled."""
    return F.concat_ws(":", provider, F.lower(token), F.lower(board_site(extra)))


def archive_board(url: Column, pattern_index: int) -> Column:
    """Board an archived URL belongs to under one pattern, else NULL."""
    provider, match, pattern, ignore_case = rules.PATTERNS[pattern_index]
    regex = ("(?i)" if ignore_case else "") + pattern

    def part(i: int) -> Column:
        return non_empty(F.regexp_extract(url, regex, i))

    def reserved(c: Column) -> Column:
        return matches(c, rules.NOT_A_TOKEN)

    def board(token: Column, usable: Column, extra: Column | None = None) -> Column:
        extra = F.lit(None).cast("map<string,string>") if extra is None else extra
        return F.when(
            F.length(token).isNotNull() & usable,
            F.struct(
                F.lit(provider).alias("provider"),
                token.alias("token"),
                titleise(token).alias("company"),
                extra.alias("extra"),
            ),
        )

    def extras(**kw: Column) -> Column:
        return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v)])

    if provider == "oracle":
        host, site = part(1), part(2)
        tenant = F.get(F.split(host, r"\."), F.lit(0))
        return board(tenant, site.isNotNull() & ~reserved(site), extras(host=host, site=site))
    if provider == "icims":
        host = F.lower(part(1))
        name = F.get(F.split(host, r"\."), F.lit(0))
        token = non_empty(F.regexp_replace(name, r"^(careers|jobs)-", ""))
        usable = ~name.rlike(r"^(www\d*|careers|jobs|app|api|configure|login|uploads|media)\z")
        return board(token, usable & ~reserved(token), extras(host=host))
    if provider == "eightfold":
        tenant, domain = part(1), F.lower(part(2))
        usable = (
            domain.isNotNull()
            & ~matches(tenant, r"^(www|app|eightfold|api|docs|status)$")
            & ~matches(
                F.concat(tenant, F.lit("."), domain),
                r"(^|[-.])(sandbox|staging|stage|dev|test|uat|qa|demo)([-.]|$)",
            )
        )
        return board(tenant, usable, extras(domain=domain, site=domain))
    if provider == "workday" and "myworkdaysite" in match:
        tenant, site = part(1), part(2)
        return board(tenant, site.isNotNull() & ~reserved(tenant) & ~reserved(site), extras(site=site))
    if provider == "workday":
        tenant, shard, site = part(1), part(2), part(4)
        host = F.concat(tenant, F.lit("."), shard, F.lit(".myworkdayjobs.com"))
        return board(
            tenant, site.isNotNull() & ~reserved(site),
            extras(host=host, site=site, locale=F.lit("en-US")),
        )
    if provider == "ukg":
        host, code, board_id = part(1), part(2), part(3)
        return board(code, board_id.isNotNull(), extras(board=board_id, host=host))
    token = part(1)
    return board(token, ~reserved(token) & ~looks_like_id(token))
