"""Board discovery and the board registry."""

from pyspark.sql import functions as F

from boardwalk.functions import urls as url_fn
from boardwalk.operators import feed, registry
from boardwalk.session import written
from boardwalk.sources import discovery
from checks import fixtures as fx
from checks.feed import postings
from checks.lifecycle import NOW_SQL, now
from checks.registry import register
from checks.text import RESOLVE_SQL, URL_INPUT

# Boards from customers: spellings differ by case, two sites per workday tenant.
BOARDS = (
    "select case c_custkey % 3 when 0 then 'lever' when 1 then 'workday' else 'icims' end as provider, "
    "case when c_custkey % 7 = 0 then 'ACME' else 'acme' end || cast(c_custkey % 60 as string) as token, "
    "min(c_name) as company, case when c_custkey % 3 = 1 then 'Site' || cast(c_custkey % 11 % 2 as string) end as site, "
    "min(c_custkey) as ord, min(c_custkey) % 4 <> 0 as active, cast(min(c_custkey) % 6 as int) as failures, "
    "case min(c_custkey) % 7 when 0 then 'duplicate spelling of x' when 1 then 'HTTP 404' end as last_error, "
    "case when min(c_custkey) % 9 <> 0 then timestamp '2001-01-01 00:00:00' + (min(c_custkey) % 50) * interval '1' day end as last_ok_at "
    "from customer group by 1, 2, 4"
)
B = f"b as ({BOARDS}), bi as (select *, provider || ':' || lower(token) || ':' || lower(coalesce(site, '')) as identity from b)"


def boards(spark, sf_dir):
    df = fx.from_sql(spark, sf_dir, BOARDS, "customer")
    extra = F.when(F.col("site").isNotNull(), F.create_map(F.lit("site"), F.col("site"), F.lit("host"), F.lit("h")))
    return df.select(
        "provider", "token", "company", extra.alias("extra"), "active", F.lit("manual").alias("source"),
        F.lit(None).cast("string").alias("domain"), F.lit(1).alias("job_count"),
        F.col("failures").alias("consecutive_failures"), "last_error", "last_ok_at",
        F.col("last_ok_at").alias("last_crawled_at"), F.col("last_ok_at").alias("verified_at"), "ord",
    )


def board_postings(spark, sf_dir):
    """Open postings on those boards, one per customer order."""
    return fx.from_sql(spark, sf_dir, BOARD_JOBS, "orders")


BOARD_JOBS = (
    "select cast(o_orderkey as string) as key, case o_custkey % 3 when 0 then 'lever' when 1 then 'workday' else 'icims' end as provider, "
    "case when o_custkey % 7 = 0 then 'ACME' when o_custkey % 11 = 0 then 'Acme' else 'acme' end || cast(o_custkey % 60 as string) as board_token, "
    "case when o_orderkey % 10 = 0 then o_orderdate end as closed_at from orders"
)
BLOCKED = "select distinct case c_custkey % 3 when 0 then 'lever' when 1 then 'workday' else 'icims' end as provider, 'Acme' || cast(c_custkey % 60 as string) as token, 'spam' as reason from customer where c_custkey % 60 < 9"
# Verdicts for every board and site.
VERDICTS = (
    "select provider, token, coalesce(site, '') as site, case ord % 4 when 0 then 'live' when 1 then 'dead' when 2 then 'unknown' else 'live' end as verdict, "
    "case ord % 4 when 0 then 200 when 1 then 404 when 2 then cast(null as int) else 200 end as status, cast(ord % 90 as int) as jobs, ord % 5 <> 0 as parsed from b"
)
V = f"{B}, v as ({VERDICTS})"


def blocked(spark, sf_dir):
    return fx.from_sql(spark, sf_dir, BLOCKED, "customer")


def verdicts(spark, sf_dir):
    df = fx.from_sql(spark, sf_dir, BOARDS, "customer")
    v = spark.sql(VERDICTS.replace("from b", "from {b}"), b=df)
    return v.withColumn("extra", F.when(F.col("site") != "", F.create_map(F.lit("site"), F.col("site"))))


@register("board_blocked", f"with {B}, x as ({BLOCKED}) select provider, token, coalesce(site, '') as site from b where not exists (select 1 from x where x.provider = b.provider and lower(x.token) = lower(b.token))")
def board_blocked(spark, sf_dir):
    out = registry.without_blocked(boards(spark, sf_dir), blocked(spark, sf_dir))
    return out.select("provider", "token", url_fn.board_site(F.col("extra")).alias("site"))


@register(
    "board_fresh",
    f"with {B} select provider, token from (select *, row_number() over (partition by identity order by ord) as rn from bi "
    "where identity not in (select identity from bi where ord % 3 = 0)) where rn = 1",
)
def board_fresh(spark, sf_dir):
    b = boards(spark, sf_dir)
    known = b.where(F.col("ord") % 3 == 0)
    return registry.fresh_boards(b, known, [F.col("ord")]).select("provider", "token")


@register(
    "board_known",
    f"with {B} select provider, token, coalesce(site, '') as site from b where active union all "
    "select provider, token, coalesce(site, '') from b where not active and last_error like 'duplicate spelling of %'",
)
def board_known(spark, sf_dir):
    b = boards(spark, sf_dir)
    out = registry.known_boards(b.where("active"), b.where("not active"))
    return out.select("provider", "token", url_fn.board_site(F.col("extra")).alias("site"))


_ONE = "select * from (select *, row_number() over (partition by identity order by ord) as rn from bi) where rn = 1"


@register(
    "board_file_merge",
    f"with {B}, f as (select * from ({_ONE}) where ord % 2 = 0), r as (select * from ({_ONE}) where ord % 3 = 0) "
    "select coalesce(r.identity, f.identity) as identity, case when r.identity is not null then 'registry' else f.company end as company "
    "from f full outer join r on f.identity = r.identity",
)
def board_file_merge(spark, sf_dir):
    from boardwalk.operators.keys import first_per_key

    one = first_per_key(registry.with_identity(boards(spark, sf_dir)), ["identity"], [F.col("ord")])
    cols = ["provider", "token", "company", "extra"]
    left = one.where(F.col("ord") % 2 == 0).select(*cols)
    right = one.where(F.col("ord") % 3 == 0).withColumn("company", F.lit("registry")).select(*cols)
    return registry.with_identity(registry.merge_files(left, right)).select("identity", "company")


@register("board_short_name", f"with {B} select provider, token, company from (select *, row_number() over (partition by provider, token order by length(company), ord) as rn from b) where rn = 1")
def board_short_name(spark, sf_dir):
    return registry.shortest_name(boards(spark, sf_dir)).select("provider", "token", "company")


@register(
    "board_merge",
    f"with {B}, x as ({BLOCKED}), i as (select * from (select *, row_number() over (partition by identity order by ord desc) as rn from bi "
    "where ord % 2 = 0 and not exists (select 1 from x where x.provider = bi.provider and lower(x.token) = lower(bi.token))) where rn = 1), "
    f"o as (select * from ({_ONE}) where ord % 3 = 0) "
    "select coalesce(i.identity, o.identity) as identity, case when i.identity is not null then i.company || ' new' else o.company end as company, "
    "case when i.identity is not null then true else o.active end as active, case when i.identity is not null then 0 else o.failures end as consecutive_failures, "
    f"case when i.identity is not null then {NOW_SQL} else o.last_ok_at end as last_ok_at from o full outer join i on i.identity = o.identity",
)
def board_merge(spark, sf_dir):
    from boardwalk.operators.keys import first_per_key

    b = boards(spark, sf_dir)
    old = first_per_key(registry.with_identity(b), ["identity"], [F.col("ord")]).where(F.col("ord") % 3 == 0).drop("identity", "ord")
    new = b.where(F.col("ord") % 2 == 0).select(
        "provider", "token", F.concat("company", F.lit(" new")).alias("company"), "extra", "source", "domain", "job_count", "ord"
    )
    out = registry.upsert_boards(old, new, blocked(spark, sf_dir), F.col("ord"), now())
    return registry.with_identity(out).select("identity", "company", "active", "consecutive_failures", "last_ok_at")


@register(
    "board_outcomes",
    f"with {B}, o as (select provider, token, coalesce(site, '') as site, case when ord % 3 = 0 then null when ord % 3 = 1 then 'lever/x: HTTP 404' else 'HTTP 429' end as err, "
    "case when ord % 3 = 1 then 'gone' when ord % 3 = 2 then 'refused' end as failure from b where ord % 4 <> 3), "
    "t as (select provider, token, bool_or(err is null) as fine, min(case when failure = 'refused' then 'HTTP 429' end) as refused from o group by 1, 2), "
    "g as (select provider, token, site, 'HTTP 404' as gone from o where failure = 'gone'), "
    "j as (select b.*, coalesce(t.fine, false) as fine, t.refused, g.gone, (case when coalesce(t.fine, false) then 0 else failures end) + case when g.gone is not null then 1 else 0 end as f "
    "from b left join t using (provider, token) left join g on g.provider = b.provider and g.token = b.token and g.site = coalesce(b.site, '')) "
    "select provider, token, coalesce(site, '') as site, f as consecutive_failures, active and not (gone is not null and f >= 5) as active, "
    "coalesce(gone, refused, case when not fine then last_error end) as last_error from j",
)
def board_outcomes(spark, sf_dir):
    b = boards(spark, sf_dir)
    m = F.col("ord") % 3
    out = b.where(F.col("ord") % 4 != 3).select(
        "provider", "token", url_fn.board_site(F.col("extra")).alias("site"), F.lit(1).alias("jobs"),
        F.when(m == 1, "lever/x: HTTP 404").when(m == 2, "HTTP 429").alias("error"),
        F.when(m == 1, "gone").when(m == 2, "refused").alias("failure"),
    )
    merged = registry.apply_outcomes(b.drop("ord"), out, now(), may_retire=True)
    return merged.select(
        "provider", "token", url_fn.board_site(F.col("extra")).alias("site"), "consecutive_failures", "active", "last_error"
    )


@register(
    "board_health",
    fx.with_outcomes(
        "g as (select *, sum(case when error is null then 1 else 0 end) over (partition by provider, token order by ts, event_id) as run from outcomes), "
        "r as (select provider, token, run, count(*) filter (where failure = 'gone') as n from g group by 1, 2, 3), "
        "l as (select provider, token, arg_max(n, run) as consecutive_failures, max(n) < 5 as active from r group by 1, 2), "
        "e as (select provider, token, arg_max(coalesce(regexp_replace(error, '^[a-z]+[0-9]*/[A-Za-z0-9_.:@+-]+:\\s*', ''), '(none)'), (ts, event_id)) as last_error, "
        "max(case when error is null then ts end) as last_ok_at from outcomes group by 1, 2)",
        "select provider, token, consecutive_failures, active, nullif(last_error, '(none)') as last_error, last_ok_at from l join e using (provider, token)",
    ),
)
def board_health(spark, sf_dir):
    out = fx.outcomes(spark, sf_dir)
    # The fixture's vendor names carry a digit; the stored reason drops the prefix either way.
    out = out.withColumn("error", F.regexp_replace("error", r"^p\d+/b\d+: ", ""))
    return registry.health_history(out, "ts", "event_id")


@register(
    "board_failures",
    f"with {B}, f as (select provider, token, coalesce(site, '') as site, failures, ord from b where ord % 2 = 0) "
    "select failures + 1 as failures, 'HTTP 40' || cast(ord % 5 as varchar) as reason, site, count(*) as boards, failures + 1 >= 5 as retire from f group by 1, 2, 3, 5",
)
def board_failures(spark, sf_dir):
    b = boards(spark, sf_dir)
    failed = b.where(F.col("ord") % 2 == 0).select(
        "provider", "token", url_fn.board_site(F.col("extra")).alias("site"),
        F.concat(F.lit("icims/x: HTTP 40"), (F.col("ord") % 5).cast("string")).alias("error"), "ord",
    )
    return registry.failure_groups(failed, b)


@register(
    "board_reasons",
    f"with {B}, f as (select provider, token, min(ord) as ord from b group by 1, 2) select 'HTTP ' || cast(ord % 9 as varchar) as reason, count(*) as boards from f group by 1",
)
def board_reasons(spark, sf_dir):
    b = boards(spark, sf_dir)
    failed = b.select("provider", "token", F.concat(F.lit("HTTP "), (F.col("ord") % 9).cast("string")).alias("error"), "ord")
    return registry.reasons_by_token(failed)


@register("board_stalest", f"with {B} select provider, token, last_ok_at from b where active order by last_ok_at asc nulls first, token, provider, site limit 25")
def board_stalest(spark, sf_dir):
    return registry.stalest(boards(spark, sf_dir), 25).select("provider", "token", "last_ok_at")


@register(
    "verification_summary",
    f"with {V} select case when status is null then 'transport error (no response)' else 'HTTP ' || cast(status as varchar) end as answer, count(*) as n, "
    "count(*) filter (where verdict = 'live') as live, count(*) filter (where verdict = 'dead') as dead, count(*) filter (where verdict = 'unknown') as unclear, false as blocked from v group by 1",
)
def verification_summary(spark, sf_dir):
    return registry.verification_summary(verdicts(spark, sf_dir))


@register(
    "board_verdicts",
    f"with {V} select provider, token, site, case when verdict = 'dead' then 0 else jobs end as jobs, case when verdict = 'dead' then 'gone' end as failure from v where verdict <> 'unknown'",
)
def board_verdicts(spark, sf_dir):
    return registry.verdict_outcomes(verdicts(spark, sf_dir)).drop("error")


@register(
    "board_revive",
    f"with {V}, x as ({BLOCKED}), back as (select distinct b.provider, b.token from b join v on v.provider = b.provider and v.token = b.token where not active "
    "and coalesce(last_error, '') not like 'duplicate spelling of %' and v.verdict = 'live' and v.parsed "
    "and not exists (select 1 from x where x.provider = b.provider and lower(x.token) = lower(b.token))) "
    "select b.provider, b.token, coalesce(site, '') as site, active or back.token is not null as active, case when back.token is not null then 0 else failures end as consecutive_failures, "
    "case when back.token is null then last_error end as last_error from b left join back on back.provider = b.provider and back.token = b.token",
)
def board_revive(spark, sf_dir):
    out = registry.revive(boards(spark, sf_dir), verdicts(spark, sf_dir), blocked(spark, sf_dir))
    return out.select(
        "provider", "token", url_fn.board_site(F.col("extra")).alias("site"), "active", "consecutive_failures", "last_error"
    )


@register(
    "board_adopt",
    f"with {V}, s as (select *, provider || ':' || lower(token) || ':' || lower(coalesce(site, '')) as identity from b where ord % 2 = 0), "
    "k as (select identity from bi where ord % 3 = 0) select s.provider, s.token, v.verdict <> 'dead' as active, "
    "case when v.verdict = 'dead' then 'adopted from the seed file, verified gone 2001-08-02 (HTTP 404)' end as last_error, case when v.verdict = 'dead' then 0 else v.jobs end as job_count "
    "from s join v on v.provider = s.provider and lower(v.token) = lower(s.token) and v.site = coalesce(s.site, '') where s.identity not in (select identity from k)",
)
def board_adopt(spark, sf_dir):
    b = boards(spark, sf_dir)
    out = registry.adopt(b.where(F.col("ord") % 2 == 0), b.where(F.col("ord") % 3 == 0), verdicts(spark, sf_dir), now())
    return out.select("provider", "token", "active", "last_error", "job_count")


@register(
    "board_site_clashes",
    f"with {B} select s.provider, s.token, s.site as file_site, r.site as registry_site from b s join b r on r.provider = s.provider and lower(r.token) = lower(s.token) "
    "where s.provider = 'workday' and s.ord % 2 = 0 and r.ord % 5 <> 0 and lower(s.site) <> lower(r.site)",
)
def board_site_clashes(spark, sf_dir):
    b = boards(spark, sf_dir)
    return registry.site_clashes(b.where(F.col("ord") % 2 == 0), b.where(F.col("ord") % 5 != 0))


J = f"{B}, p as ({BOARD_JOBS}), oj as (select provider, board_token as token, count(*) as jobs from p where closed_at is null group by 1, 2), "
DUP = (
    J + "sp as (select distinct provider, identity, token from bi where active), "
    "dup as (select sp.*, coalesce(jobs, 0) as jobs, first_value(sp.token) over (partition by identity order by coalesce(jobs, 0) desc, sp.token) as keep "
    "from sp left join oj using (provider, token) where identity in (select identity from sp group by 1 having count(*) > 1))"
)


@register("board_dup_spelling", f"with {DUP} select * from dup")
def board_dup_spelling(spark, sf_dir):
    return registry.duplicate_spellings(boards(spark, sf_dir), board_postings(spark, sf_dir))


ORPHAN = (
    "act as (select provider, lower(token) as t, max(token) as keep from b where active group by 1, 2), "
    "orphan as (select distinct p.provider, p.board_token as token, act.keep from p join act on act.provider = p.provider and act.t = lower(p.board_token) "
    "where p.closed_at is null and not exists (select 1 from b where b.active and b.provider = p.provider and b.token = p.board_token))"
)


@register("board_orphans", f"with {J} {ORPHAN} select * from orphan")
def board_orphans(spark, sf_dir):
    return registry.orphan_spellings(boards(spark, sf_dir), board_postings(spark, sf_dir))


@register(
    "retire_duplicates",
    f"with {DUP}, {ORPHAN}, lose as (select distinct provider, token from dup where token <> keep union select provider, token from orphan) "
    f"select key, case when closed_at is null and lose.token is not null then {NOW_SQL} else closed_at end as closed_at from p left join lose on lose.provider = p.provider and lose.token = p.board_token",
)
def retire_duplicates(spark, sf_dir):
    _, jobs = registry.retire_duplicates(boards(spark, sf_dir), board_postings(spark, sf_dir), now())
    return jobs.select("key", "closed_at")


@register(
    "retire_duplicate_boards",
    f"with {DUP}, lose as (select provider, token, min(keep) as keep from dup where token <> keep group by 1, 2) "
    "select b.provider, b.token, coalesce(site, '') as site, active and lose.token is null as active, coalesce('duplicate spelling of ' || lose.keep, last_error) as last_error "
    "from b left join lose on lose.provider = b.provider and lose.token = b.token",
)
def retire_duplicate_boards(spark, sf_dir):
    out, _ = registry.retire_duplicates(boards(spark, sf_dir), board_postings(spark, sf_dir), now())
    return out.select("provider", "token", url_fn.board_site(F.col("extra")).alias("site"), "active", "last_error")


@register(
    "block_board",
    f"with {J} t as (select distinct provider, token from b where ord % 11 = 0) select key, case when closed_at is null and t.token is not null then {NOW_SQL} else closed_at end as closed_at "
    "from p left join t on t.provider = p.provider and t.token = p.board_token",
)
def block_board(spark, sf_dir):
    b = boards(spark, sf_dir)
    targets = b.where(F.col("ord") % 11 == 0).select("provider", "token", F.lit("spam").alias("reason"))
    _, jobs, _ = registry.block_board(b, board_postings(spark, sf_dir), blocked(spark, sf_dir), targets, now())
    return jobs.select("key", "closed_at")


@register("unblock_board", f"with x as ({BLOCKED}) select provider, token from x where provider <> 'lever'")
def unblock_board(spark, sf_dir):
    x = blocked(spark, sf_dir)
    return registry.unblock(x, x.where(F.col("provider") == "lever").select("provider", "token")).select("provider", "token")


# Sites of a tenant list parts; sites 0 and 3 list the same, as do 1 and 'CX'.
SITES = (
    "select 't' || cast(l_suppkey % 20 as string) as tenant, case s.i when 4 then 'CX' else 'S' || cast(s.i as string) end as site, cast(l_partkey as string) as id "
    "from lineitem join (values (0), (1), (2), (3), (4)) as s(i) on case s.i when 0 then l_partkey % 2 = 0 when 3 then l_partkey % 2 = 0 when 1 then l_partkey % 3 = 0 "
    "when 4 then l_partkey % 3 = 0 else l_partkey % 5 = 0 end"
)


@register(
    "board_aliases",
    f"with x as (select distinct * from ({SITES})), s as (select tenant, site, string_agg(id, ',' order by id) as ids from x group by 1, 2), "
    "k as (select *, first_value(site) over (partition by tenant, ids order by case when upper(site) = 'CX' then 1 else 0 end, site) as kept_site from s) "
    "select tenant, site, kept_site from k where site <> kept_site",
)
def board_aliases(spark, sf_dir):
    return registry.site_aliases(fx.from_sql(spark, sf_dir, SITES, "lineitem"))


# Registered are sites 0 and 2, and of every third tenant the default address; the others arrive.
_HELD = "site in ('S0', 'S2') or (site = 'CX' and cast(substr(tenant, 2) as int) % 3 = 0)"
_GUARD = (
    f"x as (select distinct * from ({SITES})), s as (select tenant, site, {_HELD} as held, string_agg(id, ',' order by id) as ids from x group by 1, 2, 3), "
    "k as (select tenant, site, held, first_value(site) over (partition by tenant, ids "
    "order by case when held then 0 else 1 end, case when upper(site) = 'CX' then 1 else 0 end, site) as copy_of from s), "
    "g as (select tenant, site, copy_of from k where not held and site <> copy_of)"
)


@register("alias_guard", f"with {_GUARD} select * from g")
def alias_guard(spark, sf_dir):
    ids = fx.from_sql(spark, sf_dir, SITES, "lineitem")
    old = ids.where(_HELD)
    return registry.alias_guard(ids.where(f"not ({_HELD})"), old, registry.site_prints(old))


# A page of each customer's board: an organisation or its code, a brand, a listing title, a careers title.
_PAGES = (
    "select c_custkey as id, case c_custkey % 4 when 0 then 'oracle' when 1 then 'eightfold' when 2 then 'icims' else 'lever' end as provider, "
    "'acme-corp' || cast(c_custkey as string) as token, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then 'Acme Corp' || cast(c_custkey as string) end as company, "
    "case c_custkey % 4 when 0 then case when c_custkey % 5 = 0 then '{\"items\":[{\"organizationsFacet\":[{\"Name\":\"300 - Unit\"}]}]}' "
    "else '{\"items\":[{\"organizationsFacet\":[{\"Name\":\" Org ' || c_name || '\"}]}]}' end "
    "when 1 then '{\"branding\":{\"companyName\":\" Brand ' || c_name || ' \"}}' "
    "when 2 then '<html><title>Careers | Job Listings at Tom &amp; ' || c_name || '</title></html>' "
    "else case when c_custkey % 5 = 0 then '<title>Page not found</title>' else '<title>Careers at Firm ' || c_name || ' | Jobs</title>' end end as body from customer"
)


@register(
    "board_names",
    f"with p as ({_PAGES}) select id, case when company like 'Customer%' then company else coalesce(case id % 4 "
    "when 0 then case when id % 5 <> 0 then 'Org ' || c_name end when 1 then 'Brand ' || c_name when 2 then 'Tom & ' || c_name "
    "else case when id % 5 <> 0 then 'Firm ' || c_name end end, company) end as company from p join customer on c_custkey = id",
)
def board_names(spark, sf_dir):
    from boardwalk.plans.names import name_boards

    rows = fx.from_sql(spark, sf_dir, _PAGES, "customer")
    pages = rows.select("provider", F.upper("token").alias("board_token"), F.explode(F.array(F.lit(2), F.lit(1))).alias("page"), "body")
    pages = pages.withColumn("body", F.when(F.col("page") == 1, F.col("body")).otherwise("<title>error</title>"))
    return name_boards(rows.select("id", "provider", "token", "company"), pages).select("id", "company")


@register(
    "discovery_upsert",
    f"with {_GUARD}, b as (select distinct tenant, site, {_HELD} as held, site = 'S2' and tenant like '%5' as off from x) "
    "select tenant as token, site, case when off then 'duplicate site of S0' end as last_error, not off as active, 'registry' as company from b where held "
    "union all select tenant, site, null, true, 'found' from b where not held and tenant <> 't4' "
    "and not exists (select 1 from g where g.tenant = b.tenant and g.site = b.site) "
    "union all select distinct 'lv' || tenant, '', null, true, 'found' from b where tenant not in ('t4', 't6')",
)
def discovery_upsert(spark, sf_dir):
    ids = fx.from_sql(spark, sf_dir, SITES, "lineitem")
    sites = written(ids.select("tenant", "site").distinct(), "sites")
    off = F.expr("site = 'S2' and tenant like '%5'")
    at = F.create_map(F.lit("site"), F.col("site"))
    held = sites.where(_HELD).select(
        F.lit("oracle").alias("provider"), F.col("tenant").alias("token"), F.lit("registry").alias("company"), at.alias("extra"),
        (~off).alias("active"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("domain"), F.lit(1).alias("job_count"),
        F.lit(2).alias("consecutive_failures"), F.when(off, "duplicate site of S0").alias("last_error"), now().alias("last_ok_at"),
        now().alias("last_crawled_at"), now().alias("verified_at"),
    )
    verdict = F.when(F.col("tenant") == "t4", "dead").otherwise("live").alias("verdict")
    found = sites.select(
        F.lit("oracle").alias("provider"), F.upper("tenant").alias("token"), F.lit("found").alias("company"), at.alias("extra"), verdict
    ).unionByName(
        sites.select("tenant").distinct().select(
            F.lit("lever").alias("provider"), F.concat(F.lit("lv"), "tenant").alias("token"), F.lit("found").alias("company"),
            F.lit(None).cast("map<string,string>").alias("extra"), verdict,
        )
    )
    refused = spark.sql("select 'lever' as provider, 'LVt6' as token, 'spam' as reason")
    out = registry.store_discovered(held, found, ids, refused, F.col("token"), now())
    return out.select(
        F.when(F.col("provider") == "oracle", F.lower("token")).otherwise(F.col("token")).alias("token"),
        url_fn.board_site(F.col("extra")).alias("site"), "last_error", "active", "company",
    )


@register(
    "board_gap",
    f"with {B}, f as (select provider, count(*) as net_new from (select distinct provider, identity from bi where identity not in (select identity from bi where ord % 3 = 0)) group by 1) "
    "select provider, count(*) as in_dataset, coalesce(any_value(net_new), 0) as net_new from b left join f using (provider) group by 1",
)
def board_gap(spark, sf_dir):
    b = boards(spark, sf_dir)
    fresh = registry.fresh_boards(b, b.where(F.col("ord") % 3 == 0), [F.col("ord")])
    return registry.per_provider_gap(b, fresh)


@register(
    "posting_board_extra",
    f"with {J} w as (select provider, token, min(site) as site from b where site is not null group by 1, 2) "
    "select key, case when w.site is not null and p.provider = 'workday' then 'h' end as board_host, case when p.provider = 'workday' then w.site end as board_site "
    "from p left join w on w.provider = p.provider and w.token = p.board_token",
)
def posting_board_extra(spark, sf_dir):
    out = feed.with_board_extra(board_postings(spark, sf_dir), boards(spark, sf_dir))
    return out.select("key", "board_host", "board_site")


# --------------------------------------------------------------------------- discovery


@register(
    "url_coverage",
    f"with src as ({URL_INPUT}), {RESOLVE_SQL} select coalesce(platform, 'unknown:' || host) as platform, tier, count(*) as n, "
    "count(distinct case when status = 'supported' then provider || ':' || token end) as boards from v group by 1, 2",
)
def url_coverage(spark, sf_dir):
    df = fx.from_sql(spark, sf_dir, URL_INPUT, "orders", spread_first=True)
    resolved = df.select(url_fn.resolve_url(F.col("url")).alias("r")).select("r.*")
    return registry.url_coverage(resolved)


ARCHIVE_FORMS = [
    "https://job-boards.greenhouse.io/{t}/jobs/1", "https://boards.greenhouse.io/embed/x", "https://jobs.ashbyhq.com/{t}.io/9",
    "https://{t}.wd5.myworkdayjobs.com/en-US/External/job", "https://jobs.smartrecruiters.com/{t}", "https://apply.workable.com/api/v1",
    "https://{t}.jobs.personio.de/x", "https://{t}.bamboohr.com/careers/5", "https://{t}.bamboohr.com/about", "https://{t}.recruitee.com/o/a",
    "https://careers-{t}.icims.com/jobs/1", "https://www.icims.com/x", "https://recruiting2.ultipro.com/{t}/JobBoard/0a1b2c3d-0000-1111-2222-333344445555/?q=",
    "https://wd1.myworkdaysite.com/en-US/recruiting/{t}/Careers", "https://{t}.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_2/jobs",
    "https://{t}.eightfold.ai/careers?pid=1&domain={t}.com", "https://test.eightfold.ai/careers?domain={t}.com", "https://{t}.example.com/",
]
ARCHIVE = (
    "select o_orderkey as ord, replace(v.raw, '{t}', 'co' || cast(o_custkey % 70 as string)) as url from orders "
    f"join (values {fx._values([(u,) for u in ARCHIVE_FORMS])}) as v(i, raw) on v.i = o_orderkey % {len(ARCHIVE_FORMS)}"
)
_T = "'co' || cast(o_custkey % 70 as varchar)"
ARCHIVE_EXPECT = (
    "select o_orderkey as ord, {t} as t, case o_orderkey % 18 when 0 then 'greenhouse' when 2 then 'ashby' when 3 then 'workday' when 4 then 'smartrecruiters' "
    "when 6 then 'personio' when 7 then 'bamboohr' when 9 then 'recruitee' when 10 then 'icims' when 12 then 'ukg' when 13 then 'workday' when 14 then 'oracle' when 15 then 'eightfold' end as provider, "
    "case o_orderkey % 18 when 3 then 'External' when 13 then 'Careers' when 14 then 'CX_2' when 15 then {t} || '.com' end as site, o_orderkey % 18 as form from orders"
).format(t=_T)


@register(
    "archive_boards",
    f"with e as ({ARCHIVE_EXPECT}) select distinct provider, case when form = 2 then t || '.io' else t end as token, coalesce(site, '') as site from e where provider is not null",
)
def archive_boards(spark, sf_dir):
    found = discovery.archive_boards(fx.from_sql(spark, sf_dir, ARCHIVE, "orders", spread_first=True))
    return found.select("provider", "token", url_fn.board_site(F.col("extra")).alias("site"))


@register(
    "archive_report",
    f"with e as ({ARCHIVE_EXPECT}), x as (select *, case form when 0 then 'job-boards.greenhouse.io/*' when 2 then 'jobs.ashbyhq.com/*' when 3 then '*.myworkdayjobs.com/*' when 4 then 'jobs.smartrecruiters.com/*' "
    "when 6 then '*.jobs.personio.de/*' when 7 then '*.bamboohr.com/*' when 9 then '*.recruitee.com/*' when 10 then '*.icims.com/*' when 12 then 'recruiting.ultipro.com/*' "
    "when 13 then '*.myworkdaysite.com/*' when 14 then '*.oraclecloud.com/*' when 15 then '*.eightfold.ai/*' end as pattern from e where provider is not null) "
    "select pattern, count(*) as urls, count(distinct t) as boards from (select * from x union all select * replace ('boards.greenhouse.io/*' as pattern) from x where form = 0 "
    "union all select * replace ('recruiting2.ultipro.com/*' as pattern) from x where form = 12) group by 1",
)
def archive_report(spark, sf_dir):
    return discovery.archive_report(fx.from_sql(spark, sf_dir, ARCHIVE, "orders", spread_first=True))


@register(
    "dataset_boards",
    "select c_custkey as ord, case when c_custkey % 4 = 0 then 'workday' when c_custkey % 4 = 1 then 'lever' else 'icims' end as provider, "
    "case when c_custkey % 4 < 2 then 'co' || cast(c_custkey as varchar) else 'slug' || cast(c_custkey as varchar) end as token, "
    "case when c_custkey % 5 <> 0 then c_name when c_custkey % 4 < 2 and c_custkey < 10 then 'co' || cast(c_custkey as varchar) "
    "when c_custkey % 4 < 2 then 'Co' || cast(c_custkey as varchar) else 'Slug' || cast(c_custkey as varchar) end as company "
    "from customer where c_custkey % 4 <> 3",
)
def dataset_boards(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("slug"), F.col("c_custkey").cast("string")))
        .when(F.col("c_custkey") % 4 == 3, F.lit("-bad slug")).alias("slug"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("https://co"), F.col("c_custkey").cast("string"), F.lit(".wd5.myworkdayjobs.com/en-US/Ext")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("https://jobs.lever.co/co"), F.col("c_custkey").cast("string")))
        .otherwise(F.lit("https://example.com/")).alias("url"),
        F.lit(None).cast("string").alias("domain"),
    )
    return discovery.dataset_boards(rows, "icims").select("ord", "provider", "token", "company")


@register(
    "open_list_boards",
    "select distinct 'workday' as provider, 'ten' || cast(s_suppkey % 30 as varchar) as token, 'Site' || cast(s_suppkey % 4 as varchar) as site from supplier where s_suppkey % 5 <> 0",
)
def open_list_boards(spark, sf_dir):
    entry = F.concat(
        F.lit("ten"), (F.col("s_suppkey") % 30).cast("string"),
        F.when(F.col("s_suppkey") % 5 == 0, "|bad|").otherwise("|wd5|"),
        F.lit("Site"), (F.col("s_suppkey") % 4).cast("string"),
    )
    rows = fx.read(spark, sf_dir, "supplier").select(entry.alias("entry"))
    out = discovery.open_list_boards(rows, "workday")
    return out.select("provider", "token", url_fn.board_site(F.col("extra")).alias("site"))


@register(
    "careers_links",
    "select page_id, 'lever' as provider, 'co' || cast(page_id % 9 as varchar) as token from pages where page_id % 3 = 0 union all "
    "select page_id, 'workday', 'ten' || cast(page_id % 5 as varchar) from pages where page_id % 3 = 1",
)
def careers_links(spark, sf_dir):
    pages = fx.read(spark, sf_dir, "pages")
    n = F.col("page_id")
    link = F.when(
        n % 3 == 0, F.concat(F.lit('<a href="https://jobs.lever.co/co'), (n % 9).cast("string"), F.lit('/a">x</a>'))
    ).when(
        n % 3 == 1,
        F.concat(F.lit("see https://ten"), (n % 5).cast("string"), F.lit(".wd3.myworkdayjobs.com/en-US/Careers and https://x.wd1.myworkdayjobs.com/login")),
    ).otherwise("")
    return discovery.careers_boards(pages.withColumn("html", F.concat("html", link)), "page_id").select("page_id", "provider", "token")


@register(
    "thread_boards",
    "select distinct conv_id, 'ashby' as provider, 'co' || cast(conv_id % 11 + turn % 2 as varchar) as token from conversations where turn % 3 <> 2",
)
def thread_boards(spark, sf_dir):
    conv = fx.read(spark, sf_dir, "conversations")
    text = F.concat(
        "text", F.when(F.col("turn") % 3 != 2, F.concat(F.lit(" apply: https:&#x2F;&#x2F;jobs.ashbyhq.com&#x2F;co"), (F.col("conv_id") % 11 + F.col("turn") % 2).cast("string"), F.lit("). thanks"))).otherwise("")
    )
    out = discovery.thread_boards(conv.withColumn("text", text), "conv_id", "text", "turn")
    return out.select("conv_id", "provider", "token")


STORIES = (
    "select conv_id as story_id, case conv_id % 3 when 0 then 'Ask HN: Who is hiring? (May)' when 1 then 'Ask HN: Who wants to be hired?' else 'Show HN' end as title, "
    "count(*) * 20 as num_comments, timestamp '2001-01-01 00:00:00' + (conv_id % 400) * interval '1' day as created_at from conversations group by conv_id"
)


# Replies: within a conversation to an earlier turn, and conversations one below the other, 250 to a thread.
REPLIES = (
    "select conv_id * 100 + turn as id, case when turn > 0 then conv_id * 100 + case when turn % 2 = 1 then turn - 1 else cast(floor(turn / 2) as int) end "
    "when conv_id % 250 > 0 then conv_id * 100 - 100 end as parent, conv_id, turn from conversations"
)


@register(
    "thread_tree",
    f"with recursive r as ({REPLIES}), w as (select r.id, case when p.id is not null then r.parent end as parent from r left join r p on p.id = r.parent), "
    "t as (select id, id as root, 0 as depth from w where parent is null union all select w.id, t.root, t.depth + 1 from w join t on w.parent = t.id) select * from t",
)
def thread_tree(spark, sf_dir):
    return discovery.thread_tree(fx.from_sql(spark, sf_dir, REPLIES, "conversations")).select("id", "root", "depth")


@register("hiring_threads", f"with s as ({STORIES}) select story_id, created_at from s where title like 'Ask HN: Who is hiring?%' and num_comments > 50")
def hiring_threads(spark, sf_dir):
    return discovery.hiring_threads(fx.from_sql(spark, sf_dir, STORIES, "conversations")).select("story_id", "created_at")


@register(
    "company_names",
    "with n as (select case s_suppkey % 6 when 0 then 'themuse' when 1 then 'himalayas' when 2 then 'arbeitnow' when 3 then 'remotive' when 4 then 'remoteok' else 'jobicy' end as source, "
    "s_name, s_suppkey from supplier) select distinct source, s_name as name from n where s_suppkey % 7 <> 0",
)
def company_names(spark, sf_dir):
    k = F.col("s_suppkey")
    source = F.element_at(F.array(*[F.lit(s) for s in ("themuse", "himalayas", "arbeitnow", "remotive", "remoteok", "jobicy")]), (k % 6 + 1).cast("int"))
    raw = F.when(k % 7 == 0, "Confidential").when(k % 7 == 1, F.concat("s_name", F.lit(" - Remote jobs"))).when(k % 7 == 2, F.concat("s_name", F.lit(" (YC W21)"))).otherwise(F.col("s_name"))
    df = fx.read(spark, sf_dir, "supplier").select(source.alias("source"), raw.alias("raw"))
    name = {
        "themuse": "to_json(named_struct('results', array(named_struct('company', named_struct('name', raw)))))",
        "himalayas": "to_json(named_struct('jobs', array(named_struct('companyName', raw))))",
        "arbeitnow": "to_json(named_struct('data', array(named_struct('company_name', raw))))",
        "remotive": "to_json(named_struct('jobs', array(named_struct('company_name', raw))))",
        "remoteok": "to_json(array(named_struct('company', 'legal notice'), named_struct('company', raw)))",
        "jobicy": "to_json(named_struct('jobs', array(named_struct('companyName', raw))))",
    }
    body = "case source " + " ".join(f"when '{s}' then {e}" for s, e in name.items()) + " end"
    return discovery.company_names(df.select("source", F.expr(body).alias("body")))
