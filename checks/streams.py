"""State kept by micro-batches and by the write path, next to SQL that folds the same events one by one."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boardwalk.schemas import EXCLUSIONS
from boardwalk.session import shared_folder, written
from boardwalk.streaming import jobs
from boardwalk.streaming.buckets import BucketedPostings, Layout, run_log
from boardwalk.streaming.snapshots import StoredFacets
from boardwalk.streaming.tables import VersionedTable
from checks import fixtures as fx
from checks.boards import B, boards
from checks.feed import SHAPES, WINDOW, postings, snapshot_sql
from checks.registry import register

# An outcome for each order: a crawl is a month, and a board may answer, refuse or be gone.
HEARD = """select case o_custkey % 3 when 0 then 'lever' when 1 then 'workday' else 'icims' end as provider,
  case when o_custkey % 7 = 0 then 'ACME' else 'acme' end || cast(o_custkey % 60 as string) as token,
  case when o_custkey % 3 = 1 then 'Site' || cast(o_custkey % 11 % 2 as string) end as site, 1 as jobs,
  case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 4 then 'HTTP 429' else 'lever/x: HTTP 404' end as error,
  case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 4 then 'refused' else 'gone' end as failure,
  date_trunc('month', o_orderdate) as tm from orders"""


def in_files(spark, df, at: str):
    """The rows written as one file for each year, oldest first; a folder that a stream can read."""
    folder = shared_folder(spark, "stream")
    years = [r[0] for r in df.select(F.year(at)).distinct().orderBy(F.year(at)).collect()]
    for year in years:  # file streams read in order of writing
        df.where(F.year(at) == year).coalesce(1).write.mode("append").parquet(folder)
    return folder


@register(
    "stream_board_health",
    f"""with recursive {B}, o as ({HEARD}),
    t as (select provider, token, tm, bool_or(error is null) as fine, min(case when failure = 'refused' then 'HTTP 429' end) as refused from o group by 1, 2, 3),
    g as (select distinct provider, token, coalesce(site, '') as site, tm, 'HTTP 404' as gone from o where failure = 'gone'),
    e as (select b.provider, b.token, coalesce(b.site, '') as site, t.tm, t.fine, t.refused, g.gone,
        row_number() over (partition by b.provider, b.token, b.site order by t.tm) as i
      from b join t using (provider, token) left join g on g.provider = b.provider and g.token = b.token and g.site = coalesce(b.site, '') and g.tm = t.tm
      where t.fine or t.refused is not null or g.gone is not null),
    f as (
      select provider, token, coalesce(site, '') as site, 0 as i, failures, active, last_error, last_ok_at, last_ok_at as last_crawled_at from b
      union all
      select f.provider, f.token, f.site, f.i + 1, (case when e.fine then 0 else f.failures end) + (case when e.gone is not null then 1 else 0 end),
        f.active and not (e.gone is not null and (case when e.fine then 0 else f.failures end) + 1 >= 5),
        coalesce(e.gone, e.refused, case when not e.fine then f.last_error end), case when e.fine then e.tm else f.last_ok_at end, e.tm
      from f join e on e.provider = f.provider and e.token = f.token and e.site = f.site and e.i = f.i + 1)
    select provider, token, site, failures as consecutive_failures, active, last_error, last_ok_at, last_crawled_at from f
    qualify row_number() over (partition by provider, token, site order by i desc) = 1""",
)
def stream_board_health(spark, sf_dir):
    from boardwalk.functions.urls import board_site

    heard = fx.from_sql(spark, sf_dir, HEARD, "orders").withColumn("tm", F.col("tm").cast("timestamp_ntz"))
    seed = boards(spark, sf_dir).drop("ord")
    folder, state = in_files(spark, heard, "tm"), shared_folder(spark, "health")
    stream = spark.readStream.schema(heard.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    table = VersionedTable(spark, f"{state}/boards", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seed.schema))
    jobs.board_health_stream(stream, table, seed, f"{state}/checkpoint", at="tm").awaitTermination()
    return table.latest().select(
        "provider", "token", board_site(F.col("extra")).alias("site"), "consecutive_failures", "active", "last_error", "last_ok_at", "last_crawled_at"
    )


# Five crawls of a day each; a crawl covers two thirds of the boards, and of those most answer healthily.
NUMBER = "cast(substr(p.board_token, 2) as int)"
SEEN = f"""select key, provider, board_token, title || ' #' || cast(b.i as string) as title,
  timestamp '2001-01-01 00:00:00' + b.i * interval '4' day as seen_at, b.i as i
from {{p}} p join (values (0), (1), (2), (3), (4)) as b(i) on ((p.ord + b.i) % 3 <> 0 or p.ord % 4 = 0) and ({NUMBER} + b.i) % 3 <> 1"""
RUNS = f"""select distinct provider, board_token, timestamp '2001-01-01 00:00:00' + b.i * interval '4' day as run_at, b.i as i
from {{p}} p join (values (0), (1), (2), (3), (4)) as b(i) on ({NUMBER} + b.i) % 3 <> 1 and ({NUMBER} + b.i) % 7 <> 2"""
STATE = "key string, provider string, board_token string, title string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, closed_at timestamp_ntz"
FOLD = (
    f"s as ({SEEN.replace('{p}', 'postings')}), r as ({RUNS.replace('{p}', 'postings')}), "
    "k as (select key, provider, board_token, arg_max(title, seen_at) as title, min(seen_at) as first_seen_at, max(seen_at) as last_seen_at from s group by 1, 2, 3), "
    "c as (select *, (select min(run_at) from r where r.provider = k.provider and r.board_token = k.board_token and run_at > k.last_seen_at) as closed_at from k)"
)


def written_path(spark, sf_dir, purge: bool):
    """The store after all five crawls."""
    p = written(postings(spark, sf_dir).select("key", "provider", "board_token", "title", "ord"), "crawled")
    seen, runs = spark.sql(SEEN, p=p), written(spark.sql(RUNS, p=p), "runs")
    store = BucketedPostings(spark, shared_folder(spark, "postings"), STATE, Layout(buckets=16))
    for i in range(5):
        batch = seen.where(F.col("i") == i).drop("seen_at", "i")
        healthy = runs.where(F.col("i") == i).select("provider", "board_token")
        store.apply(i, batch, healthy, datetime(2001, 1, 1) + timedelta(days=4 * i), purge=purge)
        store.forget_before(i)
    return store


@register(
    "write_path_state",
    fx.with_postings_cte(FOLD, "select key, title, first_seen_at, last_seen_at, closed_at from c"),
)
def write_path_state(spark, sf_dir):
    return written_path(spark, sf_dir, False).read().select("key", "title", "first_seen_at", "last_seen_at", "closed_at")


@register("write_path_open", fx.with_postings_cte(FOLD, "select key, title, last_seen_at from c where closed_at is null"))
def write_path_open(spark, sf_dir):
    return written_path(spark, sf_dir, True).read(open_only=True).select("key", "title", "last_seen_at")


LAST = "timestamp '2001-01-17 00:00:00'"


@register(
    "write_path_run_log",
    fx.with_postings_cte(
        FOLD + f", oc as ({fx.OUTCOMES_SQL})",
        "select timestamp '2001-01-17 00:00:00' as started_at, timestamp '2001-01-17 01:00:00' as finished_at, "
        "(select count(*) from oc) as boards_total, (select count(*) from oc where error is null) as boards_ok, (select count(*) from oc where error is not null) as boards_failed, "
        f"(select count(*) from s where seen_at = {LAST}) as jobs_scanned, (select count(*) from s where seen_at = {LAST}) as jobs_upserted, "
        f"(select count(*) from c where closed_at = {LAST}) as jobs_closed",
    ),
)
def write_path_run_log(spark, sf_dir):
    store = written_path(spark, sf_dir, False)
    return run_log(fx.outcomes(spark, sf_dir), store.facts(4), "2001-01-17 00:00:00", "2001-01-17 01:00:00")


# What the views count: the place of work changes from crawl to crawl, the rest stays.
COUNTED = "posted_at, country, family, provider, seniority, matched_skills, specialization, adjacent, ghost_risk"
WORKPLACE = "case when (ord + i) % 4 = 0 then 'hybrid' else coalesce(remote_type, 'onsite') end"
COUNTED_STATE = STATE + (
    ", posted_at timestamp_ntz, country string, family string, seniority string, matched_skills array<string>, "
    "specialization string, adjacent boolean, ghost_risk double, remote_type string"
)
VIEWED = (
    f", w as (select key, {COUNTED}, arg_max({WORKPLACE}, i) as remote_type from s join "
    f"(select key, ord, remote_type, {COUNTED} from postings) using (key, provider) group by all), "
    "live as (select w.*, c.first_seen_at, c.closed_at from w join c using (key))"
)


def views_sql() -> str:
    window = WINDOW.replace(fx.NOW, "2001-01-17 00:00:00")
    assert window != WINDOW
    return snapshot_sql().replace(WINDOW, window).replace("from postings", "from live")


@register("facets_by_change", fx.with_postings_cte(FOLD + VIEWED, views_sql()))
def facets_by_change(spark, sf_dir):
    """Views kept over five crawls, of which the last four count only what changed."""
    counted = COUNTED.replace("provider, ", "")
    p = written(postings(spark, sf_dir).selectExpr("key", "provider", "board_token", "title", "ord", "remote_type", *counted.split(", ")), "crawled")
    seen = spark.sql(SEEN.replace("select key", f"select key, {counted}, {WORKPLACE} as remote_type", 1), p=p)
    runs = written(spark.sql(RUNS, p=p), "runs")
    store = BucketedPostings(spark, shared_folder(spark, "postings"), COUNTED_STATE, Layout(buckets=16))
    views = StoredFacets(spark, shared_folder(spark, "views"), SHAPES, fx.WIDE_DAYS)
    for i in range(5):
        now = datetime(2001, 1, 1) + timedelta(days=4 * i)
        healthy = runs.where(F.col("i") == i).select("provider", "board_token")
        store.apply(i, seen.where(F.col("i") == i).drop("seen_at", "i"), healthy, now)
        views.refresh(store, i, str(now))
        store.forget_before(i)
    return views.latest().drop("computed_at")


# Four full passes, a year apart, of three crawls each: the third comes after the pass's window and is a quick one.
TALLIED = (
    "select timestamp '2001-01-01 00:00:00' + cast(floor((event_id % 12) / 3) as int) * interval '366' day "
    "+ cast(event_id % 3 as int) * interval '20' minute as tm, event_type as reason, "
    "'t' || cast(user_id % 40 + 7 * (event_id % 12) as string) as title, count(*) as n, "
    "min('c' || cast(user_id as string)) as sample_company from events group by 1, 2, 3"
)


@register(
    "stream_tally",
    f"with b as ({TALLIED}), f as (select reason, title, min(tm) as first_seen_at from b group by 1, 2), "
    "u as (select b.*, f.first_seen_at from b join f using (reason, title) "
    "where tm - date_trunc('day', tm) <= interval '30' minute or tm = f.first_seen_at) "
    "select reason, title, cast(sum(n) as bigint) as n, arg_min(sample_company, tm) as sample_company, "
    "min(tm) as first_seen_at, max(tm) as last_seen_at from u group by 1, 2",
)
def stream_tally(spark, sf_dir):
    heard = fx.from_sql(spark, sf_dir, TALLIED, "events").withColumn("tm", F.col("tm").cast("timestamp_ntz"))
    state = shared_folder(spark, "tally")
    folder = in_files(spark, heard, "tm")
    stream = spark.readStream.schema(heard.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    table = VersionedTable(spark, f"{state}/tally", EXCLUSIONS)
    marker = VersionedTable(spark, f"{state}/opened", "window_started_at timestamp_ntz")
    jobs.tally_stream(stream, table, marker, f"{state}/checkpoint", at="tm").awaitTermination()
    return table.latest()
