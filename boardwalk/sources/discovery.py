"""Where boards come from: archives, company lists, careers pages, hiring threads."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.functions.match import let, matches, trim_all
from boardwalk.functions.text import decode_entities, titleise
from boardwalk.functions.urls import WORKDAY_URL, archive_board, board_identity, resolve_url, workday_board
from boardwalk.operators.keys import first_per_key
from boardwalk.rules import urls as rules
from boardwalk.session import checkpoint

# Dataset tokens, and vendors whose boards need nothing but a token.
TOKEN = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,80}\z"
TOKEN_ONLY = [
    "greenhouse", "lever", "ashby", "smartrecruiters", "workable", "personio", "recruitee",
    "teamtailor", "bamboohr", "rippling", "breezy", "icims",
]
MIN_COMMENTS = 50
TRAILING = r"""[.,;:!?)\]}'"]+\z"""


# ----------------------------------------------------------------------------- archives


def read_cdx(spark: SparkSession, path: str) -> DataFrame:
    """Archive index: one JSON object with a ``url`` per line."""
    return spark.read.schema("url string").json(path)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("url"))


def archive_hits(urls: DataFrame) -> DataFrame:
    """(url, pattern, board): every URL under every pattern it fits.

    The patterns are fixed, so they are compiled into the plan; each URL is read once.
    """
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    board.isNotNull(),
                    F.struct(F.lit(rules.PATTERNS[i][1]).alias("pattern"), board.alias("board")),
                )
                for i, board in (
                    (i, archive_board(F.col("url"), i)) for i in range(len(rules.PATTERNS))
                )
            ]
        )
    )
    # A single look for any of the hosts spares most URLs the whole list.
    hosts = "|".join(sorted({m.strip("*/.").split("/")[0].replace(".", r"\.") for _, m, _, _ in rules.PATTERNS}))
    likely = urls.where(F.col("url").rlike(f"(?i)({hosts})"))
    return likely.select("*", F.explode(entries).alias("_e")).select(
        *urls.columns, F.col("_e.pattern").alias("pattern"), F.col("_e.board.*")
    )


def archive_boards(urls: DataFrame, order: str = "url") -> DataFrame:
    """Distinct boards found in an archive, the first spelling of each."""
    hits = archive_hits(urls)
    identity = board_identity(F.col("provider"), F.col("token"), F.col("extra"))
    keyed = hits.withColumn("identity", identity)
    return first_per_key(keyed, ["identity"], [F.col(order)]).select(
        "provider", "token", "company", "extra"
    )


def archive_report(urls: DataFrame) -> DataFrame:
    """(pattern, urls, boards): yield per pattern."""
    hits = archive_hits(urls)
    identity = board_identity(F.col("provider"), F.col("token"), F.col("extra"))
    return (
        hits.groupBy("pattern", identity.alias("_i"))
        .agg(F.count("*").alias("_n"))
        .groupBy("pattern")
        .agg(F.sum("_n").alias("urls"), F.count("*").alias("boards"))
    )


# ----------------------------------------------------------------------------- datasets


def read_company_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Company list: name, slug, url, domain by header, or ``name,url`` without one."""
    reader = spark.read.option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    if not header:
        df = reader.schema("name string, url string").csv(path)
    else:
        df = reader.option("header", True).csv(path)
        df = df.toDF(*[c.strip().lower() for c in df.columns])
    wanted = {n: (trim_all(F.col(n)) if n in df.columns else F.lit(None).cast("string")) for n in ("name", "slug", "url", "domain")}
    return df.select(*[F.when(F.length(c) > 0, c).alias(n) for n, c in wanted.items()])


def dataset_boards(rows: DataFrame, file_provider: str) -> DataFrame:
    """Company list rows to boards; rows that lead nowhere are dropped."""
    resolved = rows.withColumns(
        {"_wd": workday_board(F.col("url")), "_r": resolve_url(F.col("url"))}
    )
    by_link = F.when(
        F.col("_r.status") == "supported",
        F.struct("_r.provider", "_r.token", F.col("_r.extra").alias("extra")),
    )
    slug_ok = F.col("slug").rlike(TOKEN)
    no_extra = F.lit(None).cast("map<string,string>")
    if file_provider == "eightfold":
        pair = F.create_map(F.lit("domain"), F.col("domain"), F.lit("site"), F.col("domain"))
        by_slug = _board(file_provider, slug_ok & F.col("domain").isNotNull(), pair)
    elif file_provider in TOKEN_ONLY:
        by_slug = _board(file_provider, slug_ok, no_extra)
    else:
        by_slug = _board(file_provider, F.lit(False), no_extra)
    out = resolved.withColumn("b", F.coalesce("_wd", by_link, by_slug)).where(F.col("b").isNotNull())
    return out.select(
        *[c for c in rows.columns if c not in ("name", "slug", "url", "domain")],
        F.col("b.provider").alias("provider"), F.col("b.token").alias("token"),
        F.coalesce("name", titleise(F.col("b.token"))).alias("company"), F.col("b.extra").alias("extra"),
    )


def _board(provider: str, usable: Column, extra: Column) -> Column:
    return F.when(
        usable, F.struct(F.lit(provider).alias("provider"), F.col("slug").alias("token"), extra.alias("extra"))
    )


def open_list_boards(entries: DataFrame, provider: str, entry: str = "entry") -> DataFrame:
    """Plain token lists; Workday entries read ``tenant|shard|site``."""
    value = trim_all(F.col(entry))
    if provider == "workday":
        parts = F.split(entry, r"\|")
        tenant, shard, site = (F.get(parts, F.lit(i)) for i in range(3))
        usable = (F.length(tenant) > 0) & (F.length(site) > 0) & shard.rlike(r"(?i)^wd\d+\z")
        extra = F.create_map(
            F.lit("host"), F.concat(tenant, F.lit("."), shard, F.lit(".myworkdayjobs.com")),
            F.lit("site"), site, F.lit("locale"), F.lit("en-US"),
        )
        token = tenant
    else:
        usable, extra, token = F.length(value) > 0, F.lit(None).cast("map<string,string>"), value
    rows = entries.where(usable & token.rlike(TOKEN)).select(
        F.lit(provider).alias("provider"), token.alias("token"), titleise(token).alias("company"),
        extra.alias("extra"), F.coalesce(F.element_at(extra, "site"), F.lit("")).alias("_site"),
    )
    return first_per_key(rows, ["provider", "token", "_site"], [F.col("company")]).drop("_site")


# ------------------------------------------------------------------------ pages, threads


def page_links(pages: DataFrame, html: str, url: str) -> DataFrame:
    """One row per distinct link of a page, the page's own address included."""
    found = F.regexp_extract_all(html, F.lit(r"""(https?://[^\s"'<>\\)]+)"""), F.lit(1))
    every = F.array_union(F.array(url), found)
    clean = F.array_distinct(F.transform(every, lambda u: F.regexp_replace(u, TRAILING, "")))
    return pages.select(*[c for c in pages.columns if c not in (html, url)], F.explode(clean).alias("link"))


def careers_boards(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """(key, provider, token, extra): boards a careers page points to, each once.

    One Workday board per tenant is kept, the last link of the page deciding, as the
    page's own order has it.
    """
    links = page_links(pages.select(key, html, url), html, url)
    resolved = links.withColumn("r", resolve_url(F.col("link"))).where(F.col("r.status") == "supported")
    supported = resolved.select(key, "r.provider", "r.token", F.col("r.extra").alias("extra"))
    supported = first_per_key(supported, [key, "provider", "token"], [F.to_json("extra").asc_nulls_last()])
    spots = F.regexp_extract_all(html, F.lit(f"({WORKDAY_URL})"), F.lit(1))
    tenants = (
        pages.select(key, F.posexplode(spots).alias("_at", "link"))
        .select(key, "_at", workday_board(F.col("link")).alias("b"))
        .where(F.col("b").isNotNull())
        .groupBy(key, F.col("b.token").alias("token"))
        .agg(F.max_by("b.extra", "_at").alias("extra"))
        .select(key, F.lit("workday").alias("provider"), "token", "extra")
    )
    return supported.unionByName(tenants)


def thread_boards(comments: DataFrame, thread: str, text: str, order: str) -> DataFrame:
    """(thread, provider, token, extra): boards linked anywhere in a thread, each once."""
    plain = comments.select(thread, order, decode_entities(F.col(text)).alias("_text"))
    links = plain.select(
        thread, order,
        F.explode(F.regexp_extract_all("_text", F.lit(r"""(https?://[^\s"'<>]+)"""), F.lit(1))).alias("link"),
    )
    clean = F.regexp_replace(F.regexp_replace("link", TRAILING, ""), r"(?i)</?[a-z]+>?\z", "")
    resolved = links.withColumn("r", resolve_url(clean)).where(F.col("r.status") == "supported")
    rows = resolved.select(thread, order, "r.provider", "r.token", F.col("r.extra").alias("extra"))
    return first_per_key(rows, [thread, "provider", "token"], [F.col(order)]).drop(order)


def hiring_threads(stories: DataFrame, limit: int | None = None) -> DataFrame:
    """Hiring threads with a real discussion, all of them or with ``limit`` the newest so many."""
    chosen = stories.where(
        F.col("title").rlike(r"(?i)ask hn:\s*who is hiring\?") & (F.col("num_comments") > MIN_COMMENTS)
    )
    return chosen if limit is None else chosen.orderBy(F.col("created_at").desc(), "story_id").limit(limit)


def flatten_comments(items: DataFrame, thread: str = "thread", body: str = "body") -> DataFrame:
    """(thread, level, text) of every comment nested in JSON items, each with ``text`` and a list ``children``.

    Levels are opened one after the other until none has children; the item itself is level 0.
    Items that are no JSON objects have no text and no children, but stay.
    """
    level, found = 0, []
    rows = items.select(F.col(thread).alias("thread"), F.col(body).alias("_item"))
    while True:
        rows = checkpoint(rows)
        found.append(rows.select("thread", F.lit(level).alias("level"), F.get_json_object("_item", "$.text").alias("text")))
        listed = F.from_json(F.get_json_object("_item", "$.children"), "array<string>")
        rows, level = rows.select("thread", F.explode(listed).alias("_item")), level + 1
        if rows.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), found)


def thread_tree(items: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Add ``root`` and ``depth``: the item that each chain of replies starts from, and the steps to it.

    An item whose parent is null or not in the table is its own root, at depth 0.  Every round doubles
    the steps that an item looks up, so a chain of n replies takes log2(n) rounds; only items that have
    not reached their root go on.  Items that answer each other in a circle have no root: both columns
    are null, as for a null key.  Of rows that share a key the smallest parent counts.
    """
    links = items.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(parent).alias("_up"))
    links = checkpoint(links)
    there = links.select(F.col("_id").alias("_up"), F.lit(True).alias("_there"))
    up = links.join(there, "_up", "left")
    root = F.col("_there").isNull()
    start = up.select(
        "_id", F.when(root, F.col("_id")).otherwise(F.col("_up")).alias("_up"), F.when(root, 0).otherwise(1).alias("_steps"), root.alias("_top")
    )
    state, rounds = checkpoint(start), 0
    n, open_ = state.agg(F.count("*"), F.count_if(~F.col("_top"))).first()
    while open_ and rounds <= n.bit_length():
        ahead = state.select(
            F.col("_id").alias("_up"), F.col("_up").alias("_up2"), F.col("_steps").alias("_steps2"), F.col("_top").alias("_top2")
        )
        moved = state.where(~F.col("_top")).join(ahead, "_up").select(
            "_id", F.col("_up2").alias("_up"), (F.col("_steps") + F.col("_steps2")).alias("_steps"), F.col("_top2").alias("_top")
        )
        state, rounds = checkpoint(state.where("_top").unionByName(moved)), rounds + 1
        open_ = state.where(~F.col("_top")).count()
    reached = state.where("_top").select(F.col("_id").alias(key), F.col("_up").alias("root"), F.col("_steps").alias("depth"))
    kept = [c for c in items.columns if c not in ("root", "depth")]
    return items.select(*kept).join(reached, key, "left").select(*kept, "root", "depth")


# ------------------------------------------------------------------------ company names

# Feed name -> JSON path of the company inside one listed job.
NAME_FEEDS = {
    "themuse": ("$.results", "$.company.name"),
    "himalayas": ("$.jobs", "$.companyName"),
    "arbeitnow": ("$.data", "$.company_name"),
    "remotive": ("$.jobs", "$.company_name"),
    "remoteok": ("$", "$.company"),
    "jobicy": ("$.jobs", "$.companyName"),
}


def tidy_name(raw: Column) -> Column:
    """Company name without hiring noise, NULL for anonymous employers."""
    name = F.regexp_replace(raw, "(?i)\\s*[-–|]\\s*(remote|hiring|careers?|jobs?).*\\z", "")
    name = F.regexp_replace(name, r"(?i)\s*\((hiring|remote|yc[^)]*)\)\s*\z", "")
    name = F.trim(F.regexp_replace(name, r"\s+", " "))
    return let(
        name,
        lambda n: F.when(
            F.length(n).between(2, 60)
            & ~matches(n, r"^(confidential|undisclosed|private|n/a|various|multiple)$"),
            n,
        ),
    )


def company_names(feeds: DataFrame) -> DataFrame:
    """(source, name): distinct tidy names of each feed; ``feeds`` is (source, body)."""
    frames = []
    for source, (path, field) in NAME_FEEDS.items():
        rows = feeds.where(F.col("source") == source)
        listed = F.from_json(F.get_json_object("body", path), "array<string>")
        jobs = rows.select(F.posexplode(listed).alias("_i", "_job"))
        if source == "remoteok":  # its first entry is a notice, not a job
            jobs = jobs.where(F.col("_i") > 0)
        frames.append(
            jobs.select(F.lit(source).alias("source"), tidy_name(F.get_json_object("_job", field)).alias("name"))
        )
    names = reduce(lambda a, b: a.unionByName(b), frames)
    return names.where(F.col("name").isNotNull()).distinct()


