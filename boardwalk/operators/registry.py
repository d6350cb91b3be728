"""The board registry: merging, blocking, health, duplicates, revival."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.text import failure_reason, titleise
from boardwalk.functions.urls import board_identity, board_site
from boardwalk.operators.keys import first_per_key
from boardwalk.operators.ordered import running_sums
from boardwalk.session import written

MAX_FAILURES = 5
DEFAULT_MAX_JOBS = 300
BLOCK_SUSPICION = 20


def with_identity(boards: DataFrame) -> DataFrame:
    return boards.withColumn(
        "identity", board_identity(F.col("provider"), F.col("token"), F.col("extra"))
    )


def without_blocked(boards: DataFrame, blocked: DataFrame) -> DataFrame:
    """Anti join on (provider, lower-case token)."""
    names = blocked.select("provider", F.lower("token").alias("_t")).distinct()
    return (
        boards.withColumn("_t", F.lower("token"))
        .join(names, ["provider", "_t"], "left_anti")
        .select(*boards.columns)
    )


def fresh_boards(candidates: DataFrame, known: DataFrame, order: list[Column]) -> DataFrame:
    """Candidates the registry does not know, one per identity."""
    new = with_identity(candidates).join(
        with_identity(known).select("identity").distinct(), "identity", "left_anti"
    )
    return first_per_key(new, ["identity"], order).select(*candidates.columns)


def known_boards(registered: DataFrame, retired: DataFrame) -> DataFrame:
    """Active boards and those switched off on purpose."""
    columns = ["provider", "token", "extra"]
    return registered.select(*columns).unionByName(
        retired.where(deliberate_retirement()).select(*columns)
    )


def deliberate_retirement() -> Column:
    return F.coalesce(F.col("last_error").rlike(r"(?i)^\s*duplicate (spelling|site) of "), F.lit(False))


def merge_files(from_file: DataFrame, from_registry: DataFrame) -> DataFrame:
    """Union by identity; the registry wins.  Both sides hold one row per identity."""
    columns = [c for c in from_file.columns]
    left = with_identity(from_file).select("identity", F.struct(*columns).alias("f"))
    right = with_identity(from_registry.select(*columns)).select(
        "identity", F.struct(*columns).alias("r")
    )
    joined = left.join(right, "identity", "full_outer")
    return joined.select(F.coalesce("r", "f").alias("b")).select("b.*")


def shortest_name(boards: DataFrame) -> DataFrame:
    """One row per (provider, token): the shortest company name, the first on ties."""
    return first_per_key(
        boards, ["provider", "token"], [F.length("company").asc(), F.col("ord").asc()]
    )


def max_jobs(extra: Column) -> Column:
    """Per-board posting cap: stated in ``extra``, else the default."""
    stated = F.element_at(extra, "maxJobs").try_cast("int")
    return F.when(stated > 0, stated).otherwise(DEFAULT_MAX_JOBS)


def upsert_boards(
    boards: DataFrame, incoming: DataFrame, blocked: DataFrame, order: Column, now: Column
) -> DataFrame:
    """Store live boards: blocked ones refused, the last per identity wins, health reset."""
    allowed = with_identity(without_blocked(incoming, blocked))
    rest = [c for c in allowed.columns if c != "identity"]
    latest = allowed.groupBy("identity").agg(F.max_by(F.struct(*rest), order).alias("n"))
    old = with_identity(boards).select("identity", F.struct(*boards.columns).alias("o"))
    joined = old.join(latest, "identity", "full_outer")
    hit = F.col("n").isNotNull()

    def take(name: str, default=None) -> Column:
        value = F.col(f"n.{name}") if name in rest else F.lit(None)
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        return F.when(hit, value).otherwise(F.col(f"o.{name}")).alias(name)

    def reset(name: str, value: Column) -> Column:
        return F.when(hit, value).otherwise(F.col(f"o.{name}")).alias(name)

    kept = F.col("o.last_error").alias("last_error")
    crawled = F.col("o.last_crawled_at").alias("last_crawled_at")
    out = {
        "active": reset("active", F.lit(True)), "source": take("source", "manual"),
        "job_count": take("job_count", 0), "consecutive_failures": reset("consecutive_failures", F.lit(0)),
        "last_error": kept, "last_ok_at": reset("last_ok_at", now), "last_crawled_at": crawled,
        "verified_at": reset("verified_at", now),
    }
    return joined.select(*[out.get(c, take(c)) for c in boards.columns])


# ------------------------------------------------------------------------------ health


def apply_outcomes(
    boards: DataFrame, outcomes: DataFrame, now: Column,
    may_retire: bool = False, max_failures: int = MAX_FAILURES,
) -> DataFrame:
    """One crawl's outcomes onto the registry.

    A good answer clears the whole token.  A refusal only notes the reason.  A board
    that is gone counts a failure for its own site, when the caller may retire boards,
    and goes inactive at ``max_failures``.
    """
    ok = F.col("error").isNull()
    gone = ~ok & (F.col("failure") == "gone") & F.lit(may_retire)
    rows = outcomes.withColumns(
        {"_kind": F.when(ok, "ok").when(gone, "gone").otherwise("refused"),
         "_reason": failure_reason(F.col("error"))}
    )
    by_token = rows.groupBy("provider", "token").agg(
        F.bool_or(F.col("_kind") == "ok").alias("_ok"),
        F.min(F.when(F.col("_kind") == "refused", F.col("_reason"))).alias("_refused"),
    )
    by_site = (
        rows.where(F.col("_kind") == "gone")
        .groupBy("provider", "token", F.coalesce("site", F.lit("")).alias("_site"))
        .agg(F.min("_reason").alias("_gone"))
    )
    joined = (
        boards.withColumn("_site", board_site(F.col("extra")))
        .join(by_token, ["provider", "token"], "left")
        .join(by_site, ["provider", "token", "_site"], "left")
    )
    fine = F.coalesce("_ok", F.lit(False))
    failures = F.when(fine, 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)))
    failures = F.when(F.col("_gone").isNotNull(), failures + 1).otherwise(failures)
    heard = fine | F.col("_refused").isNotNull() | F.col("_gone").isNotNull()
    return joined.withColumns(
        {
            "last_crawled_at": F.when(heard, now).otherwise(F.col("last_crawled_at")),
            "last_ok_at": F.when(fine, now).otherwise(F.col("last_ok_at")),
            "consecutive_failures": failures,
            "last_error": F.coalesce("_gone", "_refused", F.when(~fine, F.col("last_error"))),
            "active": F.col("active")
            & ~(F.col("_gone").isNotNull() & (failures >= max_failures)),
        }
    ).select(*boards.columns)


def fold_outcomes(
    boards: DataFrame, outcomes: DataFrame, at: str = "at", may_retire: bool = False, max_failures: int = MAX_FAILURES
) -> DataFrame:
    """The outcomes of any number of crawls onto the registry: ``apply_outcomes`` crawl by crawl, at once.

    Rows with the same ``at`` are one crawl; rows without a time are left out.  What a board heard is
    summed up as: failures before its first good answer, failures after its last, the most in a row
    from a good answer on, whether there was one, and its last reason and times.  Such sums can be
    joined to the board's stored state, which is how it goes on from there.  Good answers are
    numbered by running sums, so a board may have been crawled any number of times.
    """
    board = ["provider", "token", "_site"]
    ok = F.col("error").isNull()
    gone = ~ok & (F.col("failure") == "gone") & F.lit(may_retire)
    rows = outcomes.where(F.col(at).isNotNull()).select(
        "provider", "token", F.coalesce("site", F.lit("")).alias("_site"), F.col(at).alias("_at"),
        F.when(ok, "ok").when(gone, "gone").otherwise("refused").alias("_kind"),
        failure_reason(F.col("error")).alias("_reason"),
    )
    by_token = rows.groupBy("provider", "token", "_at").agg(
        F.bool_or(F.col("_kind") == "ok").alias("_ok"),
        F.min(F.when(F.col("_kind") == "refused", F.col("_reason"))).alias("_refused"),
    )
    by_site = rows.where(F.col("_kind") == "gone").groupBy(*board, "_at").agg(F.min("_reason").alias("_gone"))
    sited = boards.withColumn("_site", board_site(F.col("extra")))
    events = (
        sited.select(*board).distinct().join(by_token, ["provider", "token"])
        .join(by_site, [*board, "_at"], "left")
        .where(F.col("_ok") | F.col("_refused").isNotNull() | F.col("_gone").isNotNull())
    )
    numbered = running_sums(events, board, [F.col("_at")], {"_before": F.col("_ok").cast("long")})
    runs = numbered.withColumn("_run", F.col("_before") + F.col("_ok").cast("long")).groupBy(*board, "_run").agg(
        F.count("_gone").alias("_n"),
        F.max(F.when(F.col("_ok"), F.col("_at"))).alias("_ok_at"),
        F.max("_at").alias("_heard"),
        F.max_by(F.struct(F.coalesce("_gone", "_refused").alias("said")), "_at").alias("_last"),
    )
    heard = runs.groupBy(*board).agg(
        F.sum(F.when(F.col("_run") == 0, F.col("_n"))).alias("_head"),
        F.max_by("_n", "_run").alias("_tail"),
        F.max(F.when(F.col("_run") > 0, F.col("_n"))).alias("_most"),
        F.max("_run").alias("_oks"),
        F.max("_ok_at").alias("_ok_at"),
        F.max("_heard").alias("_heard"),
        F.max_by("_last", "_heard").alias("_last"),
    )
    joined = sited.join(heard, board, "left")
    some, fine = F.col("_heard").isNotNull(), F.coalesce(F.col("_oks") > 0, F.lit(False))
    stored = F.coalesce("consecutive_failures", F.lit(0))
    first = stored + F.coalesce("_head", F.lit(0))
    retired = ((F.coalesce("_head", F.lit(0)) > 0) & (first >= max_failures)) | (F.coalesce("_most", F.lit(0)) >= max_failures)
    kinds = dict(boards.dtypes)
    return joined.withColumns(
        {
            "last_crawled_at": F.coalesce("_heard", "last_crawled_at"),
            "last_ok_at": F.coalesce("_ok_at", "last_ok_at"),
            "consecutive_failures": F.when(fine, F.col("_tail")).otherwise(first).cast(kinds["consecutive_failures"]),
            "last_error": F.when(some, F.col("_last.said")).otherwise(F.col("last_error")),
            "active": F.col("active") & ~retired,
        }
    ).select(*boards.columns)


def health_history(
    outcomes: DataFrame, at: str, tie: str, max_failures: int = MAX_FAILURES, chunk: str = "DAY"
) -> DataFrame:
    """Final health per board from its whole history at once.

    Each board's history is cut into time slices that are summarised side by side:
    failures before the first good answer, after the last, and the longest run inside.
    The few slice rows per board are then joined up in order, so a board with very many
    outcomes is never walked by one task.
    """
    from pyspark.sql import Window

    board = ["provider", "token"]
    ok = F.col("error").isNull()
    gone = F.when(~ok & (F.col("failure") == "gone"), 1).otherwise(0)
    rows = outcomes.select(
        *board, F.date_trunc(chunk, F.col(at)).alias("_slice"),
        F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")).alias("_o"),
        ok.alias("_ok"), gone.alias("_gone"),
        F.when(~ok, failure_reason(F.col("error"))).alias("_reason"),
    )
    inner = Window.partitionBy(*board, "_slice").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("_run", F.sum(F.col("_ok").cast("int")).over(inner))
    per_run = runs.groupBy(*board, "_slice", "_run").agg(
        F.sum("_gone").alias("_n"),
        F.max("_o").alias("_o"),
        F.max(F.when(F.col("_ok"), F.col("_o"))).alias("_ok_at"),
        F.max_by(F.struct("_ok", "_reason"), "_o").alias("_last"),
    )
    slices = per_run.groupBy(*board, "_slice").agg(
        F.max("_run").alias("_oks"),
        F.min_by("_n", "_run").alias("_first_n"),
        F.min("_run").alias("_first_run"),
        F.max_by("_n", "_run").alias("_last_n"),
        F.max("_n").alias("_most"),
        F.max("_ok_at").alias("_ok_at"),
        F.max_by("_last", "_o").alias("_last"),
    )
    entries = slices.groupBy(*board).agg(
        F.array_sort(
            F.collect_list(
                F.struct("_slice", "_oks", "_first_run", "_first_n", "_last_n", "_most", "_ok_at", "_last")
            )
        ).alias("s")
    )
    folded = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("most")),
        lambda state, x: F.struct(
            F.when(x["_oks"] == 0, state["n"] + x["_last_n"]).otherwise(x["_last_n"]).alias("n"),
            F.greatest(
                state["most"], x["_most"],
                state["n"] + F.when(x["_first_run"] == 0, x["_first_n"]).otherwise(0),
            ).alias("most"),
        ),
    )
    last = F.element_at("s", -1)["_last"]
    return entries.withColumn("f", folded).select(
        *board,
        F.col("f.n").alias("consecutive_failures"),
        (F.col("f.most") < max_failures).alias("active"),
        F.when(~last["_ok"], last["_reason"]).alias("last_error"),
        F.array_max(F.transform("s", lambda x: x["_ok_at"]["at"])).alias("last_ok_at"),
    )


def failure_groups(failed: DataFrame, boards: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """(failures, reason, site, retire, boards): how many boards get each update.

    Each (token, site) counts once, with its first error; unknown boards are left out.
    """
    first = failed.groupBy("provider", "token", F.coalesce("site", F.lit("")).alias("site")).agg(
        F.min_by("error", "ord").alias("error")
    )
    known = boards.select(
        "provider", "token", board_site(F.col("extra")).alias("site"), "consecutive_failures"
    )
    joined = first.join(known, ["provider", "token", "site"])
    failures = F.coalesce("consecutive_failures", F.lit(0)) + 1
    return (
        joined.groupBy(
            failures.alias("failures"), failure_reason(F.col("error")).alias("reason"), "site"
        )
        .agg(F.count("*").alias("boards"))
        .withColumn("retire", F.col("failures") >= max_failures)
    )


def reasons_by_token(failed: DataFrame) -> DataFrame:
    """(reason, boards): each token once, under its first reason."""
    first = failed.groupBy("provider", "token").agg(F.min_by("error", "ord").alias("error"))
    return first.groupBy(failure_reason(F.col("error")).alias("reason")).agg(
        F.count("*").alias("boards")
    )


def stalest(boards: DataFrame, limit: int) -> DataFrame:
    return (
        boards.where("active")
        .orderBy(F.col("last_ok_at").asc_nulls_first(), "token", "provider")
        .limit(limit)
    )


# ----------------------------------------------------------------------- verification


def verification_summary(results: DataFrame) -> DataFrame:
    """(answer, n, live, dead, unclear, blocked): what the vendors answered.

    ``blocked`` warns that a large batch with not one live board looks like being
    turned away rather than like dead boards.
    """
    answer = F.when(F.col("status").isNull(), "transport error (no response)").otherwise(
        F.concat(F.lit("HTTP "), F.col("status").cast("string"))
    )
    grouped = results.groupBy(answer.alias("answer")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("verdict") == "live").alias("live"),
        F.count_if(F.col("verdict") == "dead").alias("dead"),
        F.count_if(F.col("verdict") == "unknown").alias("unclear"),
    )
    total = grouped.agg(F.sum("n").alias("_all"), F.sum("live").alias("_live"))
    return grouped.join(F.broadcast(total), F.col("n") <= F.col("_all")).select(
        *grouped.columns,
        ((F.col("_all") >= BLOCK_SUSPICION) & (F.col("_live") == 0)).alias("blocked"),
    )


def verdict_outcomes(verdicts: DataFrame) -> DataFrame:
    """Verification verdicts as crawl outcomes; unknown verdicts record nothing."""
    from boardwalk.functions.text import failure_kind

    dead = F.col("verdict") == "dead"
    return verdicts.where(F.col("verdict") != "unknown").select(
        "provider", "token", "site",
        F.when(dead, 0).otherwise(F.col("jobs")).cast("int").alias("jobs"),
        F.when(dead, "").alias("error"),
        F.when(dead, failure_kind(F.col("status"))).alias("failure"),
    )


def revive(boards: DataFrame, verdicts: DataFrame, blocked: DataFrame) -> DataFrame:
    """Retired boards that answer and parse come back, unless retired on purpose or blocked."""
    candidates = without_blocked(
        boards.where(~F.col("active") & ~deliberate_retirement()), blocked
    )
    live = verdicts.where((F.col("verdict") == "live") & F.col("parsed"))
    back = (
        candidates.join(live.select("provider", "token").distinct(), ["provider", "token"], "left_semi")
        .select("provider", "token").distinct().withColumn("_back", F.lit(True))
    )
    joined = boards.join(back, ["provider", "token"], "left")
    yes = F.col("_back").isNotNull()
    return joined.withColumns(
        {
            "active": F.col("active") | yes,
            "consecutive_failures": F.when(yes, 0).otherwise(F.col("consecutive_failures")),
            "last_error": F.when(~yes, F.col("last_error")),
        }
    ).select(*boards.columns)


def adopt(seed: DataFrame, boards: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Seed boards the registry misses: live and unclear go active, dead ones are recorded."""
    missing = with_identity(seed).join(
        with_identity(boards).select("identity").distinct(), "identity", "left_anti"
    )
    asked = with_identity(verdicts).select("identity", "verdict", "status", "jobs")
    joined = missing.join(asked, "identity")
    dead = F.col("verdict") == "dead"
    reason = F.concat(
        F.lit("adopted from the seed file, verified gone "), F.date_format(now, "yyyy-MM-dd"),
        F.lit(" (HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("?")), F.lit(")"),
    )
    return joined.select(
        "provider", "token", "company", "extra",
        (~dead).alias("active"), F.lit("seed-file").alias("source"),
        F.when(dead, 0).otherwise(F.col("jobs")).cast("int").alias("job_count"),
        F.when(dead, reason).alias("last_error"),
        now.alias("verified_at"),
    )


def site_clashes(seed: DataFrame, boards: DataFrame) -> DataFrame:
    """Tenants the seed file and the registry hold under different sites."""
    left = seed.where(F.col("provider") == "workday").select(
        "provider", "token", board_site(F.col("extra")).alias("file_site")
    )
    right = boards.select(
        "provider", F.lower("token").alias("_t"), board_site(F.col("extra")).alias("registry_site")
    )
    joined = left.withColumn("_t", F.lower("token")).join(right, ["provider", "_t"])
    return joined.where(
        (F.col("file_site") != "") & (F.lower("file_site") != F.lower("registry_site"))
    ).drop("_t")


# -------------------------------------------------------------------------- duplicates


def duplicate_spellings(boards: DataFrame, postings: DataFrame) -> DataFrame:
    """(provider, identity, token, jobs, keep): spellings of one board, best first.

    The spelling with most open postings is kept; ties go to the first by name.
    """
    open_jobs = (
        postings.where(F.col("closed_at").isNull())
        .groupBy("provider", F.col("board_token").alias("token"))
        .agg(F.count("*").alias("jobs"))
    )
    spelled = with_identity(boards.where("active")).select("provider", "identity", "token").distinct()
    several = (
        spelled.groupBy("identity").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("identity")
    )
    groups = spelled.join(several, "identity").join(open_jobs, ["provider", "token"], "left")
    groups = groups.withColumn("jobs", F.coalesce("jobs", F.lit(0)))
    best = groups.groupBy("identity").agg(
        F.min_by("token", F.struct(-F.col("jobs"), F.col("token"))).alias("keep")
    )
    return groups.join(best, "identity").select("provider", "identity", "token", "jobs", "keep")


def retire_duplicates(
    boards: DataFrame, postings: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """(boards, postings) after losing spellings are switched off and closed."""
    losers = (
        duplicate_spellings(boards, postings).where(F.col("token") != F.col("keep"))
        .groupBy("provider", "token").agg(F.min("keep").alias("_keep"))
    )
    orphans = orphan_spellings(boards, postings).select("provider", F.col("token").alias("board_token"))
    off = boards.join(losers, ["provider", "token"], "left")
    lost = F.col("_keep").isNotNull()
    new_boards = off.withColumns(
        {
            "active": F.col("active") & ~lost,
            "last_error": F.when(
                lost, F.concat(F.lit("duplicate spelling of "), F.col("_keep"))
            ).otherwise(F.col("last_error")),
        }
    ).select(*boards.columns)
    closing = (
        losers.select("provider", F.col("token").alias("board_token")).unionByName(orphans).distinct()
        .withColumn("_close", F.lit(True))
    )
    return new_boards, _close_boards(postings, closing, now)


def _close_boards(postings: DataFrame, boards: DataFrame, now: Column) -> DataFrame:
    joined = postings.join(boards, ["provider", "board_token"], "left")
    closing = F.col("closed_at").isNull() & F.col("_close").isNotNull()
    return joined.withColumn(
        "closed_at", F.when(closing, now).otherwise(F.col("closed_at"))
    ).select(*postings.columns)


def orphan_spellings(boards: DataFrame, postings: DataFrame) -> DataFrame:
    """(provider, token, keep): open postings under a spelling the registry does not carry."""
    active = boards.where("active").groupBy("provider", F.lower("token").alias("_t")).agg(
        F.max("token").alias("keep"), F.collect_set("token").alias("_all")
    )
    used = postings.where(F.col("closed_at").isNull()).select(
        "provider", F.col("board_token").alias("token")
    ).distinct()
    joined = used.withColumn("_t", F.lower("token")).join(active, ["provider", "_t"])
    return joined.where(~F.array_contains("_all", F.col("token"))).select("provider", "token", "keep")


def block_board(
    boards: DataFrame, postings: DataFrame, blocked: DataFrame, targets: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boards, postings, blocked) after blocking ``targets`` (provider, token, reason)."""
    names = targets.select("provider", "token").distinct()
    new_blocked = blocked.join(names, ["provider", "token"], "left_anti").unionByName(
        targets.select(*blocked.columns)
    )
    hit = names.withColumn("_hit", F.lit(True))
    new_boards = boards.join(hit, ["provider", "token"], "left").withColumn(
        "active", F.col("active") & F.col("_hit").isNull()
    ).select(*boards.columns)
    closing = names.select("provider", F.col("token").alias("board_token"), F.lit(True).alias("_close"))
    return new_boards, _close_boards(postings, closing, now), new_blocked


def unblock(blocked: DataFrame, targets: DataFrame) -> DataFrame:
    return blocked.join(targets, ["provider", "token"], "left_anti")


def site_prints(site_ids: DataFrame) -> DataFrame:
    """(tenant, site, n, h1, h2): size, sum and xor of two independent 64-bit hashes of a site's distinct ids.

    All of them add up map-side, so ids are never collected.  Sites without an id have no row.
    """
    return site_ids.where(F.col("id").isNotNull()).select("tenant", "site", "id").distinct().groupBy("tenant", "site").agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("b"), "id")).alias("h2"),
    )


_PRINT = ["tenant", "n", "h1", "h2"]


def _keepers(prints: DataFrame) -> DataFrame:
    """The site to keep of each set of ids: a named one before the default address, then the first by name."""
    named = F.when(F.upper("site") == "CX", 1).otherwise(0)
    return prints.groupBy(*_PRINT).agg(
        F.min_by("site", F.struct(named, F.col("site"))).alias("kept_site"), F.count("*").alias("_k")
    )


def _proven(pairs: DataFrame, ids: DataFrame, kept_ids: DataFrame) -> DataFrame:
    """Pairs (tenant, site, kept_site, n) whose ids are equal one by one, so a hash coincidence cannot pass."""
    mine = ids.join(pairs, ["tenant", "site"])
    theirs = kept_ids.select("tenant", F.col("site").alias("kept_site"), "id").withColumn("_same", F.lit(1))
    both = (
        mine.join(theirs, ["tenant", "kept_site", "id"])
        .groupBy("tenant", "site", "kept_site", "n")
        .agg(F.count("*").alias("_same"))
    )
    return both.where(F.col("_same") == F.col("n")).select("tenant", "site", "kept_site")


def site_aliases(site_ids: DataFrame) -> DataFrame:
    """(tenant, site, kept_site): sites of a tenant that list exactly the same ids."""
    ids = site_ids.select("tenant", "site", "id").distinct()
    prints = site_prints(ids)
    pairs = (
        prints.join(_keepers(prints).where(F.col("_k") > 1), _PRINT)
        .where(F.col("site") != F.col("kept_site"))
        .select("tenant", "site", "kept_site", "n")
    )
    return _proven(pairs, ids, ids)


def alias_guard(candidate_ids: DataFrame, registered_ids: DataFrame, registered_prints: DataFrame | None = None) -> DataFrame:
    """(tenant, site, copy_of): candidate sites that must not be stored, as they list what another site lists.

    Both sides hold (tenant, site, id).  A copy of a registered site goes whatever its name; of
    copies among the newcomers one stays, by the rule of ``site_aliases``.  Registered sites never
    go.  A site without ids is a copy of nothing.  ``registered_prints`` are stored ``site_prints``;
    with them only the ids of sites whose prints agree are read.  Tenants are compared in lower case.
    """
    lower = F.lower("tenant").alias("tenant")
    new = candidate_ids.select(lower, "site", "id").distinct()
    old = registered_ids.select(lower, "site", "id").distinct()
    stored = site_prints(old) if registered_prints is None else registered_prints.withColumn("tenant", F.lower("tenant"))
    twins = site_prints(new).join(_keepers(stored), _PRINT).select("tenant", "site", "kept_site", "n")
    copies = _proven(twins, new, old)
    rest = new.join(copies, ["tenant", "site"], "left_anti")
    return copies.unionByName(site_aliases(rest)).withColumnRenamed("kept_site", "copy_of")


def store_discovered(
    boards: DataFrame, candidates: DataFrame, site_ids: DataFrame, blocked: DataFrame, order: Column, now: Column
) -> DataFrame:
    """The registry after discovery: live candidates it did not know, without copies of its sites, stored.

    ``candidates`` carry a ``verdict``; only 'live' ones are stored.  ``site_ids`` (tenant, site, id)
    tells what the sites of the 'oracle' boards list, registered and new.  Boards switched off as
    duplicates count as known, so they never come back.
    """
    known = known_boards(boards.where("active"), boards.where("not active"))
    live = candidates.where(F.col("verdict") == "live").drop("verdict")
    fresh = written(fresh_boards(live, known, [order]), "fresh")

    def places(df: DataFrame) -> DataFrame:
        oracle = df.where(F.col("provider") == "oracle")
        return oracle.select(F.lower("token").alias("tenant"), board_site(F.col("extra")).alias("site")).distinct()

    # the guard reads ids several times; what they come from is read once
    ids = written(site_ids.select(F.lower("tenant").alias("tenant"), "site", "id").distinct(), "site_ids")
    of = lambda df: ids.join(places(df), ["tenant", "site"], "left_semi")
    copies = alias_guard(of(fresh), of(boards.where("active"))).select("tenant", F.col("site").alias("_site"))
    kept = fresh.withColumns(
        {"tenant": F.when(F.col("provider") == "oracle", F.lower("token")), "_site": board_site(F.col("extra"))}
    ).join(copies, ["tenant", "_site"], "left_anti")
    return upsert_boards(boards, kept.select(*fresh.columns), blocked, order, now)


def per_provider_gap(candidates: DataFrame, fresh: DataFrame) -> DataFrame:
    """(provider, in_dataset, net_new)."""
    have = candidates.groupBy("provider").agg(F.count("*").alias("in_dataset"))
    gap = fresh.groupBy("provider").agg(F.count("*").alias("net_new"))
    return have.join(gap, "provider", "full_outer").select(
        "provider",
        F.coalesce("in_dataset", F.lit(0)).alias("in_dataset"),
        F.coalesce("net_new", F.lit(0)).alias("net_new"),
    )


def default_company(boards: DataFrame) -> DataFrame:
    return boards.withColumn("company", F.coalesce("company", titleise(F.col("token"))))


def url_coverage(resolved: DataFrame) -> DataFrame:
    """(platform, tier, n, boards): how many links each platform accounts for."""
    platform = F.coalesce("platform", F.concat(F.lit("unknown:"), "host"))
    board = F.when(F.col("status") == "supported", F.struct("provider", "token"))
    return (
        resolved.withColumns({"_platform": platform, "_board": board})
        .groupBy(F.col("_platform").alias("platform"), "tier", "_board")
        .agg(F.count("*").alias("_n"))
        .groupBy("platform", "tier")
        .agg(F.sum("_n").alias("n"), F.count("_board").alias("boards"))
    )
