"""One crawl as one job: landed pages to rows of the postings table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.geo import clean_location, country, us_state
from boardwalk.functions.labels import seniority_from_text
from boardwalk.functions.pay import annualise, salary_from_text, salary_usd
from boardwalk.functions.steps import computed, per_value
from boardwalk.operators.classify import TEXTS, is_quiet, verdicts, with_sector, with_sector_claims
from boardwalk.operators.keys import first_per_key
from boardwalk.operators.lifecycle import backfill_details, retained
from boardwalk.operators.score import with_board_size, with_scores
from boardwalk.schemas import MAX_AGE_DAYS, POSTINGS, names
from boardwalk.session import checkpoint
from boardwalk.sources.vendors import read_all


NO_ID = "no posting id"


def enrich(normalised: DataFrame, companies: DataFrame, now: Column) -> DataFrame:
    """Normalised postings with every derived column.

    ``companies`` is (provider, board_token, company), one row per board.  The board
    size counts what the board listed, so it is taken before old postings go; a column
    ``board_size`` that is there already is used.
    """
    board = ["provider", "board_token"]
    sized = normalised if "board_size" in normalised.columns else with_board_size(normalised, *board)
    fresh = retained(sized, now, MAX_AGE_DAYS).join(companies, board, "left")
    fresh = fresh.withColumns(
        {
            "company": F.coalesce("company", "board_token"),
            # null if a part is: such rows have no identity and are rejected, not merged into one
            "key": F.concat("provider", F.lit(":"), "board_token", F.lit(":"), "external_id"),
        }
    )
    asked = fresh.withColumns(
        {"_unpriced": F.col("salary_min").isNull() & F.col("salary_max").isNull(), "_unlevelled": F.col("seniority").isNull()}
    )
    judged = with_sector(per_value(asked, [*TEXTS, "_unpriced", "_unlevelled"], _from_texts))
    scored = with_scores(judged, now)
    currency = F.coalesce("salary_currency", "parsed_pay.currency")
    out = computed(
        scored,
        {
            "salary_currency": currency,
            "_low": F.coalesce(annualise(F.col("salary_min"), currency), F.col("parsed_pay.min")),
            "_high": F.coalesce(annualise(F.col("salary_max"), currency), F.col("parsed_pay.max")),
            "_country": country("location", "country"),
            "_state": us_state("location", "country"),
            "_shown": clean_location(F.col("location")),
            "seniority": F.coalesce("seniority", "level_read"),
        },
    )
    return out.withColumns(
        {
            "salary_min": F.col("_low"), "salary_max": F.col("_high"), "country": F.col("_country"),
            "region": F.col("_state"), "location": F.col("_shown"),
            "quiet": is_quiet(F.col("title")),
            # Every skill the posting names; adjacent and unsorted rows carry none.
            "matched_skills": F.when(F.size("all_skills") > 0, F.col("all_skills")).otherwise(F.col("matched_skills")),
            "skill_score": F.col("score"),
            "salary_usd": salary_usd(F.col("_low"), F.col("_high"), F.col("salary_currency")),
            "first_seen_at": now, "last_seen_at": now,
            "closed_at": F.lit(None).cast("timestamp_ntz"),
        }
    ).drop("_low", "_high", "_country", "_state", "_shown", "_unpriced", "_unlevelled", "level_read", "parsed_pay")


def _from_texts(texts: DataFrame) -> DataFrame:
    """All that follows from a title and a description; pay and level only where the posting has none."""
    asked = [F.struct("_unpriced", "_unlevelled").alias("asked")]  # verdicts drop columns that begin with "_"
    judged = verdicts(texts.select(*TEXTS, *asked))
    judged = with_sector_claims(judged, F.col("core_family").isNotNull())
    judged = computed(
        judged,
        {
            "parsed_pay": F.when(F.col("asked._unpriced"), salary_from_text(F.col("description"))),
            "level_read": F.when(F.col("asked._unlevelled"), seniority_from_text(F.col("description"))),
        },
    )
    return judged.select("*", "asked._unpriced", "asked._unlevelled").drop("asked")


def stored_rows(enriched: DataFrame) -> DataFrame:
    """The in-scope part in the postings schema, one row per key: the first one listed."""
    kept = enriched.where(F.col("family").isNotNull() & F.col("key").isNotNull())
    return first_per_key(kept, ["key"], [F.col("page"), F.col("pos")]).select(*names(POSTINGS))


def rejected_rows(enriched: DataFrame) -> DataFrame:
    """What the crawl threw away, for the exclusion tally; rows without an id among them."""
    lost = F.col("key").isNull()
    return enriched.where(F.col("family").isNull() | lost).select(
        F.when(~lost, F.col("family")).alias("family"),
        F.when(lost, F.lit(NO_ID)).otherwise(F.col("excluded_reason")).alias("excluded_reason"),
        "title", "company", "page", "pos",
    )


def crawl(
    pages: DataFrame, companies: DataFrame, details: DataFrame | None, now: Column,
    providers: list[str] | None = None, partitions: int | None = None,
) -> DataFrame:
    """Landed pages of one run to enriched postings.

    ``details`` fill rows inside the window that lack a text or a date; the window applies
    again to what they bring.  ``partitions`` deals the pages out anew, for few large files.
    The parsed postings are kept once in the shared checkpoint folder: board sizes and
    the rules both read them, and a lost executor re-reads them instead of parsing the
    payloads again.
    """
    dealt = pages if partitions is None else pages.repartition(partitions)
    rows = checkpoint(read_all(dealt, now, providers))
    board = ["provider", "board_token"]
    if details is not None:
        sized = retained(with_board_size(rows, *board), now, MAX_AGE_DAYS)
        return enrich(backfill_details(sized, details, ["page", "pos"]), companies, now)
    return enrich(rows, companies, now)
