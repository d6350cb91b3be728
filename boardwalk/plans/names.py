"""Company names of boards from their landed pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.text import company_from_raw, repaired_name
from boardwalk.operators.keys import first_per_key
from boardwalk.sources.vendors import company_from_title, eightfold_company, icims_company, oracle_company


def company_of(provider: Column, body: Column) -> Column:
    """Company a landed page states: by the vendor's own field, else by the title of a careers page."""
    return (
        F.when(provider == "oracle", F.coalesce(oracle_company(body), company_from_title(body)))
        .when(provider == "eightfold", eightfold_company(body))
        .when(provider == "icims", icims_company(body))
        .when(F.startswith(F.ltrim(body), F.lit("<")), company_from_title(body))
        .otherwise(company_from_raw(body))
    )


def name_boards(boards: DataFrame, pages: DataFrame) -> DataFrame:
    """Boards with placeholder names replaced by what the first page that states a name says.

    A placeholder is no name, or the token plain or in title case; other names stay.  Pages meet
    boards by (provider, lower-case token); boards without pages stay as they are.
    """
    stated = pages.select("provider", F.lower("board_token").alias("_t"), "page", company_of(F.col("provider"), F.col("body")).alias("_found"))
    found = first_per_key(stated.where("_found is not null"), ["provider", "_t"], [F.col("page"), F.col("_found")]).drop("page")
    out = boards.withColumn("_t", F.lower("token")).join(found, ["provider", "_t"], "left")
    return out.withColumn("company", repaired_name(F.col("company"), F.col("_found"), F.col("token"))).select(*boards.columns)
