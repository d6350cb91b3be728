"""Quality rules: lines are judged first, failing lines go, then documents that lost too much.

Everything is built-in column work on the row itself: no shuffle, no Python.  Repeated windows
are found by sorting one number per word, so a document of any length costs n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.llm.common import GAP, WORD, computed, set_aside
from boardwalk.llm.registry import register, table

# Punctuation, separators of menus, and phrases of page furniture.  Both engines read them.
PUNCTUATION_RUN = r"[!-/:-@\[-`{-~]{2,}"
SEPARATOR_WORD = r"(?:^|[\x20\x09-\x0D])(?:\||>|>>|»|›|•|·|/|::)"
BOILERPLATE = (
    r"(?i)all rights reserved|(?:we|site|page) uses? cookies|accept (?:all )?cookies|privacy policy|terms of (?:use|service)"
    r"|enable javascript|subscribe to our newsletter|sign up for our newsletter|click here to|lorem ipsum"
)
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Thresholds.  Shares are of the words of the line, or of the document for ``max_lost``.

    Phrases of page furniture fail a line if they hold over ``max_furniture`` of its words.
    """

    max_punctuation_runs: float = 0.2
    max_separators: float = 0.25
    min_separators: int = 2
    max_lost: float = 0.3
    min_words: int = 50
    max_repeat_percent: int = 50
    max_furniture: float = 0.5


RULES = Rules()


def line_fails(line: Column, rules: Rules = RULES) -> Column:
    """True for a line of punctuation noise, of menu entries, or mostly of page furniture."""
    words = F.regexp_count(line, F.lit(WORD))
    runs = F.regexp_count(line, F.lit(PUNCTUATION_RUN))
    separators = F.regexp_count(line, F.lit(SEPARATOR_WORD))
    phrases = F.array_join(F.regexp_extract_all(line, F.lit(BOILERPLATE), F.lit(0)), " ")
    furniture = F.regexp_count(phrases, F.lit(WORD))
    return (
        (runs > words * F.lit(rules.max_punctuation_runs))
        | ((separators >= rules.min_separators) & (separators > words * F.lit(rules.max_separators)))
        | F.when(line.rlike(BOILERPLATE), furniture > words * F.lit(rules.max_furniture)).otherwise(False)
    )


def _repeated(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` to rows with ``_words``: words inside a 3-word window that occurs again.

    A window is a 64-bit hash.  Sorting (low bits of the hash, position) packed in one number
    leaves the positions that may repeat; those alone are then sorted by their whole hash.
    """
    n = F.size("_words")
    windows = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = computed(
        df.withColumn("_bits", F.ceil(F.log2(n + F.lit(2))).cast("int")),
        {"_windows": F.slice(windows, 1, F.greatest(n - 2, F.lit(0)))},
    ).drop("_words")
    bits, mask = F.col("_bits"), F.expr("shiftleft(1L, _bits) - 1")
    packed = F.transform(
        "_windows", lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))
    )
    df = computed(df, {"_codes": F.sort_array(packed), "_mask": mask})
    high = lambda x: F.call_function("shiftrightunsigned", x, bits)
    near = lambda x, i: high(x).eqNullSafe(high(F.get("_codes", i + 1))) | high(x).eqNullSafe(high(F.get("_codes", i - 1)))
    maybe = F.transform(
        F.filter("_codes", near),
        lambda x: x.bitwiseAND(F.col("_mask")).cast("int"),
    )
    df = computed(df, {"_maybe": maybe}).drop("_codes")
    again = F.array_sort(F.transform("_maybe", lambda p: F.struct(F.get("_windows", p).alias("h"), p.alias("p"))))
    df = computed(df, {"_again": again}).drop("_windows", "_maybe")
    same = lambda x, k: F.get("_again", k)["h"].eqNullSafe(x["h"])
    at = F.sort_array(F.transform(F.filter("_again", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["p"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    return df.withColumn("n_repeat_words", covered).drop("_again", "_bits", "_mask")


def judge(df: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """Add the measures, ``cleaned`` and ``kept`` to every row; no row is dropped.

    ``cleaned`` is the text without its failing lines (lines without a word stay); a null text stays
    null and counts as no words.  ``base_failed``: under ``min_words`` words, or over
    ``max_repeat_percent`` percent of words in repeated 3-word windows.  ``kept``: not base_failed,
    and the failing lines hold at most ``max_lost`` of the words.  Existing columns with the names
    of the results are replaced; any other column passes, whatever its name.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "cleaned", "kept"]
    df, names, others = set_aside(df, added)
    given = F.col(names[text])
    body = F.coalesce(given, F.lit(""))
    df = computed(
        df,
        {"_lines": F.split(body, "\n", -1), "_words": F.array_remove(F.split(body, GAP, -1), "")},
    )
    df = computed(
        df,
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "_full": F.filter("_lines", lambda x: x.rlike(WORD)),
            "_good": F.filter("_lines", lambda x: ~line_fails(x, rules)),
        },
    )
    df = computed(
        df,
        {
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "lost_words": F.col("n_words")
            - F.aggregate("_good", F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(WORD))).cast("long"),
            "cleaned": F.when(given.isNotNull(), F.array_join("_good", "\n")),
        },
    ).drop("_full", "_good", "_lines")
    df = _repeated(df)
    base = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    df = df.withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (F.col("lost_words") <= F.col("n_words") * F.lit(rules.max_lost))
    return df.withColumn("kept", kept).select(*others, *added)


def lost_sql(rules: Rules = RULES) -> str:
    """DuckDB condition that line ``x`` of ``n`` words fails."""
    count = lambda text, pattern: f"len(regexp_extract_all({text}, '{pattern}'))"
    phrases = f"array_to_string(regexp_extract_all(x, '{BOILERPLATE}'), ' ')"
    return f"""({count("x", PUNCTUATION_RUN)} > n * {rules.max_punctuation_runs}
        or ({count("x", SEPARATOR_WORD)} >= {rules.min_separators} and {count("x", SEPARATOR_WORD)} > n * {rules.max_separators})
        or {count(phrases, WORD)} > n * {rules.max_furniture})"""


def sql(rules: Rules = RULES) -> str:
    """DuckDB SQL for the columns of the query over a table ``documents``."""
    count = lambda text, pattern: f"len(regexp_extract_all({text}, '{pattern}'))"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{WORD}') as ws, string_split(t, chr(10)) as ls from d),
p as (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from p),
r as (select doc_id, count(distinct j) as n_repeat_words
      from (select doc_id, unnest([i, i + 1, i + 2]) as j from g where n > 1) group by doc_id),
l as (select doc_id, count(*) - count(distinct x) as n_dup_lines, sum(case when {lost_sql(rules)} then n else 0 end) as lost
      from (select doc_id, x, {count("x", WORD)} as n from (select doc_id, unnest(ls) as x from w)) where n > 0 group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        {count("t", SYMBOLS)}::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
      from w left join r using (doc_id) left join l using (doc_id)),
b as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and lost <= n_words * {rules.max_lost} as kept from b"""


@register("op5_quality_rules", sql())
def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
