"""Texts against a dictionary of patterns of any size, kept as a table.

Most patterns can only hold where the text has a certain word.  Those words are read off the patterns
with column functions, texts meet patterns by an equality join on words, and only the pairs that meet
are tested.  Patterns that match inside one word are tested on the words, each word once however many
texts hold it.  No rule passes through the driver and no text is read once for each rule.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.match import BOUNDARY, folded
from boardwalk.functions.steps import computed
from boardwalk.session import shared_folder

_ANY, _EDGE = "\u0001", "\u0002"  # some unknown text; a word boundary
_TOKEN = "[a-z0-9_]+"
_NESTING = 4
_TIMES = r"(?:[?*+]|\{[^{}]*\})[?+]?"
_GRAM, _LONGEST = 3, 8
# Letters, digits, groups and repetition only: a match lies inside one word and is one of that word alone.
_IN_ONE_WORD = r"^(?:[A-Za-z0-9_]|\\[bwd]|\((?:\?:)?|[|)*+?]|\{[0-9,]+\})+\z"


def java_patterns(pattern: Column) -> Column:
    """As ``match.java_pattern``, for a column of patterns."""
    out = F.replace(F.regexp_replace(pattern, r"\$\z", r"\\z"), F.lit("$|"), F.lit(r"\z|"))
    plain = F.concat(F.lit("(?i)"), out)
    accented = F.concat(F.lit("(?iu)"), F.replace(out, F.lit(r"\b"), F.lit(BOUNDARY)))
    return F.when(out.rlike("[^\\x00-\\x7f\u2013\u2014]"), accented).otherwise(plain)


def with_alternatives(patterns: DataFrame) -> DataFrame:
    """Add ``_ways``: array of texts of which a match needs one, or NULL where nothing is known.

    In each, letters stand for themselves, and the two marks for any text and for a word boundary.
    Whatever is not understood is replaced by 'any text' or gives NULL, so no match is ever lost.
    """
    pattern = F.col("pattern")
    unknown = pattern.rlike(r"\\[^bBdDwWsSAzZ\W]|\(\?(?!:|=|!|<=|<!)")
    s = F.replace(F.replace(pattern, F.lit(r"\\"), F.lit(_ANY)), F.lit(r"\b"), F.lit(_EDGE))
    s = F.regexp_replace(s, r"(?s)\\.|\[\^?\]?[^\]]*\]", _ANY)
    for _ in range(_NESTING):
        s = F.regexp_replace(s, r"\((?:\?(?:=|!|<=|<!))[^()]*\)(?:" + _TIMES + r")?|\([^()]*\)" + _TIMES, _ANY)
        s = F.regexp_replace(s, r"\((?:\?:)?([^()|]*)\)", "$1")
        s = F.regexp_replace(s, r"(\((?:\?:)?[^()]*)\([^()]*\)", "$1" + _ANY)  # a group in a group
        s = F.regexp_replace(s, r"^([^()]*\([^()]*\)[^()]*)\([^()]*\)", "$1" + _ANY)  # a second group
    read = computed(patterns, {"_s": F.when(~unknown, s)})
    one = r"^([^()|]*)\((?:\?:)?([^()]*)\)([^()|]*)\z"
    before, inside, after = (F.regexp_extract("_s", one, k) for k in (1, 2, 3))
    dealt = F.transform(F.split(inside, r"\|", -1), lambda x: F.concat(before, x, after))
    each = F.split(F.regexp_replace("_s", r"\([^()]*\)", _ANY), r"\|", -1)
    found = F.transform(F.when(F.col("_s").rlike(one), dealt).otherwise(each), _unrepeated)
    read = computed(read, {"_found": found}).drop("_s")
    left_over = F.exists("_found", lambda x: x.rlike(r"[()\[\]{}*+?]"))
    return read.withColumn("_ways", F.when(~left_over, F.col("_found"))).drop("_found")


def _unrepeated(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?s)(.)\+[?+]?", "$1" + _ANY)
    x = F.regexp_replace(x, r"(?s).(?:[?*]|\{[^{}]*\})[?+]?", _ANY)
    return F.lower(F.regexp_replace(x, r"[.^$]|[^\x00-\x7f]", _ANY))


def tokens(text: Column) -> Column:
    """Distinct words of a folded text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))


def _plain_tokens(text: Column) -> Column:
    """As ``tokens`` of the folded text, without folding it: signs outside ASCII are in no word."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    return F.array_distinct(F.transform(found, F.lower))


def anchors(patterns: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pattern, token, sure), patterns without a token) over a vocabulary (token, n) of the texts.

    Every text a pattern matches holds one of its tokens; ``sure`` where the token alone, as a whole
    word, is already a match.  An alternative with whole words is found
    by the rarest of them; else by the words of the vocabulary that contain its longest piece, which
    are looked up by the piece itself, or by its first eight letters if it is longer.
    """
    inside = f"[^a-z0-9_{_ANY}]"
    read = with_alternatives(patterns.select("pattern"))
    ways = computed(
        read.select("pattern", F.posexplode_outer("_ways").alias("_way", "_text")),
        {
            "_words": F.regexp_extract_all("_text", F.lit(f"(?<={inside}){_TOKEN}(?={inside})"), F.lit(0)),
            "_pieces": F.regexp_extract_all("_text", F.lit(f"[a-z0-9_]{{{_GRAM},}}"), F.lit(0)),
        },
    )
    piece = F.array_max(F.transform("_pieces", lambda p: F.struct(F.length(p).alias("size"), p.alias("piece"))))["piece"]
    ways = ways.withColumns({"_piece": piece, "_sure": F.col("_text").rlike(f"^{_EDGE}{_TOKEN}{_EDGE}\\z")})
    whole = F.size("_words") > 0
    opened = ways.where(~F.coalesce(whole, F.lit(False)) & F.col("_piece").isNull()).select("pattern").distinct()
    known = vocabulary.select(F.col("token"), F.col("n"))
    words = ways.where(whole).select("pattern", "_way", "_sure", F.explode(F.array_distinct("_words")).alias("token"))
    rarest = (
        words.join(known, "token", "left").groupBy("pattern", "_way", "_sure")
        .agg(F.min(F.coalesce("n", F.lit(0))).alias("_n"), F.min_by("token", F.struct("n", "token")).alias("token"))
        .where("_n > 0")
    )
    parts = ways.where(~whole & F.col("_piece").isNotNull()).select(
        "pattern", "_piece", F.substring("_piece", 1, _LONGEST).alias("_gram")
    )
    sizes = parts.select(F.length("_gram").alias("_size")).distinct()  # six rows at most
    starts = F.sequence(F.lit(1), F.length("token") - F.col("_size") + 1)
    grams = known.join(F.broadcast(sizes), F.length("token") >= F.col("_size")).select(
        "token", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("token"), i, F.col("_size"))))).alias("_gram")
    )
    within = parts.join(grams, "_gram").where(F.contains("token", "_piece"))
    found = rarest.select("pattern", "token", "_sure").unionByName(within.select("pattern", "token", F.lit(False).alias("_sure")))
    found = found.groupBy("pattern", "token").agg(F.max("_sure").alias("sure")).join(opened, "pattern", "left_anti")
    narrow = F.col("pattern").rlike(_IN_ONE_WORD) & ~F.col("pattern").rlike(r"\(\?[^:]")
    alone = F.when(narrow & ~F.col("sure"), F.rlike("token", java_patterns(F.col("pattern"))))
    judged = computed(found, {"_alone": alone})
    return judged.where(F.coalesce("_alone", F.lit(True))).select("pattern", "token", F.coalesce("_alone", "sure").alias("sure")), opened


class _Meeting(NamedTuple):
    """Words of the texts, sure (pattern, token), and (_key, pattern) of what had to be read in whole texts."""

    held: DataFrame
    sure: DataFrame
    read: DataFrame | None


def _saved(df: DataFrame, label: str) -> DataFrame:
    """Kept in the shared checkpoint folder: worked out once, and of known size to the joins."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _meet(df: DataFrame, rules: DataFrame, key: str, text: str) -> _Meeting:
    texts = computed(df.select(F.col(key).alias("_key"), folded(F.col(text)).alias("_text")), {"_text": F.col("_text")}).where(
        "_text is not null"
    )
    held = df.select(F.col(key).alias("_key"), F.explode(_plain_tokens(F.col(text))).alias("token"))
    patterns = rules.select("pattern").where(F.col("pattern").isNotNull()).distinct()
    vocabulary = _saved(held.groupBy("token").agg(F.count("*").alias("n")), "vocabulary")
    found, opened = (_saved(x, label) for x, label in zip(anchors(patterns, vocabulary), ("anchors", "opened"), strict=True))
    java = java_patterns(F.col("pattern"))
    tested, unsure = [], found.where("not sure")
    if not unsure.isEmpty():
        known = computed(texts, {"_id": F.xxhash64("_text")})
        words = known.select("_key", "_id", F.explode(tokens(F.col("_text"))).alias("token"))
        met = words.join(unsure, "token").select(F.col("_key").alias("_k"), F.col("_id").alias("_i"), "pattern").distinct()
        pairs = known.join(met, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_id") == F.col("_i")))
        tested.append(pairs.where(F.rlike("_text", java)).select("_key", "pattern"))
    if not opened.isEmpty():
        tested.append(texts.join(opened, F.rlike(F.col("_text"), java)).select("_key", "pattern"))
    read = tested[0].unionByName(tested[1]) if len(tested) == 2 else tested[0] if tested else None
    return _Meeting(held, found.where("sure").select("pattern", "token"), read)


def matches(df: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern) of every text of ``df`` and every pattern of ``rules`` that matches it, once.

    Patterns that need no word (``\\d+`` or ``.*``) are a stated set that has to be read against
    every text; all others are tested only where text and pattern share a word.  Null texts and null
    patterns match nothing; rows that share a key count as one text holding what any of them holds.
    """
    held, sure, read = _meet(df, rules, key, text)
    both = held.join(sure, "token").select("_key", "pattern")
    both = both if read is None else both.unionByName(read)
    return both.distinct().withColumnRenamed("_key", key)


def scores(df: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, family, score, skills): summed weight and number of the canonical names found in each text.

    ``rules`` holds (family, pattern, canonical, weight); a name counts its highest weight.
    """
    dictionary = rules.select("family", "pattern", "canonical", F.col("weight").cast("int").alias("weight")).distinct()
    held, sure, read = _meet(df, dictionary, key, text)
    name = ["family", "canonical"]
    # what a word is worth is settled before texts come in; a pattern met twice changes no maximum
    by_word = _saved(sure.join(dictionary, "pattern").groupBy("token", *name).agg(F.max("weight").alias("weight")), "words")
    hits = held.join(by_word, "token").select("_key", *name, "weight")
    if read is not None:
        hits = hits.unionByName(read.join(dictionary, "pattern").select("_key", *name, "weight"))
    return (
        hits.groupBy("_key", *name).agg(F.max("weight").alias("weight"))
        .groupBy("_key", "family").agg(F.sum("weight").alias("score"), F.count("*").alias("skills"))
        .withColumnRenamed("_key", key)
    )
