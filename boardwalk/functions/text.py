"""Markup, entities and title/location keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwalk.functions.match import (
    java_pattern,
    let,
    matches,
    non_empty,
    trim_all,
)
from boardwalk.rules import labels, urls


def decode_entities_once(c: Column) -> Column:
    """One pass over ``&name;`` and ``&#n;`` entities, left to right."""
    return let(c, _decode_pass)


def _decode_pass(c: Column) -> Column:
    """The text is cut at each entity, so a replacement can never combine with its
    neighbours into a new entity within the same pass.
    """
    entity = r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);"
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)({entity}|(?!{entity}).[^&]*)"), F.lit(1))

    known = F.create_map(*[F.lit(x) for k, v in labels.ENTITIES.items() for x in (f"&{k};", v)])

    def one(piece: Column) -> Column:
        hexadecimal = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+);\z", 1)
        decimal = F.regexp_extract(piece, r"^&#([0-9]+);\z", 1)
        digits = F.when(F.length(hexadecimal) > 0, F.upper(hexadecimal)).when(
            F.length(decimal).between(1, 9), F.hex(decimal.cast("bigint"))
        )
        digits = F.regexp_replace(digits, r"^0+(?=.)", "")
        valid = (F.length(digits) <= 6) & (F.conv(digits, 16, 10).cast("bigint") <= 0x10FFFF)
        surrogate = F.conv(digits, 16, 10).cast("bigint").between(0xD800, 0xDFFF)
        char = F.when(
            valid & ~surrogate, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        )
        return F.coalesce(F.element_at(known, piece), char, piece)

    decoded = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(F.startswith(p, F.lit("&")) & F.endswith(p, F.lit(";")), one(p)).otherwise(p),
        ),
        "",
    )
    return F.when(F.instr(c, "&") > 0, decoded).otherwise(c)


def decode_entities(c: Column, passes: int = 3) -> Column:
    """Entities decoded until nothing changes, at most ``passes`` times."""
    out = c
    for _ in range(passes):
        out = decode_entities_once(out)
    return out


def strip_html(c: Column) -> Column:
    """Markup to text: block ends become line breaks, empty becomes NULL."""
    escaped = java_pattern(labels.ESCAPED_TAG)
    markup = c
    for _ in range(3):
        markup = let(
            markup, lambda m: F.when(m.rlike(escaped), decode_entities_once(m)).otherwise(m)
        )
    text = F.regexp_replace(markup, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6])>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = decode_entities(text)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return let(trim_all(text), non_empty)


def location_key(c: Column) -> Column:
    """The same office spelled two ways gets one key; unknown is ''."""
    key = F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    return F.coalesce(F.trim(key), F.lit(""))


def title_key(c: Column) -> Column:
    t = F.regexp_replace(
        F.lower(c), r"\((remote|hybrid|on[- ]?site|m/f/d|f/m/d|w/m/d)\)", " "
    )
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def audit_title(c: Column, chars: int | None = None) -> Column:
    """Title as counted by the exclusion tally, or with ``chars`` its first so many characters."""
    t = F.regexp_replace(F.lower(c), r"[(\[{][^)\]}]*[)\]}]", " ")
    t = F.regexp_replace(t, "\\s+[-\u2013\u2014]\\s+[^-\u2013\u2014]{1,40}\\z", "")
    t = F.regexp_replace(t, r"[^a-z0-9+#/&. ]+", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return t if chars is None else F.substring(t, 1, chars)


def titleise(token: Column) -> Column:
    """'acme-corp_uk' -> 'Acme Corp uk': short words stay as they are."""
    words = F.filter(
        F.split(F.regexp_replace(token, r"[-_.]+", " "), r"\s+"), lambda w: F.length(w) > 0
    )
    return F.array_join(
        F.transform(words, lambda w: F.when(F.length(w) <= 3, w).otherwise(_capital(w))), " "
    )


def prettify_token(token: Column) -> Column:
    """As ``titleise``, splitting camelCase and raising short words."""
    spaced = F.regexp_replace(token, r"[._-]+", " ")
    spaced = F.trim(F.regexp_replace(spaced, r"([a-z])([A-Z])", "$1 $2"))
    words = F.split(spaced, r"\s+")
    return F.array_join(
        F.transform(words, lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(_capital(w))), " "
    )


def label_for_domain(domain: Column, token: Column) -> Column:
    """Company label when only a domain is known: the longer of stem and token."""
    stem = F.regexp_replace(
        F.regexp_replace(domain, r"^www\.", ""), r"\.(edu|com|org|net|gov)\z", ""
    )
    source = F.when(F.length(stem) >= F.length(token), stem).otherwise(token)
    words = F.split(F.regexp_replace(source, r"[._-]+", " "), r"\s+")
    return F.array_join(
        F.transform(words, lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(_capital(w))), " "
    )


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 2**31 - 1))


def content_hash(title, description, location, salary_min, salary_max, employment) -> Column:
    """Six fields run together without a separator; NULL counts as ''."""
    parts = [title, description, location, plain_number(salary_min), plain_number(salary_max), employment]
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def identity_hash(board: Column, title: Column, location: Column) -> Column:
    return F.sha2(F.concat(board, title_key(title), location_key(location)), 256)


def plain_number(c: Column) -> Column:
    """A number without a trailing '.0', as it prints in a posting."""
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def failure_reason(error: Column, chars: int | None = None) -> Column:
    """The message without its 'provider/token:' prefix, or with ``chars`` its first so many characters."""
    text = trim_all(F.coalesce(error, F.lit("")))
    text = F.regexp_replace(text, r"^[a-z]+/[A-Za-z0-9_.:@+-]+:\s*", "")
    return F.coalesce(non_empty(text if chars is None else F.substring(text, 1, chars)), F.lit("failed"))


def failure_kind(status: Column) -> Column:
    return F.when(status.isin(404, 410), "gone").otherwise("refused")


def company_from_raw(raw_json: Column) -> Column:
    """Company name in a raw payload: company_name, company, or company.name."""
    name = F.get_json_object(raw_json, "$.company_name")
    nested = F.get_json_object(raw_json, "$.company")
    inner = F.get_json_object(raw_json, "$.company.name")
    plain = F.when(~F.startswith(trim_all(nested), F.lit("{")), nested)
    return F.coalesce(*[non_empty(trim_all(x)) for x in (name, plain, inner)])


def is_placeholder_name(current: Column, token: Column) -> Column:
    """The stored name is only the token, plain or title-cased."""
    shown = F.lower(trim_all(current))
    return (
        current.isNull()
        | (current == "")
        | (shown == F.lower(titleise(token)))
        | (shown == F.lower(token))
    )


def repaired_name(current: Column, found: Column, token: Column) -> Column:
    """``found`` where it may replace a placeholder, else the current name."""
    better = (
        (F.length(trim_all(found)) > 0)
        & ~found.eqNullSafe(current)
        & (F.lower(found) != F.lower(token))
        & is_placeholder_name(current, token)
    )
    return F.when(F.coalesce(better, F.lit(False)), found).otherwise(current)


def looks_like_id(token: Column) -> Column:
    return (F.length(token) > urls.MAX_TOKEN_CHARS) | matches(token, urls.BARE_UUID)
