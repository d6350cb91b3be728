"""Currency and pay columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.match import folded, hit, let
from boardwalk.functions.steps import computed, per_value
from boardwalk.rules import currency as rules


def per_usd(currency: Column) -> Column:
    """Units per dollar; an unknown or absent currency counts as dollars."""
    rates = F.create_map(*[F.lit(x) for pair in rules.PER_USD.items() for x in pair])
    code = F.upper(F.trim(F.coalesce(currency, F.lit("USD"))))
    return F.coalesce(F.element_at(rates, code), F.lit(1.0))


def to_usd(amount: Column, currency: Column) -> Column:
    amount = amount.cast("double")
    finite = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != float("inf"))
    return F.when(finite, amount / per_usd(currency)).otherwise(0.0)


def salary_usd(salary_min: Column, salary_max: Column, currency: Column) -> Column:
    """Stored comparison column: the upper figure in dollars, NULL when unpaid."""
    return F.coalesce(salary_max, salary_min) / per_usd(currency)


def plausible_annual(amount: Column, currency: Column) -> Column:
    usd = to_usd(amount, currency)
    return F.coalesce(
        (amount > 0) & usd.between(rules.MIN_ANNUAL_USD, rules.MAX_ANNUAL_USD), F.lit(False)
    )


def whole(c: Column) -> Column:
    """Round half up to a whole number, kept as double."""
    return F.floor(c + 0.5).cast("double")


def annualise(value: Column, currency: Column) -> Column:
    """A structured figure as annual pay: as given, else read as hourly, else NULL."""
    hourly = whole(value * rules.HOURS_PER_YEAR)
    return F.when(plausible_annual(value, currency), whole(value)).when(
        (value >= 8) & plausible_annual(hourly, currency), hourly
    )


# Pay figures in prose.
_NUM = r"\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?\s*[kK]|\d{2,7}(?:\.\d{1,2})?"
RANGE = (
    r"([$£€₹]|\b(?:USD|GBP|EUR|CAD|AUD|INR)\b)?\s*(" + _NUM + r")\s*(?:-|–|—|to|and)\s*"
    r"([$£€₹])?\s*(" + _NUM + r")"
)
SINGLE = (
    r"([$£€₹]|\b(?:USD|GBP|EUR|CAD|AUD|INR|SGD|CHF|SEK|DKK|NOK|PLN)\b)\s*(" + _NUM + r")"
)
PAY_CONTEXT = (
    r"\b(salary|compensation|pay|base|range|rate|earn|remuneration|package|"
    r"per (hour|year|annum)|annually|hourly|OTE)\b"
)
ANTI_CONTEXT = (
    r"\b(401\s*\(?k\)?|revenue|funding|raised|valuation|series [a-e]\b|arr\b|market cap|"
    r"budget of|equity|stock (option|grant)|rsu|total (comp|compensation)|signing bonus|"
    r"relocation|tuition|vest(ing|ed)?)\b"
)
CURRENCY_CODES = r"\b(USD|GBP|EUR|CAD|AUD|INR|SGD|CHF|SEK|DKK|NOK|PLN)\b"
CURRENCY_SYMBOLS = [("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("₹", "INR")]
PER_HOUR = r"\b(per hour|hourly|/\s*hour|/\s*hr|an hour)\b"
PER_MONTH = r"\b(per month|monthly|/\s*month|a month)\b"
ANNUAL_MIN, ANNUAL_MAX = 15_000, 1_200_000
HOURLY_MIN, HOURLY_MAX = 8, 400
CONTEXT_BEFORE, CONTEXT_AFTER = 90, 60

_OPEN, _CLOSE = "\u0001", "\u0002"


def salary_from_text(description: Column, chars: int | None = None) -> Column:
    """struct(min, max, currency) of the first defensible pay figure, else NULL.

    The whole text is read, or its first ``chars``.  Ranges come first; a range that looked like pay but was implausible also rules
    out the single-figure reading.
    """
    text = F.regexp_replace(
        description if chars is None else F.substring(description, 1, chars),
        "[\u0001\u0002\u00a0\u2000-\u200a\u202f\u205f\u3000]", " ",
    )
    return F.when(description.rlike(r"\d{2}|\d\s*[kK]"), let(text, _salary))


def with_salary(df: DataFrame, text: str) -> DataFrame:
    """Add ``parsed_pay``, ``salary_from_text`` of a column: each text is read once, however many rows hold it."""
    return per_value(df, [text], lambda texts: computed(texts, {"parsed_pay": salary_from_text(F.col(text))}))


def _salary(text: Column) -> Column:
    return let(_read_all(text, RANGE, is_range=True), lambda seen: _pick(seen, text))


def _pick(ranges: Column, text: Column) -> Column:
    good = F.filter(ranges, lambda r: r["ok"])
    single = let(
        _read_all(text, SINGLE, is_range=False),
        lambda seen: F.get(F.filter(seen, lambda r: r["ok"]), F.lit(0)),
    )
    chosen = F.when(F.size(good) > 0, F.get(good, F.lit(0))).when(
        ~F.exists(ranges, lambda r: r["rejected"]), single
    )
    return let(
        chosen,
        lambda c: F.when(
            c.isNotNull(),
            F.struct(c["lo"].alias("min"), c["hi"].alias("max"), c["currency"].alias("currency")),
        ),
    )


def _read_all(text: Column, pattern: str, is_range: bool) -> Column:
    """Every match with its surroundings judged, in text order.

    Matches are marked inside the text and the text is cut there.  What stands around a match comes
    from the ends of the pieces near it, each cut to the width of the context, so the work for one
    match is bounded however long the text is.
    """
    marked = F.regexp_replace(text, "(?i)" + pattern, f"{_OPEN}$0{_CLOSE}")
    judged = let(F.split(marked, _OPEN), lambda pieces: let(_cut(pieces), lambda c: _judge_all(c, pattern, is_range)))
    return F.when(F.instr(marked, _OPEN) > 0, judged).otherwise(F.array().cast(_JUDGED))


def _cut(pieces: Column) -> Column:
    plain = lambda p: F.replace(p, F.lit(_CLOSE), F.lit(""))
    return F.struct(
        F.transform(pieces, lambda p: F.when(F.instr(p, _CLOSE) > 0, F.substring_index(p, _CLOSE, 1))).alias("found"),
        F.transform(pieces, lambda p: F.right(plain(p), F.lit(CONTEXT_BEFORE))).alias("tails"),
        F.transform(pieces, lambda p: F.left(F.substring_index(p, _CLOSE, -1), F.lit(CONTEXT_AFTER))).alias("rest"),
        F.transform(pieces, lambda p: F.left(plain(p), F.lit(CONTEXT_AFTER))).alias("heads"),
    )


def _judge_all(c: Column, pattern: str, is_range: bool) -> Column:
    """Every piece holds a character at least, so as many pieces as characters reach far enough."""
    joined = lambda xs, start, n: F.array_join(F.slice(xs, start, n), "")

    def one(found: Column, i: Column) -> Column:  # piece i, from 0, begins with the match
        first = F.greatest(i - CONTEXT_BEFORE, F.lit(0))
        before = F.right(joined(c["tails"], first + 1, i - first), F.lit(CONTEXT_BEFORE))
        after = F.concat(F.get(c["rest"], i), joined(c["heads"], i + 2, F.lit(CONTEXT_AFTER)))
        return F.struct(found.alias("found"), before.alias("before"), F.left(after, F.lit(CONTEXT_AFTER)).alias("after"))

    spans = F.filter(F.transform(c["found"], one), lambda s: s["found"].isNotNull())
    return F.transform(spans, lambda s: _judge(s, pattern, is_range))


_JUDGED = "array<struct<ok:boolean,rejected:boolean,lo:double,hi:double,currency:string>>"


def _judge(span: Column, pattern: str, is_range: bool) -> Column:
    before = F.regexp_extract(span["before"], r"[^.;\n]*\z", 0)
    return let(
        F.struct(F.concat(before, span["found"], span["after"]).alias("raw"), span["found"].alias("found")),
        lambda w: let(
            F.struct(w["raw"].alias("raw"), folded(w["raw"]).alias("near"), w["found"].alias("found")),
            lambda x: _verdict(x, pattern, is_range),
        ),
    )


def _verdict(w: Column, pattern: str, is_range: bool) -> Column:
    near, found = w["near"], w["found"]
    lo = _figure(F.regexp_extract(found, "(?i)" + pattern, 2), near)
    hi = _figure(F.regexp_extract(found, "(?i)" + pattern, 4), near) if is_range else lo
    about_pay = hit(near, PAY_CONTEXT)
    if is_range:
        about_pay = about_pay | found.rlike("[$£€₹]")
    about_pay = about_pay & ~hit(near, ANTI_CONTEXT)
    band = F.coalesce((hi >= lo) & (hi <= lo * 5), F.lit(False))
    code = F.upper(F.regexp_extract(near, CURRENCY_CODES.lower(), 1))
    symbol = None
    for sign, iso in CURRENCY_SYMBOLS:
        has = F.instr(w["raw"], sign) > 0
        symbol = F.when(has, iso) if symbol is None else symbol.when(has, iso)
    return F.struct(
        (about_pay & band).alias("ok"),
        (about_pay & ~band).alias("rejected"),
        lo.alias("lo"),
        hi.alias("hi"),
        F.coalesce(F.when(F.length(code) > 0, code), symbol, F.lit("USD")).alias("currency"),
    )


def _figure(raw: Column, near: Column) -> Column:
    """A written figure as annual pay, NULL when implausible."""
    digits = F.trim(F.regexp_replace(raw, ",", ""))
    thousands = F.regexp_extract(digits, r"^(\d+(?:\.\d+)?)\s*[kK]\z", 1)
    value = F.when(F.length(thousands) > 0, whole(thousands.try_cast("double") * 1000)).otherwise(
        digits.try_cast("double")
    )
    monthly = value * 12
    return (
        F.when(
            hit(near, PER_HOUR),
            F.when(value.between(HOURLY_MIN, HOURLY_MAX), whole(value * rules.HOURS_PER_YEAR)),
        )
        .when(
            hit(near, PER_MONTH),
            F.when(monthly.between(ANNUAL_MIN, ANNUAL_MAX), whole(monthly)),
        )
        .otherwise(F.when(value.between(ANNUAL_MIN, ANNUAL_MAX), whole(value)))
    )


def pay_in_summary(summary: Column) -> Column:
    """struct(min, max, currency) of a short pay summary such as '$120K - $150K'."""
    figures = F.transform(
        F.regexp_extract_all(summary, F.lit(r"([\d,]+(?:\.\d+)?\s*[KkMm]?)"), F.lit(1)),
        _short_figure,
    )
    kept = F.filter(figures, lambda n: n.between(10_000, 2_000_000))
    currency = (
        F.when(F.instr(summary, "€") > 0, "EUR")
        .when(F.instr(summary, "£") > 0, "GBP")
        .when(F.instr(summary, "$") > 0, "USD")
    )
    return let(
        kept,
        lambda k: F.when(
            F.size(k) > 0,
            F.struct(
                whole(F.array_min(k)).alias("min"),
                whole(F.array_max(k)).alias("max"),
                currency.alias("currency"),
            ),
        ),
    )


def _short_figure(text: Column) -> Column:
    base = F.regexp_replace(text, r"[,\sKkMm]", "").try_cast("double")
    return (
        F.when(text.rlike(r"[Kk]\z"), base * 1000)
        .when(text.rlike(r"[Mm]\z"), base * 1_000_000)
        .otherwise(base)
    )


def by_interval(amount: Column, interval: Column, factors: dict, unpaid: tuple = ()) -> Column:
    """Annual pay from a vendor interval code; codes not listed are annual."""
    value = amount.try_cast("double")
    scaled = whole(value)
    for code, factor in factors.items():
        scaled = F.when(F.startswith(interval, F.lit(code)), whole(value * factor)).otherwise(scaled)
    for code in unpaid:
        scaled = F.when(~F.coalesce(interval == code, F.lit(False)), scaled)
    return F.when(value > 0, scaled)
