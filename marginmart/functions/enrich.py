"""Row enrichment: pure Column expressions plus ``enrich(df)``.

Everything here is a built-in Spark expression (``CASE WHEN`` chains, regex extraction,
``try_cast``), so the enrichment stays inside whole-stage code generation and is a
narrow, shuffle-free projection over the fact table.  ANSI mode is on in Spark 4, so
every parse uses ``try_cast`` / ``try_to_timestamp`` / a ``when`` guard, never a plain
cast that could raise on bad text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — labels and keyword lists that must equal the source
# application's, in their natural order.
# ---------------------------------------------------------------------------
PREMIUM_KEYWORDS = ("CLUB", "CLB", "LOGE", "SUITE", "VIP", "PREMIUM",
                    "BOX", "FLOOR", "COURT")
LOT_KEYWORDS = ("LOT", "GARAGE", "PARKING", "GOLD", "BLACK", "BLUE", "YELLOW",
                "EMERALD", "RED", "GREEN", "PURPLE", "ORANGE", "SILVER",
                "BRONZE", "WHITE", "PL")
BALCONY_KEYWORDS = ("BAL", "BALCONY", "MEZZ")

SECTION_TYPE_TIERS = ("Numeric Only", "Premium / Suite / Club", "Parking / Lot", "Balcony",
                      "Lettered (A/B/C…)", "Other Named")
SECTION_NUM_TIERS = ("Unknown", "Floor / Low (<100)", "Lower Bowl (100s)", "Mid Level (200s)",
                     "Upper Mid (300s)", "Upper Deck (400s+)")
QUANTITY_BUCKETS = ("Unknown", "Single", "Pair", "Small Group (3-4)", "Group (5-8)",
                    "Large Group (9+)")
LEAD_TIME_BUCKETS = ("Unknown", "Post-event sale", "Same day", "1-3 days", "4-7 days",
                     "1-4 weeks", "1-3 months", "3+ months")
# Right-closed fine lead-time cut: edges and the labels of the 9 bins between them.
FINE_LEAD_EDGES = (-1, 0, 1, 3, 7, 14, 30, 60, 365, 9999)
FINE_LEAD_LABELS = ("Same day", "1 day", "2-3 days", "4-7 days", "1-2 weeks", "2-4 weeks",
                    "1-2 months", "2-12 months", "1y+")
DAYS_ORDER = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# (month abbreviations are MONTH_ABBRS below)
THIS_YEAR = "This Year"
LAST_YEAR = "Last Year"
YEAR_CODES = {THIS_YEAR: "current", LAST_YEAR: "last_year"}
# ---------------------------------------------------------------------------

# Columns ``enrich`` adds, in order.
ENRICHED_EXTRA = ("Profit", "TicketsSold", "SellMonth", "SellMonthName", "SellMonthNum", "SellDayOfWeek",
                  "SellHour", "EventMonth", "EventDayOfWeek", "LeadTimeDays", "Section_Num", "Section_Type",
                  "HomeTeam", "AwayTeam", "YEAR", "ProfitMargin", "LeadTimeBucket", "SectionNumTier",
                  "SectionTypeTier", "QuantityBucket")

MONEY_TYPE = "decimal(21,4)"
US_PER_DAY = 86_400_000_000


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- coercion (raw text -> typed) -------------------------------------------

def money(c: str | Column) -> Column:
    """Numeric text to decimal, rounded half up to its 4 digits; 0 when missing, no number or too
    wide for the type (:func:`number_kind` tells these apart, so that a load can count them)."""
    text = f"trim({_sql(c)})"
    wide = f"try_cast({text} as double)"
    return F.expr(f"coalesce(try_cast({text} as {MONEY_TYPE}), try_cast(nullif({wide}, double('nan')) as {MONEY_TYPE}), cast(0 as {MONEY_TYPE}))")


def number_kind(c: str | Column) -> Column:
    """What E1 makes of a text: ``number``, ``missing``, ``no number`` or ``too wide``."""
    text = f"trim({_sql(c)})"
    wide = f"try_cast({text} as double)"
    return F.expr(f"case when coalesce({text}, '') = '' then 'missing' when {wide} is null or isnan({wide}) then 'no number' "
                  f"when coalesce(try_cast({text} as {MONEY_TYPE}), try_cast({wide} as {MONEY_TYPE})) is null then 'too wide' else 'number' end")


def int_trunc(c: str | Column) -> Column:
    """Numeric text to int, truncating (``2.7`` -> 2), 0 when missing or bad."""
    return F.coalesce(F.expr(f"try_cast(try_cast(trim({_sql(c)}) as double) as int)"), F.lit(0))


def type_id(c: str | Column) -> Column:
    """Performer type id text to int, through double so ``38`` and ``38.0`` agree."""
    return F.expr(f"try_cast(try_cast(trim({_sql(c)}) as double) as int)")


# Written-out styles that name the month or put the year first, and dates of two numbers and a year, month first.
PLAIN_FORMATS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "MMM d, yyyy h:mm a", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy")
_CLOCKS = (" H:mm:ss", " H:mm", " h:mm:ss a", " h:mm a", "")
MONTH_FIRST = tuple(f"M/d/{y}{t}" for y in ("yyyy", "yy") for t in _CLOCKS)


def _first_parsed(text: str, shape: str, formats: tuple[str, ...]) -> str:
    """The first of the formats that reads the text.

    Only formats of the text's own shape are tried, as a try that fails costs far more than to tell the shape: colons
    and slashes are read by colons and slashes alone, letters by months and day halves alone, so a text can be of no
    other format, and formats of different shapes never read the same text."""
    tries: dict[int, list[str]] = {}
    for fmt in formats:
        kind = 6 * ("/" in fmt) + 2 * fmt.count(":") + ("a" in fmt or "MMM" in fmt)
        tries.setdefault(kind, []).append(f"try_to_timestamp({text}, '{fmt}')")
    return f"cast(case {shape} " + " ".join(f"when {kind} then coalesce({', '.join(x)})" for kind, x in tries.items()) + " end as timestamp_ntz)"


def _shape(text: str) -> str:
    """Any slashes, the colons (none, one, more) and any letters of a text as one number (:func:`_first_parsed`)."""
    colons = f"case when locate(':', {text}) = 0 then 0 when locate(':', {text}, locate(':', {text}) + 1) = 0 then 1 else 2 end"
    return f"cast(contains({text}, '/') as int) * 6 + {colons} * 2 + cast({text} rlike '[A-Za-z]' as int)"


def _slashed(c: str) -> str:
    """Trimmed text; day, month and year apart by dots or hyphens get slashes."""
    return f"regexp_replace(trim({_sql(c)}), '^([0-9]{{1,2}})[.-]([0-9]{{1,2}})[.-]([0-9])', '$1/$2/$3')"


def _swapped(text: str) -> str:
    """The first two of the numbers apart by slashes change places, so that a date read day first is one read month first."""
    return f"regexp_replace({text}, '^([0-9]+)/([0-9]+)/', '$2/$1/')"


def date_parts(df: DataFrame, columns: dict[str, Column | None]) -> DataFrame:
    """What :func:`timestamp` reads of each text column with its order of day and month, made once a row: the text and its
    shape, and the text with its numbers month first (under names of their own; see :func:`without_date_parts`)."""
    df = df.withColumns({f"_text_{c}": F.expr(_slashed(c)) for c in columns})
    swapped = lambda c, first: F.col(f"_text_{c}") if first is None else F.when(first, F.expr(_swapped(f"`_text_{c}`"))).otherwise(F.col(f"_text_{c}"))
    return df.withColumns({f"_shape_{c}": F.expr(_shape(f"`_text_{c}`")) for c in columns} | {f"_numbers_{c}": swapped(c, first) for c, first in columns.items()})


def without_date_parts(df: DataFrame, columns: dict[str, Column | None]) -> DataFrame:
    return df.drop(*[f"_{part}_{c}" for part in ("text", "shape", "numbers") for c in columns])


def timestamp(c: str | Column, day_first: Column | None = None, parts: bool = False) -> Column:
    """Text to naive timestamp; bad text gives null.

    Dates of two numbers and a year are read in the order that ``day_first`` names, and are null if
    they are none in that order; without it, month first, then day first.  With ``parts`` the row has
    what :func:`date_parts` makes."""
    text = f"`_text_{c}`" if parts else _slashed(c)
    shape = f"`_shape_{c}`" if parts else _shape(text)
    plain = F.coalesce(F.expr(f"try_cast(nullif(trim({_sql(c)}), '') as timestamp_ntz)"), F.expr(_first_parsed(text, shape, PLAIN_FORMATS)))
    if parts and day_first is not None:
        return F.coalesce(plain, F.expr(_first_parsed(f"`_numbers_{c}`", shape, MONTH_FIRST)))
    month, day = (F.expr(_first_parsed(x, shape, MONTH_FIRST)) for x in (text, _swapped(text)))
    if day_first is None:
        return F.coalesce(plain, month, day)
    return F.coalesce(plain, F.when(day_first, day).otherwise(month))


def prefers_day_first(c: str) -> Column:
    """The file's vote as an aggregate: more of its dates of two numbers and a year are dates when read day first.

    Only a number above 12 decides; a tie (no such number, or as many on either side) is month first."""
    high, low = "1[3-9]|[2-9][0-9]", "[0-9]|0[0-9]|1[0-2]"
    # Slashes, or dots and hyphens (see _slashed).
    votes = lambda a, b: F.count_if(F.trim(F.col(f"`{c}`")).rlike(f"^({a})(/({b})/|[.-]({b})[.-])[0-9]{{2}}"))
    return votes(high, low) > votes(low, high)


def flag(c: str | Column) -> Column:
    """Trimmed, lower-cased text equal to ``true``; null is False."""
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))) == F.lit("true"), F.lit(False))


def _sql(c: str | Column) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name for SQL-text coercions")


# --- money / margin -------------------------------------------------------------

def profit() -> Column:
    """SaleTotal - TicketCost (exact decimal)."""
    return F.col("SaleTotal") - F.col("TicketCost")


def row_margin(profit_col: Column | None = None, sale_col: Column | None = None) -> Column:
    """Profit / SaleTotal * 100 as double; null when SaleTotal is 0."""
    p = profit_col if profit_col is not None else F.col("Profit")
    s = sale_col if sale_col is not None else F.col("SaleTotal")
    return F.when(s != 0, p.cast("double") / s.cast("double") * 100)


# --- calendar -------------------------------------------------------------------

def day_order(ts: str | Column) -> Column:
    """0 for Monday .. 6 for Sunday."""
    return F.weekday(_c(ts))


def hour_of(ts: str | Column) -> Column:
    """Hour 0-23."""
    return F.hour(_c(ts))


def lead_time_days(sell: str | Column = "SellDate_dt", event: str | Column = "EventDate_dt") -> Column:
    """Whole days from sale to event, rounded down (-10 hours gives -1)."""
    return F.floor(F.timestamp_diff("MICROSECOND", _c(sell), _c(event)) / F.lit(US_PER_DAY))


def lead_time_bucket(days: str | Column = "LeadTimeDays") -> Column:
    """E13."""
    d = _c(days)
    return (F.when(d.isNull(), "Unknown")
            .when(d < 0, "Post-event sale")
            .when(d == 0, "Same day")
            .when(d <= 3, "1-3 days")
            .when(d <= 7, "4-7 days")
            .when(d <= 30, "1-4 weeks")
            .when(d <= 90, "1-3 months")
            .otherwise("3+ months"))


def fine_lead_bucket(days: str | Column = "LeadTimeDays") -> Column:
    """Right-closed bins over FINE_LEAD_EDGES; outside (-1, 9999] gives null."""
    d = _c(days)
    expr = F.when(d.isNull() | (d <= FINE_LEAD_EDGES[0]) | (d > FINE_LEAD_EDGES[-1]), F.lit(None))
    for hi, label in zip(FINE_LEAD_EDGES[1:], FINE_LEAD_LABELS):
        expr = expr.when(d <= hi, label)
    return expr


def fine_lead_order(days: str | Column = "LeadTimeDays") -> Column:
    """Position (0-8) of the fine lead-time bin, for ordering."""
    d = _c(days)
    expr = F.when(d.isNull() | (d <= FINE_LEAD_EDGES[0]) | (d > FINE_LEAD_EDGES[-1]), F.lit(None))
    for i, hi in enumerate(FINE_LEAD_EDGES[1:]):
        expr = expr.when(d <= hi, F.lit(i))
    return expr


# --- sections -------------------------------------------------------------------

# Upper / trim / lower / split / substring match / regex findall are the built-in
# upper, trim, lower, split_part, rlike and regexp_extract_all used below.

def section_digits(section: str | Column = "Section") -> Column:
    """Every digit run of the upper-cased section, concatenated (= the text with every
    non-digit removed: one regex pass, no intermediate array)."""
    s = F.upper(F.coalesce(_c(section).cast("string"), F.lit("")))
    return F.regexp_replace(s, "[^0-9]", "")


def section_letters(section: str | Column = "Section") -> Column:
    """Every ``[A-Z]+`` run of the upper-cased section, concatenated."""
    s = F.upper(F.coalesce(_c(section).cast("string"), F.lit("")))
    return F.regexp_replace(s, "[^A-Z]", "")


def section_number_from(digits: Column, seats: str | Column = "Seats") -> Column:
    """E16 + E17 on precomputed digits: the digits, else the trimmed text before the first
    ``-`` of Seats, as a number (null when not numeric)."""
    seats_lead = F.trim(F.split_part(F.coalesce(_c(seats).cast("string"), F.lit("")), F.lit("-"), F.lit(1)))
    text = F.when(digits == "", seats_lead).otherwise(digits)
    return text.try_cast("double")


def section_number(section: str | Column = "Section", seats: str | Column = "Seats") -> Column:
    """E16 + E17: section digits, else the trimmed text before the first ``-`` of Seats,
    as a number (null when not numeric)."""
    return section_number_from(section_digits(section), seats)


def section_num_tier(num: str | Column = "Section_Num") -> Column:
    """E18."""
    n = _c(num)
    return (F.when(n.isNull() | F.isnan(n), "Unknown")
            .when(n < 100, "Floor / Low (<100)")
            .when(n < 200, "Lower Bowl (100s)")
            .when(n < 300, "Mid Level (200s)")
            .when(n < 400, "Upper Mid (300s)")
            .otherwise("Upper Deck (400s+)"))


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(words)


def section_type_tier(letters: str | Column = "Section_Type") -> Column:
    """Substring match in order premium, lot, balcony; then length."""
    s = F.upper(F.coalesce(_c(letters), F.lit("")))
    return (F.when(s == "", "Numeric Only")
            .when(s.rlike(_any_of(PREMIUM_KEYWORDS)), "Premium / Suite / Club")
            .when(s.rlike(_any_of(LOT_KEYWORDS)), "Parking / Lot")
            .when(s.rlike(_any_of(BALCONY_KEYWORDS)), "Balcony")
            .when(F.length(s) <= 2, "Lettered (A/B/C…)")
            .otherwise("Other Named"))


def quantity_bucket(qty: str | Column = "TicketsSold") -> Column:
    """0 and negatives fall in the small-group bucket, as in the source."""
    q = _c(qty)
    return (F.when(q.isNull(), "Unknown")
            .when(q == 1, "Single")
            .when(q == 2, "Pair")
            .when(q <= 4, "Small Group (3-4)")
            .when(q <= 8, "Group (5-8)")
            .otherwise("Large Group (9+)"))


def year_code(label: str | Column = "YearLabel") -> Column:
    """``current`` / ``last_year``."""
    lab = _c(label)
    return F.when(lab == THIS_YEAR, "current").when(lab == LAST_YEAR, "last_year")


# --- the whole enrichment ---------------------------------------------------------

MONTH_ABBRS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _month_key(year: Column, month: Column) -> Column:
    """``yyyy-MM`` from integer parts (same text as ``date_format(ts, 'yyyy-MM')``)."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def enrich(df: DataFrame) -> DataFrame:
    """Add every derived column to typed order rows.

    Input: ``SaleTotal``/``TicketCost`` (decimal), ``Quantity`` (int), ``SellDate_dt`` /
    ``EventDate_dt`` (timestamp_ntz), ``Section``, ``Seats``, the performer, marketplace
    and flag columns, and ``Sport``/``State``/``MarketplaceTier`` (from
    :func:`marginmart.sources.csv.lookup_dims` or the source).  Narrow projections only:
    no shuffle, no UDF.  Calendar parts are extracted once as integers and names are looked
    up in fixed arrays (cheaper per row than a date formatter); the section digits are
    computed once and reused by the seat fallback.
    """
    sell, event = F.col("SellDate_dt"), F.col("EventDate_dt")
    months = F.array(*[F.lit(m) for m in MONTH_ABBRS])
    days = F.array(*[F.lit(d) for d in DAYS_ORDER])
    parts = df.withColumns({
        "_sy": F.year(sell), "_sm": F.month(sell), "_swd": F.weekday(sell),
        "_ey": F.year(event), "_em": F.month(event), "_ewd": F.weekday(event),
        "_digits": section_digits("Section"),
    })
    out = parts.withColumns({
        "Profit": profit(),
        "TicketsSold": F.col("Quantity"),
        "SellMonth": _month_key(F.col("_sy"), F.col("_sm")),
        "SellMonthName": F.when(sell.isNotNull(), F.element_at(months, F.col("_sm"))),
        "SellMonthNum": F.col("_sm"),
        "SellDayOfWeek": F.when(sell.isNotNull(), F.element_at(days, F.col("_swd") + 1)),
        "SellHour": hour_of(sell),
        "EventMonth": _month_key(F.col("_ey"), F.col("_em")),
        "EventDayOfWeek": F.when(event.isNotNull(), F.element_at(days, F.col("_ewd") + 1)),
        "LeadTimeDays": lead_time_days(sell, event),
        "Section_Num": section_number_from(F.col("_digits"), "Seats"),
        "Section_Type": section_letters("Section"),
        "HomeTeam": F.col("PrimaryPerformerName"),
        "AwayTeam": F.col("SecondaryPerformerName"),
        "YEAR": year_code("YearLabel"),
    }).drop("_sy", "_sm", "_swd", "_ey", "_em", "_ewd", "_digits")
    return out.withColumns({
        "ProfitMargin": row_margin(F.col("Profit"), F.col("SaleTotal")),
        "LeadTimeBucket": lead_time_bucket("LeadTimeDays"),
        "SectionNumTier": section_num_tier("Section_Num"),
        "SectionTypeTier": section_type_tier("Section_Type"),
        "QuantityBucket": quantity_bucket("TicketsSold"),
    })
