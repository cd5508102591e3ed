"""Times as sources wrote them, brought to one instant in UTC.

``parsed_time`` reads one text into local microseconds and, if the text says
so, the offset; everything stays in JVM expressions.  A zone, offset or GMT/UTC
in the text decides.  Without one the time is local to its feed: the feed's
zone is the one that a table of candidates declares or, among several or
none, the candidate whose offset history gives the fewest violations when the
feed's rows are aligned with their ingestion times (``zone_scores``).

A local time that occurs twice is the first of the two; one that the clock
skips has no instant.  Also without instant: null, empty and meaningless texts,
days and times not in the calendar, times before 1970, local times without a
feed or with a feed of unknown zone, and slash dates of unknown order.  Digits
beyond microseconds are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwright.session import checkpointed, small

# Minutes east of UTC of zone names.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAME = r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
ZONE = r"\s*(?:(?:UTC|GMT)?\s*([+-])(\d{2}):?(\d{2})|([A-Z]{1,5}))?"

ISO = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]\s*{CLOCK}{ZONE})?$"
YEAR_SLASH = rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[Tt ]\s*{CLOCK}{ZONE})?$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?()" + ZONE + ")?$"
SLASH = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{CLOCK}{ZONE})?$"
DOTS = rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{CLOCK}{ZONE})?$"
DAY_FIRST = rf"^(?:[A-Za-z]{{3,9}},\s*)?(\d{{1,2}})\s+({MONTH_NAME})\.?\s+(\d{{4}})(?:,?\s+{CLOCK}{ZONE})?$"
MONTH_FIRST = rf"^(?:[A-Za-z]{{3,9}},\s*)?({MONTH_NAME})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{CLOCK}{ZONE})?$"
NUMBER = r"^(\d{10})(?:\.(\d+))?$|^(\d{13})$|^(\d{16})$"
WRAPPED = r"^/Date\((?:(\d{10})(?:\.(\d+))?|(\d{13})|(\d{16}))(?:[+-]\d{4})?\)/$"
BLANKS = " \t\r\n   　"


def _month_number(name: Column) -> Column:
    head = F.lower(F.substring(name, 1, 3))
    return F.coalesce(*[F.when(head == m, F.lit(k + 1)) for k, m in enumerate(MONTHS)])


def _micros_fraction(digits: Column) -> Column:
    return F.rpad(F.substring(F.coalesce(digits, F.lit("")), 1, 6), 6, "0").cast("int")


def _epoch(text: Column, pattern: str) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    seconds, fraction, millis, micros = part(1), part(2), part(3), part(4)
    return F.coalesce(seconds.cast("bigint") * 1_000_000 + _micros_fraction(fraction), millis.cast("bigint") * 1000, micros.cast("bigint"))


# Each form with the order of its groups as year, month, day, hour, minute, second, fraction,
# half of the day, sign, zone hours, zone minutes, zone name; "?" takes the feed's date order.
CLOCK_GROUPS = ("$4", "$5", "$6", "$7", "$8", "$9", "$10", "$11", "$12")
FORMS = (
    (ISO, ("$1", "$2", "$3")), (YEAR_SLASH, ("$1", "$2", "$3")), (COMPACT, ("$1", "$2", "$3")),
    (DOTS, ("$3", "$2", "$1")), (DAY_FIRST, ("$3", "$2", "$1")), (MONTH_FIRST, ("$3", "$1", "$2")),
)
FIELDS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "sign", "zone_hours", "zone_minutes", "zone_name")


def _once(value: Column, read) -> Column:
    """``read(value)`` with the value computed once however often it is used."""
    return F.transform(F.array(value), read)[0]


def parsed_time(text: Column, date_order: Column) -> Column:
    """STRUCT(local BIGINT, zoned BOOLEAN, shift INT, day_only BOOLEAN) or null.

    local: microseconds of the written clock; shift: minutes east of UTC if ``zoned``."""
    names = F.create_map(*[x for k, v in ZONE_MINUTES.items() for x in (F.lit(k), F.lit(v))])

    def fields(t: Column) -> Column:
        out = lambda pattern, date: F.split(F.regexp_replace(t, pattern, "|".join(date + CLOCK_GROUPS)), r"\|")
        by_order = F.when(date_order == "DMY", out(SLASH, ("$3", "$2", "$1"))).when(date_order == "MDY", out(SLASH, ("$3", "$1", "$2")))
        cases = F.when(t.rlike(FORMS[0][0]), out(*FORMS[0]))
        for pattern, date in FORMS[1:]:
            cases = cases.when(t.rlike(pattern), out(pattern, date))
        return cases.when(t.rlike(SLASH), by_order)

    def written(parts: Column) -> Column:
        m = {name: F.nullif(parts[k], F.lit("")) for k, name in enumerate(FIELDS)}
        half = F.upper(m["half"])
        month = F.when(m["month"].rlike("^[0-9]+$"), m["month"].cast("int")).otherwise(_month_number(m["month"]))
        hour = m["hour"].cast("int")
        hour = F.when(half.isNull(), hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "P", 12).otherwise(0))
        minute, second = F.coalesce(m["minute"].cast("int"), F.lit(0)), F.coalesce(m["second"].cast("int"), F.lit(0))
        days = F.unix_date(F.try_to_date(F.concat_ws("-", m["year"], F.lpad(month.cast("string"), 2, "0"), F.lpad(m["day"], 2, "0")), "yyyy-MM-dd"))
        in_day = m["hour"].isNull() | (hour.between(0, 23) & (minute < 60) & (second < 60))
        local = (days.cast("bigint") * 86400 + (F.coalesce(hour, F.lit(0)) * 60 + minute) * 60 + second) * 1_000_000 + _micros_fraction(m["fraction"])
        hours, minutes = m["zone_hours"].cast("int"), m["zone_minutes"].cast("int")
        offset = F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(m["sign"] == "-", -1).otherwise(1))
        zoned = hours.isNotNull() | m["zone_name"].isNotNull()
        shift = F.coalesce(offset, F.try_element_at(names, m["zone_name"]))
        told = in_day & month.isNotNull() & days.isNotNull() & (~zoned | shift.isNotNull())
        return F.when(told, F.struct(local.alias("local"), zoned.alias("zoned"), shift.alias("shift"), m["hour"].isNull().alias("day_only")))

    def read(t: Column) -> Column:
        epoch = F.coalesce(_epoch(t, NUMBER), _epoch(t, WRAPPED))
        whole = F.struct(epoch.alias("local"), F.lit(True).alias("zoned"), F.lit(0).alias("shift"), F.lit(False).alias("day_only"))
        return F.when(t.rlike(NUMBER) | t.rlike(WRAPPED), whole).otherwise(_once(fields(t), written))

    return _once(F.trim(F.translate(text, BLANKS, " " * len(BLANKS))), read)


def instant(parsed: Column, zone: Column) -> Column:
    """Microseconds since 1970 in UTC, or null if the time can't be told."""

    def read(x: Column) -> Column:
        p, z = x["p"], x["z"]
        local = F.timestamp_micros(p["local"])
        naive = _once(F.struct(F.to_utc_timestamp(local, z).alias("at"), local.alias("local"), z.alias("z")), lambda y: F.when(F.from_utc_timestamp(y["at"], y["z"]) == y["local"], F.unix_micros(y["at"])))
        return (
            F.when(p["zoned"], p["local"] - F.coalesce(p["shift"], F.lit(0)).cast("bigint") * 60_000_000)
            .when(p["day_only"], p["local"])
            .when(z.isNotNull(), naive)
        )

    return _once(_once(F.struct(parsed.alias("p"), zone.alias("z")), read), lambda micros: F.when(micros >= 0, micros))


def zones_of(feeds: DataFrame) -> list[str]:
    """The zones a table of feeds names: at most as many as the time-zone database has."""
    return [r.tz for r in feeds.where("tz IS NOT NULL").select("tz").distinct().orderBy("tz").collect()]


def _with_each(feeds: DataFrame, zones: list[str]) -> DataFrame:
    return feeds.select("feed", F.explode(F.array(*[F.lit(z) for z in zones]).cast("array<string>")).alias("zone"))


def candidate_zones(feeds: DataFrame) -> DataFrame:
    """(feed, zone): the declared zone of a feed; a feed without one has every zone of the table."""
    declared = feeds.where("feed IS NOT NULL").select("feed", F.col("tz").alias("zone")).distinct()
    open_ = declared.groupBy("feed").agg(F.max("zone").alias("any")).where("any IS NULL").select("feed")
    return declared.where("zone IS NOT NULL").unionAll(_with_each(open_, zones_of(feeds)))


def zone_scores(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(feed, zone, violations, delay, evidence) of each candidate zone.

    rows: (feed, parsed, captured_at).  A violation is a local time that in this zone lies after
    the row was captured or that the zone's clock skips, or a written offset that is not the
    zone's at that instant.  ``delay`` sums the seconds from time to capture, for ties: with
    the fewest violations the zone that puts times closest to their capture is chosen."""

    def judged(x: Column) -> Column:
        p, zone, captured = x["parsed"], x["zone"], x["captured"]
        naive = F.struct(p["local"].alias("local"), F.lit(False).alias("zoned"), F.lit(None).cast("int").alias("shift"), F.lit(False).alias("day_only"))
        own = p["local"] - p["shift"].cast("bigint") * 60_000_000

        def verdict(y: Column) -> Column:
            at = y["at"]
            wrong = F.when(p["zoned"], F.when(p["shift"] != 0, at.isNull() | (at != own))).otherwise(at.isNull() | (at > captured))
            late = F.when(~p["zoned"] & (at <= captured), (captured - at) / 1e6)
            return F.when(~p["day_only"], F.struct(wrong.alias("wrong"), late.alias("late")))

        return _once(F.struct(instant(naive, zone).alias("at")), verdict)

    tried = rows.select("feed", "parsed", F.unix_micros("captured_at").alias("captured")).join(small(candidates), "feed")
    seen = tried.select("feed", "zone", _once(F.struct("parsed", "zone", "captured"), judged).alias("v"))
    return seen.groupBy("feed", "zone").agg(
        F.count_if("v.wrong").alias("violations"), F.coalesce(F.sum("v.late"), F.lit(0.0)).alias("delay"), F.count("v.wrong").alias("evidence")
    )


def chosen_zones(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(feed, zone): of each feed's candidates the one with the fewest violations.  A feed with
    one candidate needs no alignment, so its rows are not read for it."""
    contested = candidates.groupBy("feed").agg(F.count("*").alias("n"), F.min("zone").alias("zone"))
    several = candidates.join(contested.where("n > 1").select("feed"), "feed", "left_semi")
    scored = several.join(zone_scores(rows, several), ["feed", "zone"], "left")
    rank = F.struct(F.coalesce("violations", F.lit(0)).alias("v"), F.coalesce("delay", F.lit(0.0)).alias("d"), "zone")
    return scored.groupBy("feed").agg(F.min_by("zone", rank).alias("zone")).unionAll(contested.where("n = 1").select("feed", "zone"))


def all_zones(feeds: DataFrame) -> DataFrame:
    """Every feed with every zone of the table."""
    return _with_each(feeds.where("feed IS NOT NULL").select("feed").distinct(), zones_of(feeds))


def parsed_rows(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """(id, feed, captured_at, parsed) of rows (id, written, feed, captured_at)."""
    order = feeds.where("feed IS NOT NULL").groupBy("feed").agg(F.max("date_order").alias("date_order"))
    placed = rows.where("written IS NOT NULL").join(small(order), "feed", "left")
    return placed.select("id", "feed", "captured_at", parsed_time(F.col("written"), F.col("date_order")).alias("parsed"))


def normalised(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """(id, utc_micros) of each record whose time can be told.

    rows: (id, written, feed, captured_at); feeds: (feed, tz, date_order).  Deliveries of a
    record that differ give the earliest instant."""
    parsed = parsed_rows(rows, feeds)
    zones = checkpointed(chosen_zones(parsed, candidate_zones(feeds)))  # counted, then joined
    at = parsed.join(small(zones), "feed", "left").select("id", instant(F.col("parsed"), F.col("zone")).alias("utc_micros"))
    return at.groupBy("id").agg(F.min("utc_micros").alias("utc_micros")).where("id IS NOT NULL AND utc_micros IS NOT NULL")
