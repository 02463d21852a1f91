"""Time scales as Columns over milliseconds of GPS time (counted as unix milliseconds without leap seconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, WEEK_MS = 86_400_000, 604_800_000
#: Starts of the systems' times in unix milliseconds, of that system's own calendar; fixed values.
GPS_EPOCH, GALILEO_EPOCH, BEIDOU_EPOCH, GLONASS_EPOCH = 315_964_800_000, 935_280_000_000, 1_136_073_600_000, 820_454_400_000
TAI_GPS_MS, TT_TAI_MS, BEIDOU_GPS_MS = 19_000, 32_184, 14_000
#: UTC dates from which TAI - UTC has the value, in unix seconds; fixed values.
LEAPS = (
    (63072000, 10), (78796800, 11), (94694400, 12), (126230400, 13), (157766400, 14), (189302400, 15), (220924800, 16), (252460800, 17), (283996800, 18), (315532800, 19), (362793600, 20),
    (394329600, 21), (425865600, 22), (489024000, 23), (567993600, 24), (631152000, 25), (662688000, 26), (709948800, 27), (741484800, 28), (773020800, 29), (820454400, 30), (867715200, 31),
    (915148800, 32), (1136073600, 33), (1230768000, 34), (1341100800, 35), (1435708800, 36), (1483228800, 37),
)
#: Validity of broadcast ephemerides in milliseconds by system; fixed values.
VALIDITY_MS = {"G": 7_200_000, "E": 14_400_000, "R": 1_800_000, "C": 3_600_000, "J": 7_200_000, "S": 600_000}


def _step(ms: Column, shift) -> Column:
    """TAI - UTC at an instant of a scale in which leap k begins at its UTC second plus shift(k)."""
    out = F.lit(LEAPS[0][1])
    for at, leap in LEAPS[1:]:
        out = F.when(ms >= (at + shift(leap)) * 1000, F.lit(leap)).otherwise(out)
    return out


def tai_utc(gps_ms: Column) -> Column:
    """TAI - UTC in seconds at a GPS instant."""
    return _step(gps_ms, lambda leap: leap - 19)


def gps_utc(gps_ms: Column) -> Column:
    return tai_utc(gps_ms) - 19


def utc_ms(gps_ms: Column) -> Column:
    return gps_ms - gps_utc(gps_ms) * 1000


def gps_ms_of_utc(utc: Column) -> Column:
    return utc + (_step(utc, lambda leap: 0) - 19) * 1000


def gps_week(ms: Column) -> Column:
    return F.floor((ms - GPS_EPOCH) / WEEK_MS)


def time_of_week(ms: Column) -> Column:
    """Milliseconds."""
    return F.pmod(ms - GPS_EPOCH, F.lit(WEEK_MS))


def from_week(week: Column, tow_ms: Column) -> Column:
    return GPS_EPOCH + week.cast("long") * WEEK_MS + tow_ms


def day_of_year(ms: Column) -> Column:
    return F.dayofyear(F.timestamp_millis(ms))


def glonass_n4(ms: Column) -> Column:
    """Number of the four-year interval of Moscow time, 1 from 1996 on."""
    return F.floor((F.year(F.timestamp_millis(_moscow(ms))) - 1996) / 4) + 1


def glonass_na(ms: Column) -> Column:
    """Day within the four-year interval, 1 for its first day."""
    moscow = _moscow(ms)
    year = F.year(F.timestamp_millis(moscow))
    start = F.unix_millis(F.make_timestamp(F.floor((year - 1996) / 4).cast("int") * 4 + 1996, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return F.floor((moscow - start) / DAY_MS) + 1


def _moscow(ms: Column) -> Column:
    return utc_ms(ms) + 10_800_000


def from_glonass(n4: Column, na: Column, tod_ms: Column) -> Column:
    """GPS instant of a day number and a Moscow time of day."""
    start = F.unix_millis(F.make_timestamp((n4.cast("int") - 1) * 4 + 1996, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return gps_ms_of_utc(start + (na - 1) * DAY_MS + tod_ms - 10_800_000)


def tt_days(ms: Column, from_jd_ms: int) -> Column:
    return (ms + TAI_GPS_MS + TT_TAI_MS - from_jd_ms) / DAY_MS


def modified_julian_date(ms: Column) -> Column:
    """In Terrestrial Time."""
    return 40587 + tt_days(ms, 0)


def julian_date(ms: Column) -> Column:
    return 2440587.5 + tt_days(ms, 0)


def mjd2000(ms: Column) -> Column:
    return tt_days(ms, 946_684_800_000)


def from_julian(jd: Column) -> Column:
    """GPS milliseconds of a Julian date in Terrestrial Time."""
    return F.round((jd - 2440587.5) * DAY_MS).cast("long") - TAI_GPS_MS - TT_TAI_MS


def time_of_day(ms: Column) -> Column:
    return F.pmod(ms, F.lit(DAY_MS))


def hour_code(ms: Column) -> Column:
    """Letter a to x of the hour."""
    return F.char(97 + F.floor(time_of_day(ms) / 3_600_000))


def date_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def rinex_epoch(ms: Column) -> Column:
    """> yyyy mm dd hh mm ss.sssssss"""
    return F.concat(F.lit("> "), F.date_format(F.timestamp_millis(ms), "yyyy MM dd HH mm ss.SSS"), F.lit("0000"))


def from_rinex_epoch(text: Column) -> Column:
    parts = r"^>?\s*(\d{4})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2}(?:\.\d*)?)"
    part = lambda i: F.regexp_extract(text, parts, i)
    stamp = F.make_timestamp(*[part(i).try_cast("int") for i in range(1, 6)], part(6).try_cast("decimal(16,6)"))
    return F.when(text.rlike(parts), F.unix_millis(stamp))


def parse_date_time(text: Column) -> Column:
    """UTC milliseconds of a free-form date and time: separators . , ; and blank in the date, and the same in the time; else NULL."""
    halves = F.split(F.regexp_replace(F.trim(text), r"\s+", " "), " ", 2)
    date = F.regexp_replace(F.element_at(halves, 1), "[.,;/]", "-")
    time = F.regexp_replace(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("00:00:00")), "[,; -]", ":")
    return F.unix_millis(F.try_to_timestamp(F.concat(date, F.lit(" "), time)))


def from_iso_week(year: Column, week: Column, weekday: Column) -> Column:
    """Milliseconds of a day of an ISO week; weekday 1 is Monday."""
    fourth = F.unix_millis(F.make_timestamp(year.cast("int"), F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0)))
    monday = fourth - F.pmod(F.floor(fourth / DAY_MS) + 3, F.lit(7)) * DAY_MS
    return monday + (7 * (week.cast("long") - 1) + weekday - 1) * DAY_MS


def difference(start_ms: Column, end_ms: Column) -> Column:
    """Signed days, hours, minutes and seconds from start to end, each cut towards zero."""
    d = end_ms - start_ms
    sign, s = F.signum(d.cast("double")).cast("long"), F.floor(F.abs(d) / 1000)
    parts = {"days": F.floor(s / 86400), "hours": F.floor(s / 3600) % 24, "minutes": F.floor(s / 60) % 60, "seconds": s % 60}
    return F.struct(*[(sign * v).alias(k) for k, v in parts.items()])


def difference_ms(days: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    return (((days.cast("long") * 24 + hours) * 60 + minutes) * 60 + seconds) * 1000


def msm_instant(sys: Column, epoch_ms: Column, near_ms: Column) -> Column:
    """GPS instant of an MSM epoch in the week (GLONASS: Moscow day) about a reference instant."""
    tow = F.when(sys == "C", epoch_ms + BEIDOU_GPS_MS).otherwise(epoch_ms)
    week = gps_week(near_ms) * WEEK_MS + GPS_EPOCH + tow
    week = week + F.round((near_ms - week) / WEEK_MS).cast("long") * WEEK_MS
    day = F.floor(near_ms / DAY_MS) * DAY_MS + epoch_ms % (1 << 27) - 10_800_000 + gps_utc(near_ms) * 1000
    day = day + F.round((near_ms - day) / DAY_MS).cast("long") * DAY_MS
    return F.when(sys == "R", day).otherwise(week)


def ephemeris_instant(sys: Column, week: Column, toe: Column, tb: Column, toc: Column, received_ms: Column, now_ms: Column) -> Column:
    """Instant of a live ephemeris, NULL without the fields its system needs. now_ms resolves 10-bit weeks."""
    midnight = F.floor(received_ms / DAY_MS) * DAY_MS
    now_week = gps_week(now_ms)
    full = week + F.floor(now_week / 1024) * 1024
    full = F.when(full > now_week + 512, full - 1024).otherwise(full)
    start = F.when(sys == "C", F.lit(BEIDOU_EPOCH)).otherwise(F.lit(GPS_EPOCH))
    by_week = start + F.when(sys.isin("G", "J"), full).otherwise(week).cast("long") * WEEK_MS + toe.cast("long") * 1000
    return F.when((sys == "R") & tb.isNotNull(), midnight + (tb.cast("long") * 60 - 10_800) * 1000).when((sys == "S") & toc.isNotNull(), midnight + toc.cast("long") * 1000).otherwise(by_week).cast("long")


def expired(sys: Column, received_ms: Column, now_ms: Column) -> Column:
    limit = F.lit(7_200_000)
    for k, v in VALIDITY_MS.items():
        limit = F.when(sys == k, F.lit(v)).otherwise(limit)
    return now_ms - received_ms > limit


def duration_text(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds."""
    s = F.floor(seconds + 0.5)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(s >= 3600, F.format_string("%dh %dm", h, m)).when(s >= 60, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def age_text(ms: Column) -> Column:
    s = ms / 1000
    whole = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    tenth = (F.floor(s / 3600 * 10 + 0.5) / 10).cast("decimal(20,1)").cast("string")
    return F.when(s < 60, F.concat(whole(s), F.lit("s ago"))).when(s < 3600, F.concat(whole(s / 60), F.lit("m ago"))).otherwise(F.concat(tenth, F.lit("h ago")))


def size_text(n: Column) -> Column:
    tenth = lambda x: (F.floor(x * 10 + 0.5) / 10).cast("decimal(20,1)").cast("string")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(tenth(n / 1024), F.lit(" KB"))).otherwise(F.concat(tenth(n / (1 << 20)), F.lit(" MB")))


def navigation_times(ephs, step_ms: int = 900_000):
    """t_ms from the least to at most the largest time of ephemerides; none without any."""
    ends = ephs.agg(F.min("toc_ms").alias("a"), F.max("toc_ms").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.lit(step_ms).cast("long"))).alias("t_ms"))
