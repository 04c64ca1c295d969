"""Article dates (F1-F6, E5). Results are wall-clock timestamps without a zone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import as_col, is_present, let

# fixed values: month names as printed on pages
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
# fixed values: characters besides white space that part the words of a printed date
SEPARATORS = "\u00a0\u2022\u2027\u2219"
# fixed value: clock in which dates from structured data are shown
JSONLD_ZONE = "America/New_York"
# fixed value: offsets, in minutes, of zone names allowed after a time
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_NTZ = "timestamp_ntz"
_TIME = r"(?:(?:\s*T|\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*(Z|UTC|GMT|[ECMP][SD]T|[+-]\d{2}:?\d{2}|[+-]\d{2})?)?"
_ISO = rf"(?i)^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_TIME}$"
_AMERICAN = rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_TIME}$"
_DAY_FIRST = rf"(?i)^(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]+([a-z]{{3,9}})[\s,-]+(\d{{4}}){_TIME}$"
_EPOCH = r"^@(-?\d+)$"
# words of a relative date: a clock, a signed number, or letters
_RELATIVE = r"[0-9]+:[0-9]+(?::[0-9]+)?|[+-]?[0-9]+|[a-z]+"
# fixed values: words that count, days of the week from Monday, units in months or seconds
COUNT_WORDS = {
    "last": -1, "previous": -1, "this": 0, "next": 1, "first": 1, "third": 3, "fourth": 4, "fifth": 5,
    "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12,
}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
UNIT_MONTHS = {"month": 1, "year": 12}
UNIT_SECONDS = {
    "sec": 1, "second": 1, "min": 60, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "fortnight": 1209600,
}
#: Seconds from the epoch of the years 1 and 9999: what a timestamp can hold.
_FIRST, _LAST = -62135596800, 253402300799


def normalize_date_text(c: Column | str) -> Column:
    """no-break spaces and bullets become spaces, runs collapse, ends are trimmed."""
    c = F.translate(as_col(c), SEPARATORS, " " * len(SEPARATORS))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def to_zone(utc: Column, zone: Column | str) -> Column:
    """Wall clock of ``zone`` for a UTC wall clock."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(F.lit("UTC"), zone, utc.cast(_NTZ))


def _table(entries: dict[str, int]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in entries.items()) + ")")


def _month_number(name: Column) -> Column:
    names = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
    return F.try_element_at(_table(names), F.lower(name))


def _wall_clock(year: Column, month: Column, day: Column, hour: Column, minute: Column, second=None) -> Column:
    """Days, hours and minutes beyond their range roll over."""
    first = F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))
    second = F.lit(0) if second is None else second
    return first.cast(_NTZ) + F.make_dt_interval(day - 1, hour, minute, second.cast("decimal(18,6)"))


def _number(digits: Column) -> Column:
    """What few digits stand for, 0 for none. A failing ``try_cast`` costs an exception, so none is tried on the empty string."""
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("int"))


def _digits(word: Column, least: int, most: int) -> Column:
    """The number a word of so many digits stands for, null for any other word."""
    fits = F.length(word).between(least, most) & (F.translate(word, "0123456789", "") == "")
    return F.when(fits, word.try_cast("int"))


def parse_month_date(c: Column | str) -> Column:
    """``Mon D, YYYY [time [am/pm]]`` anywhere in the text, as printed; a printed
    zone is ignored, a missing time is midnight.

    The text is read as words (letters, digits, single signs). A month name with a day, a
    comma and a year after it is the date; the next number is its time if a colon and minutes follow."""

    def at(words: Column, place: Column) -> Column:
        return F.coalesce(F.get(words, place), F.lit(""))

    def dated(words: Column) -> Column:
        def starts(word: Column, i: Column) -> Column:
            numbers = _digits(at(words, i + 1), 1, 2).isNotNull() & _digits(at(words, i + 3), 4, 4).isNotNull()
            return (at(words, i + 2) == ",") & numbers & _month_number(word).isNotNull()

        place = F.array_position(F.transform(words, starts), F.lit(True)).cast("int")
        return let(place, lambda found: F.when(found > 0, let(F.slice(words, found, F.size(words)), read)))

    def read(words: Column) -> Column:
        """``words`` from the month on."""
        number = F.array_position(F.transform(words, lambda w, i: (i > 3) & w.between("0", ":")), F.lit(True)).cast("int") - 1
        return let(number, lambda n: let(timed(words, n), lambda hm: F.when(
            hm["hour"].isNotNull(),
            _wall_clock(_digits(at(words, F.lit(3)), 4, 4), _month_number(at(words, F.lit(0))), _digits(at(words, F.lit(1)), 1, 2), hm["hour"], hm["minute"]),
        )))

    def timed(words: Column, n: Column) -> Column:
        hour, half = _digits(at(words, n), 1, 2), at(words, n + 3)
        minute = _digits(F.substring(at(words, n + 2), 1, 2), 2, 2)
        # a 12-hour clock has no hours 0 and 13; such a date is not read
        hour24 = F.when(~half.isin("am", "pm"), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
        given = (n >= 0) & (at(words, n + 1) == ":") & hour.isNotNull() & minute.isNotNull()
        return F.when(given, F.struct(hour24.alias("hour"), minute.alias("minute"))).otherwise(
            F.struct(F.lit(0).alias("hour"), F.lit(0).alias("minute"))
        )

    def parse(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[0-9]+|[^\p{L}0-9\s]"), F.lit(0))
        return F.when(F.contains(text, F.lit(",")), let(words, dated))

    return let(as_col(c), parse)


def _offset_minutes(zone: Column) -> Column:
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    signed = let(digits, lambda d: _number(F.substring(d, 1, 2)) * 60 + _number(F.substring(d, 3, 2)))
    named = F.coalesce(F.try_element_at(_table(ZONE_MINUTES), F.lower(zone)), F.lit(0))
    return (
        F.when(zone == "", F.lit(0)).when(F.startswith(zone, F.lit("-")), -signed)
        .when(F.startswith(zone, F.lit("+")), signed).otherwise(named)
    )


def _zoned(text: Column, pattern: str, year: int, month: Callable[[Callable[[int], Column]], Column], day: int) -> Column:
    """``month`` gets the function from a group's number to its text. All groups come from one match."""

    def read(groups: Column) -> Column:
        part = lambda i: F.get(groups, F.lit(i - 1))
        clock = _wall_clock(
            _number(part(year)), month(part), _number(part(day)), _number(part(4)), _number(part(5)), _number(part(6)),
        )
        return clock - F.make_dt_interval(F.lit(0), F.lit(0), let(part(7), _offset_minutes))

    # no group holds a bar; a line end that $ lets follow goes too
    groups = F.split(F.regexp_replace(text, pattern + r"(?s:.*)", "$1|$2|$3|$4|$5|$6|$7"), r"\|")
    return F.when(F.rlike(text, F.lit(pattern)), let(groups, read))


def _word_table() -> Column:
    """Known words of relative dates: kind and value."""
    words = {w: ("said", n) for w, n in COUNT_WORDS.items()} | {w: ("zone", n * 60) for w, n in ZONE_MINUTES.items()}
    for units, kind in ((UNIT_MONTHS, "months"), (UNIT_SECONDS, "seconds")):
        words |= {u + end: (kind, n) for u, n in units.items() for end in ("", "s")}
    words |= {w[:n]: ("weekday", i) for i, w in enumerate(WEEKDAYS) for n in (3, 9)}
    words |= {"today": ("base", 0), "midnight": ("base", 0), "tomorrow": ("base", 86400), "yesterday": ("base", -86400)}
    words |= {"now": ("now", 0), "noon": ("clock", 43200), "am": ("half", 0), "pm": ("half", 43200), "ago": ("ago", -1)}
    return F.expr("map(" + ", ".join(f"'{w}', struct('{k}' as kind, {n}L as value)" for w, (k, n) in words.items()) + ")")


def _relative_words(text: Column) -> Column:
    """What the words of a relative date add up to, as a fold over them; null when a word means nothing there.

    ``count`` is a number that waits for its unit, ``said`` whether it was said in words (``next``, ``last``)."""
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    start = F.struct(
        F.lit(True).alias("ok"), none.alias("count"), F.lit(False).alias("said"), zero.alias("months"), zero.alias("seconds"),
        none.alias("weekday"), none.alias("side"), none.alias("clock"), F.lit(False).alias("midnight"), zero.alias("zone"),
    )

    def known(word: Column) -> Column:
        part = lambda i: F.get(F.split(word, ":"), F.lit(i)).try_cast("long")
        clock = part(0) * 3600 + part(1) * 60 + F.coalesce(part(2), F.lit(0))
        spoken = F.struct(F.lit("clock").alias("kind"), F.when((part(0) < 25) & (part(1) < 60), clock).alias("value"))
        # a number that no timestamp can be away by is no date
        near = F.when(F.abs(word.try_cast("decimal(38,0)")) < _LAST, word.try_cast("long"))
        number = F.struct(F.lit("number").alias("kind"), near.alias("value"))
        return F.when(F.contains(word, F.lit(":")), spoken).when(word < ":", number).otherwise(F.try_element_at(_word_table(), word))

    def step(s: Column, w: Column) -> Column:
        kind, value, waits = w["kind"], w["value"], s["count"].isNotNull()
        fits = (
            F.when(kind.isin("months", "seconds"), waits).when(kind == "weekday", ~waits | s["said"])
            .when(kind == "half", s["clock"].between(3600, 46799)).otherwise(~waits)
        )
        sign = F.when(kind == "ago", -1).otherwise(1)
        moved = F.when(kind == "seconds", F.try_multiply(s["count"], value)).when(kind == "base", value).otherwise(zero)
        clock = F.when(kind == "clock", value).when(kind == "half", s["clock"] % 43200 + value).otherwise(s["clock"])
        return F.struct(
            (s["ok"] & F.coalesce(fits & value.isNotNull(), F.lit(False))).alias("ok"),
            F.when(kind.isin("number", "said"), value).alias("count"), (kind == "said").alias("said"),
            F.try_add(s["months"] * sign, F.when(kind == "months", F.try_multiply(s["count"], value)).otherwise(zero)).alias("months"),
            F.try_add(s["seconds"] * sign, moved).alias("seconds"),
            F.when(kind == "weekday", value).otherwise(s["weekday"]).alias("weekday"),
            F.when(kind == "weekday", F.coalesce(s["count"], zero)).otherwise(s["side"]).alias("side"), clock.alias("clock"),
            (s["midnight"] | kind.isin("weekday", "clock", "base")).alias("midnight"),
            F.when(kind == "zone", value).otherwise(s["zone"]).alias("zone"),
        )

    words = F.transform(F.regexp_extract_all(text, F.lit(_RELATIVE), F.lit(0)), known)
    whole = F.rlike(text, F.lit(rf"^[ ,]*(?:(?:{_RELATIVE})[ ,]*)+$"))
    added = lambda ws: F.aggregate(ws, start, step, lambda s: F.when(s["ok"] & s["count"].isNull(), s))
    # most texts that are no dates have a word that means nothing anywhere
    return F.when(whole, let(words, lambda ws: F.when(F.forall(ws, lambda w: w["value"].isNotNull()), added(ws))))


def _relative_date(text: Column, run_ts: Column) -> Column:
    """Run time, moved by what the words say. Months beyond a month's last day run on into the next."""

    def moved(r: Column) -> Column:
        day = F.date_trunc("day", run_ts).cast(_NTZ)
        time = F.unix_timestamp(run_ts.cast("timestamp")) - F.unix_timestamp(day.cast("timestamp"))
        first = F.add_months(F.trunc(day.cast("date"), "month"), r["months"].cast("int"))
        seconds = F.when(r["midnight"], F.coalesce(r["clock"], F.lit(0))).otherwise(time) - r["zone"]
        days = F.dayofmonth(day) - 1 + F.floor(r["seconds"] / 86400)
        # a weekday is looked for from the day that the units lead to
        today = F.pmod(F.weekday(first) + days, F.lit(7))
        # from today on, strictly after it, or strictly before it
        onward, later = F.pmod(r["weekday"] - today, F.lit(7)), F.pmod(r["weekday"] - today - 1, F.lit(7)) + 1
        ahead = F.when(r["side"] > 0, later).otherwise(onward - F.when(r["side"] < 0, 7).otherwise(0))
        return first.cast(_NTZ) + F.make_dt_interval(
            (days + F.coalesce(ahead, F.lit(0))).cast("int"), F.lit(0), F.lit(0),
            (F.pmod(r["seconds"], F.lit(86400)) + seconds).cast("decimal(18,6)"),
        )

    reach = F.lit(86400 * 365 * 1000)  # a thousand years either way
    return let(
        _relative_words(text),
        lambda r: F.when((F.abs(r["seconds"]) < reach) & (F.abs(r["months"]) < 12000), moved(r)),
    )


def parse_general_date(c: Column | str, zone: Column | str, run_ts: Column) -> Column:
    """other written forms, read as UTC unless they carry an offset, shown in
    ``zone``. Known forms: ``2024-01-05``, ISO times with or without offset,
    ``1/5/2024``, ``5 January 2024``, mail dates, ``@epoch``, and relative ones made of ``now``,
    ``today``, ``tomorrow``, ``yesterday``, ``noon``, ``midnight``, numbers or ``next``, ``last``, ``this`` and
    ordinals with units (``-3 days 2 hours``, ``2 weeks ago``, ``next month``), weekdays, clocks and zone names."""
    run_ts = run_ts.cast(_NTZ)

    def since_epoch(epoch: Column) -> Column:
        return F.when(epoch.between(_FIRST, _LAST), F.lit("1970-01-01 00:00:00").cast(_NTZ) + F.make_dt_interval(
            F.floor(epoch / 86400).cast("int"), F.lit(0), F.lit(0), F.pmod(epoch, F.lit(86400)).cast("decimal(18,6)")
        ))

    def parse(text: Column) -> Column:
        at_epoch = F.when(F.rlike(text, F.lit(_EPOCH)), let(F.regexp_extract(text, _EPOCH, 1).try_cast("long"), since_epoch))
        utc = F.coalesce(
            _zoned(text, _ISO, 1, lambda part: _number(part(2)), 3),
            _zoned(text, _AMERICAN, 3, lambda part: _number(part(1)), 2),
            _zoned(text, _DAY_FIRST, 3, lambda part: _month_number(part(2)), 1),
            at_epoch,
            _relative_date(F.lower(text), run_ts),
        )
        return to_zone(utc, zone)

    return let(as_col(c), parse)


def parse_date(c: Column | str, zone: Column | str, run_ts: Column) -> Column:
    """F1-F3 in order; null when no form is recognised."""
    return let(
        normalize_date_text(c),
        lambda t: F.coalesce(parse_month_date(t), parse_general_date(t, zone, run_ts)),
    )


def date_or_now(c: Column | str, zone: Column | str, run_ts: Column) -> Column:
    """never null."""
    return F.coalesce(parse_date(c, zone, run_ts), to_zone(run_ts, zone))


def jsonld_date(scripts: Column | str, run_ts: Column, zone: str = JSONLD_ZONE) -> Column:
    """E5: first script whose top-level publication or creation date is readable. Dates
    are UTC unless they carry an offset, months by name too; a script with text after its
    document is not JSON."""

    def read(written: Column) -> Column:
        return F.coalesce(parse_general_date(written, zone, run_ts), to_zone(parse_month_date(written), zone))

    def script_date(text: Column) -> Column:
        written = F.coalesce(
            F.get_json_object(text, "$.datePublished"), F.get_json_object(text, "$.dateCreated")
        )
        inside = F.concat(F.lit("["), text, F.lit("]"))
        whole = F.try_parse_json(inside).isNotNull() & F.get_json_object(inside, "$[1]").isNull()
        return F.when(is_present(written) & whole, let(normalize_date_text(written), read))

    dates = F.filter(F.transform(as_col(scripts), script_date), lambda d: d.isNotNull())
    return F.try_element_at(dates, F.lit(1))


def short_zone(c: Column | str) -> Column:
    """``EST`` and ``EDT`` become ``ET``: names that differ in standard or daylight time only are one."""
    zones = [z.upper() for z in ZONE_MINUTES]
    short = {z: z[0] + z[2] for z in zones if z[1:] == "ST" or z[1:] == "DT"}
    pairs = [F.lit(x) for kv in short.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(c)), as_col(c))


def is_today(post_date: Column | str, run_ts: Column, zone: Column | str) -> Column:
    """the article date is the run date on the site's clock."""
    return as_col(post_date).cast("date") == to_zone(run_ts, zone).cast("date")
