"""Format-preserving pseudonyms for personal data (operator 3), DataFrame functions only.

Personal values are found by pattern, validated (check digit, calendar, ranges) and permuted within their own format by a
keyed Feistel network, so equal values stay equal in every document, different ones stay different, separators
stay (lengths too, but for IPv4 addresses), and the key holder can undo it. A network works on pairs (left, right) of numbers below
two radices and adds, in turn, a keyed hash of one to the other; the radices multiply to the exact number of
values of a format, so no value leaves it:

* card numbers of 13 to 19 digits with a right check digit: all digits before it, the check digit is made anew
* telephone numbers with a country code (in groups of three and four, or ending in pairs): all digits behind the code
* telephone numbers of ten digits, (ddd) ddd-dddd, ddd-ddd-dddd or ddd.ddd.dddd: all digits
* dates (year, month, day with - or /; day and month with / or . before the year): days of their 400-year cycle
* dates that only read with the month first (the day is over 12): such days of their 400-year cycle
* social security numbers with valid area, group and serial: the valid ones
* IPv4 addresses: all four bytes
* email addresses: the ASCII letters and digits before the @, as base-36 digits (letters come out lower case)

Values that fail validation stay as they are. Nulls stay null and empty texts empty; texts of any length are
scanned whole; every row keeps its other columns and repeated rows stay equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import fresh

ROUNDS = 8
# Fixed kinds, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?[ .-][0-9]{1,4}(?:[ .-][0-9]{3})?(?:[ .-][0-9]{2}){2,4}(?![0-9]|[.-][0-9])"
    r"|(?<![0-9])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
    r"|(?<![0-9.+-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9]|[.-][0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})"
    r"(?![0-9/]|[.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}"
    r"|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])",
}
# A private-use character escapes itself and marks the borders of matches; no pattern matches any of the three.
ESCAPE, ITSELF, BORDER = "\ue000", "\ue001", "\ue002"


def _noise(key: str, tweak: Column, step: Column, value: Column) -> Column:
    """A keyed number from 0 to 2^60."""
    seed = F.concat_ws("|", F.lit(key), tweak, step, value).cast("binary")
    return F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column, undo: bool = False) -> Column:
    """Struct (left, right): the keyed permutation of 0 <= left < a, 0 <= right < b, or its inverse."""
    steps = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS))])
    way = -1 if undo else 1

    def turn(pair: Column, step: Column) -> Column:
        on_left = step % 2 == 0
        shift = _noise(key, tweak, step, F.when(on_left, pair["right"]).otherwise(pair["left"]))
        # both terms are below the radix, so their sum can't overflow for radices below 2^62
        return F.struct(
            F.when(on_left, F.pmod(pair["left"] + way * F.pmod(shift, a), a)).otherwise(pair["left"]).alias("left"),
            F.when(on_left, pair["right"]).otherwise(F.pmod(pair["right"] + way * F.pmod(shift, b), b)).alias("right"),
        )

    return F.aggregate(steps, F.struct(left.alias("left"), right.alias("right")), turn)


def _power(base: int, exponent: Column) -> Column:
    """base ** exponent as a long; exact, unlike the power of doubles."""
    return F.get(F.array(*[F.lit(base**k) for k in range(19 if base == 10 else 13)]), exponent)


def _permuted(key: str, tweak: Column, digits: Column, base: int, undo: bool) -> Column:
    """Digits of ``base`` as text, permuted among all texts of that length (at most 36 of base 10, 24 of base 36)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    number = lambda part: F.conv(F.concat(F.lit("0"), part), base, 10).cast("long")
    pair = feistel(
        key,
        F.concat_ws("/", tweak, n),
        number(F.substring(digits, F.lit(1), half)),
        number(F.substring(digits, half + 1, n - half)),
        _power(base, half),
        _power(base, n - half),
        undo,
    )
    # one evaluation of the network
    return F.get(
        F.transform(
            F.array(pair),
            lambda p: F.concat(
                F.lpad(F.lower(F.conv(p["left"].cast("string"), 10, base)), half, F.lit("0")),
                F.lpad(F.lower(F.conv(p["right"].cast("string"), 10, base)), n - half, F.lit("0")),
            ),
        ),
        F.lit(0),
    )


def _put_back(value: Column, members: str, others: str, fill: Column) -> Column:
    """``value`` with its characters of the class ``members`` replaced by those of ``fill``, in order."""
    return F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(
                c.rlike(members), F.substring(fill, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), others, "")), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the check rule, the last digit counted once."""
    places = F.split(F.reverse(digits), "")
    weighed = F.transform(places, lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + d - F.when(d > 9, 9).otherwise(0))


def _card(key: str, value: Column, undo: bool) -> Column:
    digits = _digits(value)
    body = _permuted(key, F.lit("card"), F.substring(digits, F.lit(1), F.length(digits) - 1), 10, undo)
    done = F.get(
        F.transform(
            F.array(body),
            lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")),
        ),
        F.lit(0),
    )
    return F.when(luhn_sum(digits) % 10 == 0, _put_back(value, "[0-9]", "[^0-9]", done)).otherwise(value)


def _phone(key: str, value: Column, undo: bool) -> Column:
    code = F.regexp_extract(value, r"^\+([0-9]{1,3}(?=[^0-9])|[0-9])", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    done = _permuted(key, F.concat(F.lit("phone"), code), _digits(rest), 10, undo)
    return F.concat(code, _put_back(rest, "[0-9]", "[^0-9]", done))


def _day(key: str, day: Column, start: Column, undo: bool) -> Column:
    """Any day of the cycle from ``start``: 400 Gregorian years have 146,097 = 189 * 773."""
    place = F.datediff(day, start).cast("long")
    radices = F.lit(189).cast("long"), F.lit(773).cast("long")
    pair = feistel(key, F.lit("date"), F.floor(place / 773).cast("long"), place % 773, *radices, undo)
    return F.get(F.transform(F.array(pair), lambda p: F.date_add(start, (p["left"] * 773 + p["right"]).cast("int"))), F.lit(0))


def _late_day(key: str, day: Column, start: Column, undo: bool) -> Column:
    """Days after the 12th of their month: a cycle has 146,097 - 12 * 4,800 = 88,497 = 9 * 9,833."""
    first = F.year(start)
    months = (F.year(day) - first) * 12 + F.month(day) - 1
    place = (F.datediff(day, start) - 12 * (months + 1)).cast("long")
    radices = F.lit(9).cast("long"), F.lit(9833).cast("long")
    pair = feistel(key, F.lit("late date"), F.floor(place / 9833).cast("long"), place % 9833, *radices, undo)

    def begin(month: Column) -> Column:
        date = F.make_date((first + F.floor(month / 12)).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
        return F.datediff(date, start) - 12 * month

    def dated(rank: Column) -> Column:
        # the month is at most one off its average place
        near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: (F.floor(rank * 4800 / 88497) + d).cast("int"))
        month = F.array_max(F.filter(near, lambda m: begin(m) <= rank))
        return F.date_add(start, (rank + 12 * (month + 1)).cast("int"))

    return F.get(F.transform(F.transform(F.array(pair), lambda p: p["left"] * 9833 + p["right"]), dated), F.lit(0))


def _date(key: str, value: Column, undo: bool) -> Column:
    plain = F.translate(value, "/.", "--")
    read = lambda form: F.try_to_date(plain, form)
    out = value
    # the month comes first only where the day can't
    for form, move in (("MM-dd-yyyy", _late_day), ("dd-MM-yyyy", _day), ("yyyy-MM-dd", _day)):
        shape = plain.rlike("^[0-9]{4}-") if form[0] == "y" else ~plain.rlike("^[0-9]{4}-")
        day = read(form)
        # a cycle starts on 1 January of a year divisible by 400
        start = F.make_date((F.floor(F.year(day) / 400) * 400).cast("int"), F.lit(1), F.lit(1))
        text = _put_back(value, "[0-9]", "[^0-9]", _digits(F.date_format(move(key, day, start, undo), form)))
        # whole cycles of four-digit years only
        valid = shape & day.isNotNull() & (F.year(day) >= 400) & (F.year(day) < 9600)
        out = F.when(valid, text).otherwise(out)
    return out


def _ssn(key: str, value: Column, undo: bool) -> Column:
    area, group, serial = (F.regexp_extract(value, "([0-9]+)-([0-9]+)-([0-9]+)", i).cast("long") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    pair = feistel(key, F.lit("ssn"), left, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), undo)

    def text(p: Column) -> Column:
        rank = F.floor(p["left"] / 99)
        return F.format_string(
            "%03d-%02d-%04d", rank + F.when(rank >= 665, 2).otherwise(1), p["left"] % 99 + 1, p["right"] + 1
        )

    return F.when(valid, F.get(F.transform(F.array(pair), text), F.lit(0))).otherwise(value)


def _ip(key: str, value: Column, undo: bool) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    one, two, three, four = (F.get(parts, F.lit(i)) for i in range(4))
    radix = F.lit(1 << 16).cast("long")
    pair = feistel(key, F.lit("ip"), one * 256 + two, three * 256 + four, radix, radix, undo)

    def text(p: Column) -> Column:
        halves = [F.concat_ws(".", F.floor(p[side] / 256), p[side] % 256) for side in ("left", "right")]
        return F.concat_ws(".", *halves)

    valid = F.forall(parts, lambda p: p < 256)
    return F.when(valid, F.get(F.transform(F.array(pair), text), F.lit(0))).otherwise(value)


def _email(key: str, value: Column, undo: bool) -> Column:
    name = F.substring_index(value, "@", 1)
    plain = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
    chunks = F.regexp_extract_all(plain, F.lit("[a-z0-9]{1,24}"), F.lit(0))
    moved = F.array_join(
        F.transform(chunks, lambda c, i: _permuted(key, F.concat(F.lit("email"), i.cast("string")), c, 36, undo)), ""
    )
    return F.concat(
        _put_back(name, "[A-Za-z0-9]", "[^A-Za-z0-9]", moved), F.substring(value, F.length(name) + 1, F.length(value))
    )


def pseudonym(key: str, value: Column, undo: bool = False) -> Column:
    """The pseudonym of one matched value, or the value if it fails validation."""
    kind = {"email": _email, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}
    out = value
    for name in reversed(list(PATTERNS)):
        out = F.when(value.rlike(f"^(?:{PATTERNS[name]})$"), kind[name](key, value, undo)).otherwise(out)
    return out


def pseudonymise(
    docs: DataFrame, key: str, text: str = "text", found: str | None = None, undo: bool = False
) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced; ``found`` names a column for how many were."""
    parts, done = fresh(docs, "parts", "done")
    mark = ESCAPE + BORDER
    escaped = F.replace(F.col(text), F.lit(ESCAPE), F.lit(ESCAPE + ITSELF))
    # patterns are tried in their order at each place; a match of one ends before the next is sought
    marked = F.regexp_replace(escaped, "|".join(f"(?:{p})" for p in PATTERNS.values()), f"{mark}$0{mark}")
    replaced = F.transform(
        F.col(parts), lambda part, i: F.when(i % 2 == 1, pseudonym(key, part, undo)).otherwise(part)
    )
    joined = F.replace(F.array_join(F.col(done), ""), F.lit(ESCAPE + ITSELF), F.lit(ESCAPE))
    rows = docs.withColumn(parts, F.split(marked, mark, -1))
    rows = rows.withColumn(done, F.when(F.size(parts) > 1, replaced))
    columns = [F.when(F.col(done).isNull(), F.col(text)).otherwise(joined).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if found:
        changed = F.filter(F.arrays_zip(F.col(parts).alias("a"), F.col(done).alias("b")), lambda p: p["a"] != p["b"])
        columns.append(F.when(F.col(done).isNull(), 0).otherwise(F.size(changed)).cast("long").alias(found))
    return rows.select(*columns)
