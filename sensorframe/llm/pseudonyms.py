"""Format-preserving pseudonyms for personal numbers, dates and mail addresses, in SQL expressions only.

Every value that passes its check is permuted, keyed, within the set of values of its own format by a Feistel network:
two halves are added to in turn, each by a SHA-256 of key, kind, round and the other half.  Each round can be undone,
so equal values get equal pseudonyms in all documents and different values different ones.

========  ============================================  ==============================================================
kind      check                                         permuted set
========  ============================================  ==============================================================
card      13 to 19 digits with a right check digit      all such numbers of that length; the check digit is made anew
phone     North American, area and exchange from 200    all of them: 80,000 x 80,000
phone     others of ten digits behind a country code    all of them: 60,000 x 60,000
ssn       area 1-899 but 666, group and serial not 0    all of them: 88,902 x 9,999
address   four numbers up to 255, no leading zeros      all of them: 65,536 x 65,536
date      a date of the calendar, 1800 to 2199          the days of 400 years: 27 x 5,411
date      mm/dd where dd/mm is none                     their days from the 13th on: 9 x 9,833
mail      local part, @ and a domain                    letters stay letters of their case, digits digits; the last
                                                        label of the domain stays
========  ============================================  ==============================================================

Separators and layout stay.  Cards are looked for in whole runs of digit groups, whatever numbers stand beside them;
where several readings pass the check, the usual layouts go first.  What fails its check is left as it is.  Texts are split at the matches and put together
again, so whole texts of any length are handled; texts without digits or an @ are passed on untouched.

Defined results: a null text stays null with 0 values, an empty one empty.  Repeated rows each get the same result.
Other columns are returned as they came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import unclashed

KEY = "change-me"
ROUNDS = 8
# The shapes of values, in the order in which they are tried
SHAPES = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "address": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z(+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: Groups of digits among which cards are looked for; ends before a group that begins a value of another kind.
_OTHERS = "|".join(v for k, v in SHAPES.items() if k not in ("phone", "card"))
_PHONE = SHAPES["phone"].replace(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}", r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}")
RUN = rf"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:[ -](?!{_OTHERS}|{_PHONE})[0-9]++(?![A-Za-z]))*+"
#: Cards as they are mostly written and begun, which win over other runs of groups that pass the check.
USUAL = r"^(?:[2-6][0-9]{12,18}|[2-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{4,5})$"
ANY = "|".join([*(v for k, v in SHAPES.items() if k != "card"), RUN])
MAYBE = "[0-9][0-9 ()./-]{5}|[0-9]{1,3}[.][0-9]|@"


def _hash(key: Column, kind: str, r: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), other.cast("string")), 256)


def feistel(value: Column, low: int, high: int, key: Column, kind: str) -> Column:
    """A permutation of the whole numbers below ``low * high``: the halves are ``value div high`` and the rest."""
    def step(s: Column, r: Column) -> Column:
        def drawn(other: Column, m: int) -> Column:
            return F.conv(F.substring(_hash(key, kind, r, other), 1, 15), 16, 10).cast("long") % m

        return F.struct(
            F.when(r % 2 == 1, (s["l"] + drawn(s["h"], low)) % low).otherwise(s["l"]).alias("l"),
            F.when(r % 2 == 0, (s["h"] + drawn(s["l"], high)) % high).otherwise(s["h"]).alias("h"),
        )

    begin = F.struct(F.floor(value / high).cast("long").alias("l"), (value % high).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: s["l"] * high + s["h"])


def feistel_text(text: Column, key: Column, kind: str) -> Column:
    """A permutation of texts of one shape: digits stay digits, ASCII letters letters of their case, the rest stays."""
    def added(half: Column, stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            drawn = F.conv(F.substring(stream, (i % 30).cast("int") + 1, F.lit(4)), 16, 10).cast("int")
            def turned(first: str, n: int) -> Column:
                return F.char(F.ascii(F.lit(first)) + (F.ascii(c) - F.ascii(F.lit(first)) + drawn) % n)

            return F.when(c.between("0", "9"), turned("0", 10)).when(c.between("a", "z"), turned("a", 26)).when(c.between("A", "Z"), turned("A", 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step(s: Column, r: Column) -> Column:
        return F.struct(
            F.when(r % 2 == 1, added(s["l"], _hash(key, kind, r, s["h"]))).otherwise(s["l"]).alias("l"),
            F.when(r % 2 == 0, added(s["h"], _hash(key, kind, r, s["l"]))).otherwise(s["h"]).alias("h"),
        )

    middle = F.floor(F.length(text) / 2).cast("int")
    begin = F.struct(F.substring(text, F.lit(1), middle).alias("l"), F.substring(text, middle + 1, F.length(text)).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: F.concat(s["l"], s["h"]))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Check sum of digits; those at places from the right of parity ``doubled`` are doubled."""
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda s, x: s + x)


def _laid_out(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced one by one."""
    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"),
            (s["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(match, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda s: s["out"])


def _number(text: Column, at: int, n: int) -> Column:
    return F.substring(text, at, n).cast("long")


def _padded(value: Column, n: int) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _card(m: Column, digits: Column, key: Column) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    fresh = feistel_text(body, key, "card")
    check = (10 - _luhn_sum(fresh, 0) % 10) % 10
    return F.when(_luhn_sum(digits, 1) % 10 == 0, _laid_out(m, F.concat(fresh, check.cast("string"))))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def _joined(pieces: Column, begin: Column, end: Column) -> Column:
    return F.array_join(F.slice(pieces, begin + 1, end - begin), "")


def _unchanged(text: Column) -> Column:
    return F.struct(text.alias("was"), text.alias("now"))


def _cards(run: Column, key: Column) -> Column:
    """A run of groups cut into parts ``was`` and ``now``: its cards, and what stands between them.

    From the left, the best card that begins at a group is taken, unless a card of a usual layout begins inside it.
    """
    def cut(pieces: Column) -> Column:
        n = F.size(pieces)

        def beginning(i: Column) -> Column:
            def whole(j: Column) -> Column:
                text = F.regexp_replace(_joined(pieces, i, j + 1), "[ -]$", "")
                return F.struct(F.when(text.rlike(USUAL), 0).otherwise(1).alias("order"), (-F.length(text)).alias("size"), (j + 1).alias("to"), text.alias("was"))

            def fine(c: Column) -> Column:
                return c["was"].rlike("^[0-9](?:[ -]?[0-9]){12,18}$") & (_luhn_sum(F.regexp_replace(c["was"], "[^0-9]", ""), 1) % 10 == 0)

            return F.sort_array(F.filter(F.transform(F.sequence(i, F.least(i + 18, n - 1)), whole), fine))

        def taken(found: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                def free(c: Column) -> Column:
                    inside = F.slice(found, i + 2, c["to"] - i - 1)
                    return (c["order"] == 0) | ~F.exists(inside, lambda x: F.exists(x, lambda y: y["order"] == 0))

                def picked(best: Column) -> Column:
                    one = F.struct(i.alias("begin"), best["to"].alias("to"), best["was"].alias("was"))
                    return F.when(best.isNotNull(), F.struct(best["to"].alias("next"), F.concat(s["cards"], F.array(one)).alias("cards"))).otherwise(s)

                return F.when((i < s["next"]) | (F.size(found[i]) == 0), s).otherwise(_let(F.try_element_at(F.filter(found[i], free), F.lit(1)), picked))

            begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<begin:int,to:int,was:string>>").alias("cards"))
            return F.aggregate(F.sequence(F.lit(0), n - 1), begin, step)["cards"]

        def parts(cards: Column) -> Column:
            def end(k: Column) -> Column:
                return F.coalesce(F.try_element_at(cards, k)["to"], F.lit(0))

            def part(c: Column, k: Column) -> Column:
                before = F.when(k > 0, end(F.greatest(k, F.lit(1)))).otherwise(0)
                digits = F.regexp_replace(c["was"], "[^0-9]", "")
                card = F.struct(c["was"].alias("was"), F.coalesce(_card(c["was"], digits, key), c["was"]).alias("now"))
                return F.array(_unchanged(_joined(pieces, before, c["begin"])), card, _unchanged(F.regexp_extract(pieces[c["to"] - 1], "[ -]?$", 0)))

            last = F.when(F.size(cards) > 0, end(F.greatest(F.size(cards), F.lit(1)))).otherwise(0)
            return F.concat(F.flatten(F.transform(cards, part)), F.array(_unchanged(_joined(pieces, last, n))))

        return _let(_let(F.transform(F.sequence(F.lit(0), n - 1), beginning), taken), parts)

    return _let(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0)), cut)


def _phone(m: Column, digits: Column, key: Column) -> Column:
    ten = F.substring(digits, -10, 10)
    area, exchange, line = _number(ten, 1, 3), _number(ten, 4, 3), _number(ten, 7, 4)
    drawn = feistel(((area - 200) * 800 + exchange - 200) * 10000 + line, 80_000, 80_000, key, "phone")
    pair = F.floor(drawn / 10000)
    fresh = F.concat(_padded(F.floor(pair / 800) + 200, 3), _padded(pair % 800 + 200, 3), _padded(drawn % 10000, 4))
    # the pairs of area and exchange that are left: 200 x 1000 with a low area, then 800 x 200 with a low exchange
    low = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
    drawn = feistel(low * 10000 + line, 60_000, 60_000, key, "low phone")
    pair = F.floor(drawn / 10000)
    other = pair - 200_000
    area_exchange = F.when(pair < 200_000, _padded(pair, 6)).otherwise(F.concat(_padded(F.floor(other / 200) + 200, 3), _padded(other % 200, 3)))
    rest = F.concat(area_exchange, _padded(drawn % 10000, 4))
    lead = F.substring(digits, F.lit(1), F.length(digits) - 10)
    strict = (area >= 200) & (exchange >= 200)
    return F.when(strict | (lead == "1"), _laid_out(m, F.concat(lead, F.when(strict, fresh).otherwise(rest))))


def _ssn(m: Column, digits: Column, key: Column) -> Column:
    area, group, serial = _number(digits, 1, 3), _number(digits, 4, 2), _number(digits, 6, 4)
    place = area - 1 - (area > 666).cast("long")
    drawn = feistel((place * 99 + group - 1) * 9999 + serial - 1, 88_902, 9_999, key, "ssn")
    pair = F.floor(drawn / 9999)
    fresh = F.floor(pair / 99) + 1
    fresh = fresh + (fresh >= 666).cast("long")
    fine = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(fine, F.concat_ws("-", _padded(fresh, 3), _padded(pair % 99 + 1, 2), _padded(drawn % 9999 + 1, 4)))


def _address(m: Column, digits: Column, key: Column) -> Column:
    parts = F.split(m, r"\.")
    o = [parts[i].cast("long") for i in range(4)]
    drawn = feistel(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65_536, 65_536, key, "address")
    fresh = F.concat_ws(".", *((F.floor(drawn / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)))
    return F.when(F.forall(parts, lambda p: (p.cast("int") <= 255) & ((p == "0") | ~p.startswith("0"))), fresh)


def _late_day(day: Column, key: Column) -> Column:
    """A permutation of the days of 400 years that are the 13th of their month or later, so can't be read as dd/mm."""
    zero = F.lit("1800-01-01").cast("date")

    def before(month: Column) -> Column:
        return F.datediff(F.add_months(zero, month), zero) - 12 * month

    at = (F.year(day) - 1800) * 12 + F.month(day) - 1
    drawn = feistel((before(at) + F.dayofmonth(day) - 13).cast("long"), 9, 9833, key, "month first").cast("int")

    def made(drawn: Column) -> Column:
        guess = F.floor(drawn * 4800 / 88_497).cast("int")
        near = F.sequence(F.greatest(guess - 4, F.lit(0)), F.least(guess + 4, F.lit(4799)))
        month = F.array_max(F.filter(near, lambda k: before(k) <= drawn))
        return F.date_add(F.add_months(zero, month), drawn - before(month) + 12)

    return _let(drawn, made)


def _date(m: Column, digits: Column, key: Column) -> Column:
    iso = m.substr(5, 1) == "-"
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy"))
    zero = F.lit("1800-01-01").cast("date")
    drawn = F.date_add(zero, feistel(F.datediff(day, zero).cast("long"), 27, 5411, key, "date").cast("int"))
    written = F.when(iso, F.date_format(drawn, "yyyy-MM-dd")).otherwise(F.date_format(drawn, "dd.MM.yyyy"))
    fine = day.isNotNull() & F.year(day).between(1800, 2199)
    month_first = F.try_to_date(F.translate(m, "/", "."), "MM.dd.yyyy")
    late = ~iso & day.isNull() & F.year(month_first).between(1800, 2199)
    return F.when(late, _laid_out(m, F.date_format(_late_day(month_first, key), "MMddyyyy"))).when(fine, F.when(iso, written).otherwise(_laid_out(m, F.regexp_replace(written, "[.]", ""))))


def _mail(m: Column, digits: Column, key: Column) -> Column:
    last = F.substring_index(m, ".", -1)
    front = F.substring(m, F.lit(1), F.length(m) - F.length(last))
    return F.concat(feistel_text(front, key, "mail"), last)


MAKERS = {"mail": _mail, "address": _address, "date": _date, "ssn": _ssn, "phone": _phone}


def pseudonym(match: Column, key: Column) -> Column:
    """A match as parts ``was`` and ``now``, which are equal where the part fails its check."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    out = F.when(match.rlike("^[0-9]+(?:[ -][0-9]+)*+$"), _cards(match, key)).otherwise(F.array(_unchanged(match)))
    for kind in reversed(MAKERS):
        # looking around was done when the match was found
        shape = SHAPES[kind][SHAPES[kind].index(")") + 1 :]
        shape = shape[: shape.rindex("(?!")] if "(?!" in shape else shape
        made = F.coalesce(MAKERS[kind](match, digits, key), match)
        out = F.when(match.rlike(f"^(?:{shape})$"), F.array(F.struct(match.alias("was"), made.alias("now")))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, column: str = "text", count: str | None = None, length: str | None = None) -> DataFrame:
    """``docs`` with every validated value in ``column`` replaced.

    ``count`` names a column for the number of values, ``length`` one that holds the text's length and follows it.
    """
    text, secret, made = F.col(column), F.lit(key), unclashed(docs, [count or ""])
    matches = F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(f"({ANY})"), 1))
    fresh = F.transform(matches, lambda m: pseudonym(m, secret))
    out = docs.withColumn(made, fresh)
    rest = F.zip_with(F.split(text, ANY, -1), F.concat(F.transform(made, lambda m: F.array_join(F.transform(m, lambda s: s["now"]), "")), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    out = out.withColumn(column, F.when(F.size(made) > 0, F.array_join(rest, "")).otherwise(text))
    if length:
        out = out.withColumn(length, F.when(F.size(made) > 0, F.length(column)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    if count:
        changed = F.size(F.filter(F.flatten(made), lambda s: s["was"] != s["now"]))
        out = out.withColumn(count, F.coalesce(F.greatest(changed, F.lit(0)), F.lit(0)).cast("long"))
    return out.drop(made)
