"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

Found and validated: e-mail addresses, IBANs (mod 97), payment cards (Luhn), social security numbers
(issued ranges), IPv4 addresses, North American phone numbers, international ones (+, 8 to 15 digits in
groups of any sizes, a bracketed (0) too), and calendar dates from 1800 to 2199.  Each is replaced by another value of its format: a keyed Feistel network permutes
the value's domain, and check digits are computed anew, so a pseudonym passes the same validation.
A permutation gives equal values equal pseudonyms in all documents, and different ones different
pseudonyms; ``restore`` runs the rounds backwards.  What fails validation is left as it is, but every
shorter length, every other kind and every later place inside it is tried.  Only where a pseudonym
would be read otherwise, because of digits around it, it is the next one of the permutation.

Two networks serve all formats.  Text (digits and letters) is cut in halves, and each character moves
within its class, by a digest of the other half and its place.  Numbers are a pair (l, r) below a and
b, and move by modular addition, which needs no retries for any a and b.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_CYCLE = (773, 189)  # 773 * 189 = 146,097 days: 400 years of the calendar, from 1800-01-01
_SSN = (898, 99 * 9999)  # areas 001-899 but 666; groups 01-99 with serials 0001-9999

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
_L, _R = r"(?<![0-9A-Za-z])(?<![0-9][.,/-])", r"(?![0-9A-Za-z])(?![.,/-][0-9])"
_NO_CARD = r"(?! (?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z]))"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": _EMAIL,
    "iban": _L + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _R,
    "date": _L + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})" + _R,
    "ip": _L + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + _R,
    "ssn": _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R,
    "card": _L + r"[0-9](?:[ -]?[0-9]){12,18}" + _R,
    "phone": r"(?<![0-9A-Za-z+])(?<![0-9][.,/-])(?:(?:\+?1[ .-]?)?\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}|(?:\+?1[ .-])?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4})" + _R,
    "intl_phone": r"(?<![0-9A-Za-z+])\+[1-9](?:" + _NO_CARD + r"\)?[ ./-]?\(?[0-9]){7,14}" + _R,
}
ANY = "|".join(PATTERNS.values())
#: E-mail addresses, and runs of words with a digit or capital in front, which no other value leaves.
#: Pseudonyms do not change where they start and end.
REGION = _EMAIL + r"|(?<![0-9A-Za-z+])(?:\+\(?(?=[0-9])|(?<![0-9][.,/-])\(?(?=[0-9]|[A-Z]{2}[0-9]{2}))[0-9A-Za-z@._%+-]++(?:[ .,/()+-]{1,4}[0-9A-Z][0-9A-Za-z@._%+-]*+)*+"
_REACH = 80  # characters that a value other than an e-mail address has at most, and two after it
_WALK = 100  # steps at most until a region reads as before


def _forms(kind: str) -> list[str]:
    """The patterns of a kind without what stands before, the longest first, one for each length that
    validation has to choose from."""
    whole = PATTERNS[kind].removeprefix(_L)
    if kind == "card":
        return [whole.replace("{12,18}", f"{{{n}}}") for n in range(18, 11, -1)]
    if kind == "iban":
        return ["[A-Z]{2}[0-9]{2}" + f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + _R for n in range(31, 7, -1)]
    return [whole]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _int(s: Column) -> Column:
    return s.cast("bigint")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


class _Keyed:
    """The networks for one key, forwards or backwards."""

    def __init__(self, key: str, backwards: bool):
        self.key, self.sign = key, -1 if backwards else 1
        first, last = (ROUNDS - 1, 0) if backwards else (0, ROUNDS - 1)
        self.rounds = F.sequence(F.lit(first), F.lit(last), F.lit(-1 if backwards else 1))

    def _draw(self, kind: str, *given: Column) -> Column:
        """A number below 2^52 from the key and what is given."""
        digest = F.sha2(F.concat_ws("|", F.lit(self.key), F.lit(kind), *[g.cast("string") for g in given]), 256)
        return _int(F.conv(F.substring(digest, 1, 13), 16, 10))

    def _moved(self, half: Column, other: Column, i: Column, kind: str) -> Column:
        whole = F.sha2(F.concat_ws("|", F.lit(self.key), F.lit(kind), i.cast("string"), F.length(half).cast("string"), other), 256)

        def moved(seed: Column) -> Column:
            def move(c: Column, p: Column) -> Column:
                step = self.sign * _int(F.conv(F.substring(F.sha2(F.concat_ws("|", seed, p.cast("string")), 256), 1, 8), 16, 10))
                out = c
                for first, size in ((48, 10), (65, 26), (97, 26)):
                    out = F.when(c.between(chr(first), chr(first + size - 1)), F.chr(first + F.pmod(F.ascii(c) - first + step, F.lit(size)))).otherwise(out)
                return out

            return F.array_join(F.transform(_chars(half), move), "")

        return _let(whole, moved)

    def text(self, s: Column, kind: str) -> Column:
        """Characters of ``s`` moved within their classes."""
        half = F.floor(F.length(s) / 2).cast("int")
        start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1).alias("r"))

        def turn(st: Column, i: Column) -> Column:
            even = F.pmod(i, F.lit(2)) == 0
            return F.struct(
                F.when(even, self._moved(st["l"], st["r"], i, kind)).otherwise(st["l"]).alias("l"),
                F.when(even, st["r"]).otherwise(self._moved(st["r"], st["l"], i, kind)).alias("r"),
            )

        return F.aggregate(self.rounds, start, turn, lambda st: F.concat(st["l"], st["r"]))

    def pair(self, left: Column, right: Column, sizes: tuple[int, int], kind: str) -> Column:
        """(l, r) with l and r moved below ``sizes``."""
        a, b = (F.lit(x).cast("bigint") for x in sizes)

        def turn(st: Column, i: Column) -> Column:
            even = F.pmod(i, F.lit(2)) == 0
            return F.struct(
                F.when(even, F.pmod(st["l"] + self.sign * self._draw(kind, i, st["r"]), a)).otherwise(st["l"]).alias("l"),
                F.when(even, st["r"]).otherwise(F.pmod(st["r"] + self.sign * self._draw(kind, i, st["l"]), b)).alias("r"),
            )

        return F.aggregate(self.rounds, F.struct(_int(left).alias("l"), _int(right).alias("r")), turn)


def _luhn(digits: Column) -> Column:
    def value(c: Column, p: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(p, F.lit(2)) == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), value), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder of a text whose letters count as the numbers 10 to 35."""

    def step(a: Column, c: Column) -> Column:
        digit = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(a * F.when(digit > 9, 100).otherwise(10) + digit, F.lit(97)).cast("int")

    return F.aggregate(_chars(text), F.lit(0), step)


def _back_into(form: Column, values: Column, pattern: str) -> Column:
    """``form`` with its characters of ``pattern`` replaced, in order, by those of ``values``."""

    def put(all_values: Column) -> Column:
        def one(c: Column, p: Column) -> Column:
            before = F.length(F.regexp_replace(F.substr(form, F.lit(1), p), f"[^{pattern}]", ""))
            return F.when(c.rlike(f"[{pattern}]"), F.substr(all_values, before + 1, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(_chars(form), one), "")

    return _let(values, put)


def _date_parts(m: Column) -> tuple[Column, Column, Column]:
    number = lambda k: F.element_at(F.split(m, "[-/.]"), k).cast("int")
    year_first = m.rlike("^[0-9]{4}")
    month_first = m.rlike("^[0-9]{1,2}/")
    year = F.when(year_first, number(1)).otherwise(number(3))
    month = F.when(year_first | ~month_first, number(2)).otherwise(number(1))
    day = F.when(year_first, number(3)).when(month_first, number(2)).otherwise(number(1))
    return year, month, day


def _is_date(m: Column) -> Column:
    year, month, day = _date_parts(m)
    plausible = year.between(1800, 2199) & month.between(1, 12) & day.between(1, 31)
    return F.when(plausible, day <= F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))).otherwise(False)


def _new_date(m: Column, by: _Keyed) -> Column:
    year, month, day = _date_parts(m)
    start = F.lit("1800-01-01").cast("date")
    days = F.datediff(F.make_date(year, month, day), start)
    pair = by.pair(F.floor(days / _CYCLE[1]), F.pmod(days, F.lit(_CYCLE[1])), _CYCLE, "date")
    short = m.rlike(r"(^|[/.])[0-9][/.]")  # written without leading zeros

    def written(new: Column) -> Column:
        style = lambda form, brief: F.when(short, F.date_format(new, brief)).otherwise(F.date_format(new, form))
        return (
            F.when(m.rlike("^[0-9]{4}-"), F.date_format(new, "yyyy-MM-dd"))
            .when(m.rlike("^[0-9]{4}/"), F.date_format(new, "yyyy/MM/dd"))
            .when(m.contains("."), style("dd.MM.yyyy", "d.M.yyyy"))
            .otherwise(style("MM/dd/yyyy", "M/d/yyyy"))
        )

    return _let(pair, lambda moved: written(F.date_add(start, (moved["l"] * _CYCLE[1] + moved["r"]).cast("int"))))


def _octets(m: Column) -> list[Column]:
    return [F.element_at(F.split(m, r"\."), k).cast("int") for k in range(1, 5)]


def _new_ip(m: Column, by: _Keyed) -> Column:
    a, b, c, d = _octets(m)
    written = lambda moved: F.concat_ws(".", *[x.cast("string") for half in ("l", "r") for x in (F.shiftright(moved[half], 8), F.pmod(moved[half], F.lit(256)))])
    return _let(by.pair(a * 256 + b, c * 256 + d, (65536, 65536), "ip"), written)


def _new_ssn(m: Column, by: _Keyed) -> Column:
    area, group, serial = (_int(F.element_at(F.split(m, "-"), k)) for k in (1, 2, 3))
    at = area - 1 - F.when(area > 666, 1).otherwise(0)

    def written(moved: Column) -> Column:
        new = moved["l"] + 1 + F.when(moved["l"] >= 665, 1).otherwise(0)
        return F.concat_ws(
            "-", F.lpad(new.cast("string"), 3, "0"), F.lpad((F.floor(moved["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(moved["r"], F.lit(9999)) + 1).cast("string"), 4, "0")
        )

    return _let(by.pair(at, (group - 1) * 9999 + serial - 1, _SSN, "ssn"), written)


def _new_card(m: Column, by: _Keyed) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    payload = F.concat(F.substr(digits, F.lit(1), F.lit(1)), by.text(F.substr(digits, F.lit(2), n - 2), "card"))
    check = lambda p: F.pmod(10 - F.pmod(_luhn(F.concat(p, F.lit("0"))), F.lit(10)), F.lit(10))
    return _back_into(m, _let(payload, lambda p: F.concat(p, check(p).cast("string"))), "0-9")


def _new_iban(m: Column, by: _Keyed) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country = F.substr(plain, F.lit(1), F.lit(2))
    check = lambda own: 98 - _mod97(F.concat(own, country, F.lit("00")))
    new = _let(by.text(F.substr(plain, F.lit(5)), "iban"), lambda own: F.concat(country, F.lpad(check(own).cast("string"), 2, "0"), own))
    return _back_into(m, new, "0-9A-Z")


def _new_phone(m: Column, by: _Keyed) -> Column:
    """The first digits of area and exchange stay, as they may not be 0 or 1."""
    digits = _digits(m)
    own = F.substr(digits, F.length(digits) - 9)
    part = lambda s, n: F.substr(own, F.lit(s), F.lit(n))
    whole = lambda new: F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), part(1, 1), F.substr(new, F.lit(1), F.lit(2)), part(4, 1), F.substr(new, F.lit(3)))
    return _back_into(m, _let(by.text(F.concat(part(2, 2), part(5, 6)), "phone"), whole), "0-9")


def _new_intl(m: Column, by: _Keyed) -> Column:
    """The first two digits stay: they are the country's."""
    digits = _digits(m)
    return _back_into(m, F.concat(F.substr(digits, F.lit(1), F.lit(2)), by.text(F.substr(digits, F.lit(3)), "intl_phone")), "0-9")


def _new_email(m: Column, by: _Keyed) -> Column:
    at = F.instr(m, "@")
    return F.concat(by.text(F.substr(m, F.lit(1), at - 1), "email"), F.substr(m, at))


_NEW = {"email": _new_email, "iban": _new_iban, "date": _new_date, "ip": _new_ip, "ssn": _new_ssn, "card": _new_card, "phone": _new_phone, "intl_phone": _new_intl}


_VALID = {
    "iban": lambda m: _mod97(F.concat(F.substr(F.regexp_replace(m, " ", ""), F.lit(5)), F.substr(m, F.lit(1), F.lit(4)))) == 1,
    "date": lambda m: _is_date(m),
    "ip": lambda m: F.forall(F.array(*_octets(m)), lambda x: x < 256) & ~m.rlike(r"(^|\.)0[0-9]"),
    "ssn": lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"),
    "card": lambda m: F.pmod(_luhn(_digits(m)), F.lit(10)) == 0,
}


def _value_at(rest: Column) -> Column:
    """Kind, tab and value of the first kind, and of it the longest, that is valid where ``rest`` starts,
    or null."""

    def first(kind: str) -> Column:
        found = F.array(*[F.regexp_extract(rest, f"^(?:{form})", 0) for form in _forms(kind)])
        good = F.filter(found, lambda m: F.when(m != "", _VALID[kind](m) if kind in _VALID else F.lit(True)).otherwise(False))
        return F.when(rest.rlike(f"^(?:{PATTERNS[kind].removeprefix(_L)})"), F.concat(F.lit(f"{kind}\t"), F.get(good, F.lit(0))))

    return F.coalesce(*[first(kind) for kind in PATTERNS])


def _read(region: Column) -> Column:
    """The values in ``region`` from left to right: ``found`` (gap before, kind, value), and the ``rest``.
    Every place is tried, also those inside what failed; a value starts where the one before has ended."""
    places = F.split(F.concat(F.lit("\n"), region), f"(?={ANY})", -1)
    rests = F.regexp_extract_all(region, F.lit(rf"(?={ANY})(?=({_EMAIL}|[\s\S]{{1,{_REACH}}}))"), F.lit(1))
    values = F.transform(rests, _value_at)
    steps = F.zip_with(F.slice(places, F.lit(2), F.size(rests)), values, lambda p, v: F.struct(F.length(p).alias("n"), F.substring_index(v, "\t", 1).alias("kind"), F.substring_index(v, "\t", -1).alias("value")))
    none = F.array().cast("array<struct<gap:string,kind:string,value:string>>")
    start = F.struct((F.length(F.get(places, F.lit(0))) - 1).alias("at"), F.lit(0).alias("end"), none.alias("found"))

    def step(st: Column, x: Column) -> Column:
        taken = x["kind"].isNotNull() & (st["at"] >= st["end"])
        gap = F.substr(region, st["end"] + 1, st["at"] - st["end"])
        return F.struct(
            (st["at"] + x["n"]).alias("at"),
            F.when(taken, st["at"] + F.length(x["value"])).otherwise(st["end"]).alias("end"),
            F.when(taken, F.concat(st["found"], F.array(F.struct(gap.alias("gap"), x["kind"].alias("kind"), x["value"].alias("value"))))).otherwise(st["found"]).alias("found"),
        )

    return F.aggregate(steps, start, step, lambda st: F.struct(st["found"].alias("found"), F.substr(region, st["end"] + 1).alias("rest")))


def _joined(found: Column, rest: Column) -> Column:
    return F.concat(F.array_join(F.transform(found, lambda x: F.concat(x["gap"], x["value"])), ""), rest)


def _moved_region(region: Column, by: _Keyed) -> Column:
    """``value``, the region with pseudonyms, and the ``kinds`` in it.

    Digits around a value can make it read otherwise after it has moved (a card and the number behind it
    as one longer card).  All values of such a region move on until it reads as before, which
    the way back undoes step by step."""

    def move(x: Column) -> Column:
        value = x["value"]
        for k, f in _NEW.items():
            value = F.when(x["kind"] == k, f(x["value"], by)).otherwise(value)
        return F.struct(x["gap"].alias("gap"), x["kind"].alias("kind"), value.alias("value"))

    def walk(r: Column) -> Column:
        def turn(st: Column, _: Column) -> Column:
            text = lambda found: F.struct(found.alias("found"), _joined(found, r["rest"]).alias("text"))
            read = lambda x: F.struct(x["found"].alias("found"), x["text"].alias("text"), (_read(x["text"])["found"] == x["found"]).alias("done"))
            once = F.transform(F.transform(F.array(F.transform(st["found"], move)), text), read)
            return F.when(st["done"], st).otherwise(F.get(once, F.lit(0)))

        start = F.struct(r["found"].alias("found"), region.alias("text"), (F.size(r["found"]) == 0).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, turn, lambda st: F.struct(st["text"].alias("value"), st["found"]["kind"].alias("kinds")))

    return F.get(F.transform(F.array(_read(region)), walk), F.lit(0))


def _replace(docs: DataFrame, key: str, backwards: bool) -> DataFrame:
    by = _Keyed(key, backwards)
    none = F.array().cast("array<string>")
    new = lambda m: F.when(m.rlike(ANY), _moved_region(m, by)).otherwise(F.struct(m.alias("value"), none.alias("kinds")))
    rows = docs.select("doc_id", F.col("text"), F.when(F.col("text").rlike(ANY), F.regexp_extract_all("text", F.lit(REGION), F.lit(0))).alias("_regions"))
    rows = rows.withColumn("_new", F.when(F.size("_regions") > 0, F.transform("_regions", new)))
    whole = F.array_join(F.zip_with(F.split("text", REGION, -1), F.col("_new"), lambda p, x: F.concat(p, F.coalesce(x["value"], F.lit("")))), "")
    rows = rows.select("doc_id", F.when(F.col("_new").isNotNull(), whole).otherwise(F.col("text")).alias("text"), F.coalesce(F.flatten("_new.kinds"), none).alias("_kinds"))
    return rows.select("doc_id", "text", F.size("_kinds").alias("n_found"), *[F.size(F.filter("_kinds", lambda x: x == k)).alias(f"n_{k}") for k in PATTERNS])


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text with pseudonyms, n_found and a count per kind.

    A missing text stays missing, with counts 0.  Slashes are read as month/day/year; other orders
    are left alone, as they could not be told apart afterwards.  Other columns are not looked at.
    """
    return _replace(docs, key, False)


def restore(docs: DataFrame, key: str) -> DataFrame:
    """The inverse of :func:`pseudonymise` with the same key."""
    return _replace(docs, key, True)
