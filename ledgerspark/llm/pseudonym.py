"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated values are permuted within their format by a keyed Feistel network, so equal values get
equal pseudonyms in every document and different values stay different:

* card numbers (13-19 digits in whole groups with a right Luhn digit): first digit kept, check digit recomputed
* phone numbers (North American with or without separators, and others of 8-15 digits after +, in
  groups of any size): country part kept, area and exchange codes valid
* social security numbers (valid area, group, serial) and IPv4 addresses (octets of 0-255)
* dates (year-month-day, also before a time; day.month.year, month/day/year or, where the first
  number is over 12, day/month/year; days and months of one or two digits): permuted among the days of their 400-year cycle
* e-mail addresses: letters and digits of the local part; the domain stays

Fixed formats come first, then cards as they are usually written, phones, and cards in any other
groups; a number that fails a check is tried in shorter groups and by the formats behind, and stays
as it is when none fits. A value is an array of symbols with a radix
each; round i adds a keyed hash of one half to the other, symbol by symbol modulo the radix, which
can be undone whatever the radices. Null text stays null; ids, repeated rows and other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EPOCH, CYCLE, CYCLE_RADICES = "1700-01-01", 146097, (189, 773)  # 189 * 773 days are 400 years
# Years 1-99 and 9700-9999 are ranges of their own, so that years keep four digits: days from the
# epoch to their first day, and radices whose product is their number of days.
FIRST_YEARS, FIRST_RADICES = -620547, (51, 709)
LAST_YEARS, LAST_RADICES = 2921940, (276, 397)

# The formats, in order of preference at one place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
DATE = (r"(?<![0-9A-Za-z./-])(?<!\+[0-9]{1,3} )(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
        r"|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
        r"(?!(?![Tt][0-9]{2})[0-9A-Za-z]|[./-][0-9])")
AMERICAN = r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
# 8-15 digits up to the end of a group; an American phone behind them is a value of its own
PHONE = (rf"(?<![0-9A-Za-z+])(?=[0-9+(])(?:{AMERICAN}"
         rf"|\+[0-9](?:[ .-]?\(?[0-9]\)?){{7}}(?:(?![ .-]{AMERICAN})[ .-]?\(?[0-9]\)?){{0,7}}(?![0-9A-Za-z]))")
FIXED = f"{EMAIL}|(?=[0-9])(?:{IP}|{SSN}|{DATE})"
# 13 or more digits in groups, and the digits of a card as it is usually written: an issuer's first digits, and its groups
RUN = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+"
PLAIN_RUN = r"(?<!\+)" + RUN
ISSUER, USUAL = "^(?:3|4|5[1-5]|6|2[2-7])", "^(?:1[3-9]|4,4,4,4|4,6,[45])$"
CARD_GROUPS = 19
ESCAPE, ESCAPED, MARK, CUT = "\ue000", "\ue000\ue001", "\ue000\ue002", "\ue000\ue003"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def feistel(symbols: Column, radices: Column, key: Column) -> Column:
    """Permuted symbols: a network on two halves of an array with a radix per symbol. A single
    symbol is shifted by a keyed step that is never 0."""
    half = F.ceil(F.size(symbols) / 2).cast("int")
    rest = F.size(symbols) - half

    def shifted(mine, rads, other, said):
        def one(hash_of, x, k):
            h = F.conv(F.substring(F.sha2(F.concat_ws("#", hash_of, k.cast("string")), 256), 1, 12), 16, 10).cast("bigint")
            r = F.element_at(rads, k + 1)
            return ((x + F.when((F.size(other) == 0) & (F.size(mine) == 1), 1 + h % (r - 1)).otherwise(h % r)) % r).cast("int")
        return let(F.concat_ws("|", said, F.array_join(other.cast("array<string>"), ",")),
                   lambda t: F.transform(mine, lambda x, k: one(t, x, k)))

    state = F.struct(F.slice(symbols, F.lit(1), half).alias("l"), F.slice(symbols, half + 1, rest).alias("r"),
                     F.slice(radices, F.lit(1), half).alias("lr"), F.slice(radices, half + 1, rest).alias("rr"))
    last = F.when(F.size(symbols) == 1, 0).otherwise(ROUNDS - 1)

    def turn(s, i):
        said = F.concat_ws("|", key, i.cast("string"))
        return F.struct(F.when(i % 2 == 0, shifted(s["l"], s["lr"], s["r"], said)).otherwise(s["l"]).alias("l"),
                        F.when(i % 2 == 1, shifted(s["r"], s["rr"], s["l"], said)).otherwise(s["r"]).alias("r"),
                        s["lr"].alias("lr"), s["rr"].alias("rr"))

    return F.aggregate(F.sequence(F.lit(0), last), state, turn, lambda s: F.concat(s["l"], s["r"]))


def _ints(texts: Column) -> Column:
    return texts.try_cast("array<int>")


def _digits(m: Column) -> Column:
    return _ints(F.split(F.regexp_replace(m, "[^0-9]", ""), "(?!$)"))


def _fill(m: Column, is_symbol: str, values: Column) -> Column:
    """``m`` with its characters that match ``is_symbol`` replaced by ``values`` in order."""
    def body(v):
        at = lambda i: F.array_position(v["at"], i + 1)
        return F.array_join(F.transform(v["chars"], lambda c, i: F.when(
            at(i) > 0, F.element_at(v["values"], at(i).cast("int"))).otherwise(c)), "")

    chars = F.split(m, "(?!$)")
    places = let(chars, lambda c: F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: F.element_at(c, i).rlike(is_symbol)))
    return let(F.struct(chars.alias("chars"), places.alias("at"), values.alias("values")), body)


def _luhn(digits: Column) -> Column:
    """Luhn sum of digits whose last one is the check digit."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _card(m: Column, key: Column) -> Column:
    def body(d):
        middle = F.slice(d, F.lit(2), F.size(d) - 2)
        new = F.concat(F.slice(d, 1, 1), feistel(middle, F.transform(middle, lambda x: F.lit(10)), F.concat(key, F.lit("card"))))
        full = let(new, lambda n: F.concat(n, F.array(((10 - _luhn(F.concat(n, F.array(F.lit(0)))) % 10) % 10).cast("int"))))
        return _fill(m, "[0-9]", full.cast("array<string>"))
    return let(_digits(m), body)


def _cards(run: Column, key: Column, usual: bool) -> Column:
    """A run of digit groups with the valid cards in it replaced and marked, from left to right.
    A card takes whole groups: as many as possible, or those of a usual grouping."""
    digits = lambda t: F.translate(t, " -", "")

    def valid(window, n):
        def check(groups):
            number = F.array_join(groups, "")
            ok = F.length(number).between(13, 19)
            if usual:
                shape = F.array_join(F.transform(groups, lambda g: F.length(g).cast("string")), ",")
                ok = ok & shape.rlike(USUAL) & number.rlike(ISSUER)
            return F.when(ok, _luhn(_digits(number)) % 10 == 0).otherwise(False)
        return let(F.slice(window, F.lit(1), n), check)

    def longest(window):
        fit = F.filter(F.sequence(F.lit(1), F.size(window)), lambda n: valid(window, n))
        return F.coalesce(F.array_max(fit), F.lit(0))

    def body(tokens):
        plain = F.transform(tokens, digits)
        sizes = let(plain, lambda g: F.transform(g, lambda _, i: let(F.slice(g, i + 1, F.lit(CARD_GROUPS)), longest)))
        # one letter a group: a where no card starts, else the number of its groups; a card's groups start no other
        codes = F.array_join(F.transform(sizes, lambda n: F.char(n + 97)), "")
        steps = F.regexp_extract_all(codes, F.lit("|".join(
            ["a"] + [f"{chr(97 + n)}[a-t]{{{n - 1}}}" for n in range(1, CARD_GROUPS + 1)])), F.lit(0))
        marks = F.split(F.array_join(F.transform(steps, lambda x: F.when(x == "a", F.lit("-")).otherwise(
            F.concat(F.lit("S"), F.repeat(F.lit("C"), F.length(x) - 1)))), ""), "(?!$)")

        def placed(m):
            def token(t, i):
                ends = (m[i] != "-") & (F.coalesce(F.get(m, i + 1), F.lit("-")) != "C")
                return F.concat(F.when(m[i] == "S", F.concat(F.regexp_extract(t, "^[ -]?", 0), F.lit(MARK), digits(t))).otherwise(t),
                                F.when(ends, MARK).otherwise(""))
            return F.array_join(F.transform(tokens, token), "")
        return let(marks, placed)

    marked = let(F.split(run, "(?<=[0-9])(?=[ -])"), body)
    return F.array_join(F.transform(F.split(marked, MARK), lambda p, i: F.when(i % 2 == 1, _card(p, key)).otherwise(p)), MARK)


def _phone(m: Column, key: Column) -> Column:
    american = (m.rlike(r"^(?:\+?1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}$")
                & F.length(F.regexp_replace(m, "[^0-9]", "")).isin(10, 11))

    def body(v):
        d, lead = v["d"], v["lead"]
        code = lambda k: v["us"] & k.isin(0, 3)
        low = F.transform(v["rest"], lambda x, k: F.when(code(k), x - 2).otherwise(x))
        radices = F.transform(v["rest"], lambda x, k: F.when(code(k), 8).otherwise(10))
        new = let(F.struct(low.alias("low"), radices.alias("radices")),
                  lambda w: feistel(w["low"], w["radices"], F.concat(key, F.lit("phone"))))
        out = F.concat(F.slice(d, F.lit(1), lead), F.transform(new, lambda x, k: F.when(code(k), x + 2).otherwise(x)))
        return F.when(F.size(d).between(8, 15), _fill(m, "[0-9]", out.cast("array<string>")))

    def start(d):
        n = F.size(d)
        lead = F.when(american, n - 10).otherwise(F.greatest(F.lit(0), F.least(F.lit(3), n - 5)))
        return let(F.struct(d.alias("d"), lead.alias("lead"), american.alias("us")),
                   lambda v: F.struct(v["d"].alias("d"), v["lead"].alias("lead"), v["us"].alias("us"),
                                      F.slice(v["d"], v["lead"] + 1, F.size(v["d"]) - v["lead"]).alias("rest")))
    return let(let(_digits(m), start), body)


def _ip(m: Column, key: Column) -> Column:
    def body(octets):
        new = feistel(octets, F.array(*[F.lit(256)] * 4), F.concat(key, F.lit("ip")))
        return F.when(F.forall(octets, lambda x: x <= 255) & ~m.rlike(r"(^|\.)0[0-9]"),
                      F.array_join(new.cast("array<string>"), "."))
    return let(_ints(F.split(m, r"\.")), body)


def _ssn(m: Column, key: Column) -> Column:
    def body(p):
        right = p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        area = F.when(p[0] > 666, p[0] - 2).otherwise(p[0] - 1)
        new = let(F.array(area, p[1] - 1, p[2] - 1), lambda v: feistel(
            v, F.array(F.lit(898), F.lit(99), F.lit(9999)), F.concat(key, F.lit("ssn"))))
        return F.when(right, let(new, lambda n: F.format_string(
            "%03d-%02d-%04d", F.when(n[0] >= 665, n[0] + 2).otherwise(n[0] + 1), n[1] + 1, n[2] + 1)))
    return let(_ints(F.split(m, "-")), body)


def _date(m: Column, key: Column) -> Column:
    """Day and month keep their places; one written with one digit gets no leading zero."""
    first = F.lit(EPOCH).cast("date")
    iso = m.contains("-")
    day_first = m.contains(".") | (m.contains("/") & (F.substring_index(m, "/", 1).cast("int") > 12))

    def body(p):
        year, one, two = (F.when(iso, p[i]).otherwise(p[j]) for i, j in ((0, 2), (1, 0), (2, 1)))
        day, month = (F.when(day_first, x).otherwise(y) for x, y in ((one, two), (two, one)))
        since = F.datediff(F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")),
                                              F.lit("yyyy-MM-dd")).cast("date"), first)
        return F.struct(since.alias("since"), F.length(one).alias("one"), F.length(two).alias("two"))

    def moved(v):
        since = v["since"]
        last, early = since >= LAST_YEARS, since < FIRST_YEARS + FIRST_RADICES[0] * FIRST_RADICES[1]
        of = lambda a, b, c: F.when(last, a).when(early, b).otherwise(c)
        start = of(F.lit(LAST_YEARS), F.lit(FIRST_YEARS), since - F.pmod(since, F.lit(CYCLE)))
        low, high = (of(*map(F.lit, x)) for x in zip(LAST_RADICES, FIRST_RADICES, CYCLE_RADICES, strict=True))
        place = since - start
        symbols = F.array(F.floor(place / high).cast("int"), (place % high).cast("int"))
        new = let(symbols, lambda s: feistel(s, F.array(low, high), F.concat(key, F.lit("date"))))
        return let(let(new, lambda n: F.date_add(first, (start + n[0] * high + n[1]).cast("int"))), lambda d: written(v, d))

    def written(v, d):
        part = lambda n, size: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), size), F.lit("0"))
        day, month, year = F.dayofmonth(d), F.month(d), F.date_format(d, "yyyy")
        one, two = (part(F.when(day_first, x).otherwise(y), v[k]) for x, y, k in ((day, month, "one"), (month, day, "two")))
        return F.when(iso, F.concat_ws("-", year, one, two)).when(
            m.contains("."), F.concat_ws(".", one, two, year)).otherwise(F.concat_ws("/", one, two, year))

    return let(let(F.split(m, "[./-]"), body), lambda v: F.when(v["since"].isNotNull(), moved(v)))


def _email(m: Column, key: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    number = lambda c: c.rlike("[0-9]")

    def body(v):
        tweak = F.concat(key, F.lit("email"), F.array_join(v["radices"].cast("array<string>"), ""))
        new = feistel(v["values"], v["radices"], tweak)
        letter = lambda x: F.substr(F.lit(ALPHABET), x + 1, F.lit(1))
        back = F.zip_with(v["chars"], new, lambda c, x: F.when(number(c), x.cast("string")).when(
            c.rlike("[A-Z]"), F.upper(letter(x))).otherwise(letter(x)))
        return F.when(F.size(v["chars"]) > 0, F.concat(
            _fill(local, "[A-Za-z0-9]", back), F.substr(m, F.length(local) + 1))).otherwise(m)

    chars = F.filter(F.split(local, "(?!$)"), lambda c: c.rlike("[A-Za-z0-9]"))
    return let(let(chars, lambda cs: F.struct(
        cs.alias("chars"), F.transform(cs, lambda c: F.when(number(c), 10).otherwise(26)).alias("radices"),
        F.transform(cs, lambda c: F.when(number(c), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97)).alias("values"))),
        body)


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of a value of a fixed format; null when it fails its check."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (F.when(value.contains("@"), _email(value, key)).when(whole(IP), _ip(value, key))
            .when(whole(SSN), _ssn(value, key)).otherwise(_date(value, key)))


def _unmarked(text: Column, pattern: str, body) -> Column:
    """``text`` with ``body`` of every match of the pattern in the parts outside of marks."""
    def inside(part):
        pieces = F.split(F.regexp_replace(part, pattern, f"{CUT}$0{CUT}"), CUT)
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, body(p)).otherwise(p)), "")
    return F.array_join(F.transform(F.split(text, MARK), lambda p, i: F.when(
        (i % 2 == 0) & p.rlike("[0-9@]"), inside(p)).otherwise(p)), MARK)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced. Every pass replaces and marks the valid
    values of its formats in what the passes before it left; what fails its check is left to the next."""
    k = F.lit(key)
    marked = lambda value, p: F.coalesce(F.concat(F.lit(MARK), value, F.lit(MARK)), p)
    text = F.col(f"`{text_col}`")
    docs = docs.withColumn(text_col, F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED)))
    for pattern, body in ((FIXED, lambda p: marked(pseudonym(p, k), p)), (PLAIN_RUN, lambda p: _cards(p, k, True)),
                          (PHONE, lambda p: marked(_phone(p, k), p)), (RUN, lambda p: _cards(p, k, False))):
        docs = docs.withColumn(text_col, _unmarked(text, pattern, body))  # a column each: one would nest too deep to resolve
    return docs.withColumn(text_col, F.replace(F.replace(text, F.lit(MARK), F.lit("")), F.lit(ESCAPED), F.lit(ESCAPE)))
