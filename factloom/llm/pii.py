"""Format-preserving pseudonyms by keyed Feistel permutations.

Payment card numbers (Luhn-checked), IBANs (their check digits), US social
security numbers (their ranges), phone numbers (8 to 15 digits), IPv4 addresses,
calendar dates, the local parts of e-mail addresses and hexadecimal tokens of 32
digits or more are each permuted within their format under a secret key, so that the same value gets the same pseudonym in every document, with no table of
values to keep or to join.

Only built-in SQL expressions are used: each text is split around its matches,
each match is rewritten where it stands, and the parts are joined again.  There
is no shuffle.

* Characters (digits, letters of either case, hexadecimal digits) go through a
  Feistel network over the two halves of the value: one half is shifted
  position by position, each within its own character class, by a keyed hash of
  the other.  Everything else (blanks, brackets, dashes) stays.
* The check digits of cards and IBANs are computed anew, so pseudonyms are valid.
* An IPv4 address is a pair of 16-bit numbers, a social security number one of
  898 areas and one of 99 x 9999 numbers, a date between 1900 and 2099 a day number
  in 319 x 229; they go through a Feistel network on that product.
* Days that fall outside the dates are permuted again until they fall inside.  So
  are those of dates written month first, until they cannot be read day first,
  which keeps the two readings apart.

Digits in groups between single blanks or dashes may hold a card beside other
numbers (an expiry date, a short number).  Cards in the groups they are printed
in, or in one group, are looked for first; failing that, the longest run of
groups of 13 to 19 digits is tried as a whole.

Values that fail validation (a Luhn failure, an octet over 255, 31 February)
are left as they are.  Letters of e-mail names move within Latin, Greek or Cyrillic;
those of other scripts stay.  Defined cases: null text stays null with zero
counts, all other columns and repeated rows pass through untouched; the counts
are named ``found``, with as many underscores as make the name free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Alternatives in order; the first that matches at a place is taken.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
TOKEN = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"
SSN = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}(?![./-][0-9])){2,7}+(?: ?[A-Z0-9]{1,3}(?![A-Za-z0-9]|[./-][0-9]))?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])"
#: Groups of digits that may hold cards, up to a value of another kind; ``pieces`` finds the cards.
CARD = rf"(?<![0-9A-Za-z+])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{EMAIL}|{TOKEN}|{IPV4}|{DATE}|{SSN})[0-9]++(?![A-Za-z]))*+(?![0-9A-Za-z])"
#: Digits of a card's groups, as cards are printed.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
#: Every match holds one of these.
HINT = r"[0-9]{2}|@|[0-9]\.[0-9]|[0-9a-fA-F]{32}"
PATTERN = "|".join((EMAIL, TOKEN, IPV4, DATE, SSN, PHONE, IBAN, CARD))

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX_LOWER = "0123456789abcdef"
#: Letters beyond ASCII, by code point: Latin-1, Greek and Cyrillic, each in both cases.
BEYOND = tuple("".join(map(chr, (c for c in range(a, b) if chr(c).isalpha()))) for a, b in ((0xE0, 0x100), (0xC0, 0xDF), (0x3B1, 0x3CA), (0x391, 0x3AA), (0x430, 0x450), (0x410, 0x430)))
DAYS = 73_049  # 1900-01-01 to 2099-12-31
DAYS_HIGH, DAYS_LOW = 319, 229
#: Areas 001 to 899 without 666, and numbers of groups 01 to 99 by serials 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999
#: Times a day is permuted at most until it falls inside; one in 10^26 needs more and stays.
WALK = 64


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _keyed(key: str, kind: str, round_: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), value.cast("string")).cast("binary"), 512)


def _shifted(half: Column, stream: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved within its alphabet by two digits of the stream."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in reversed(alphabets):
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substring(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), move), "")


def permute_characters(value: Column, kind: str, alphabets: tuple[str, ...], key: str) -> Column:
    """Feistel network over the two halves of a string; a permutation of its format."""
    cut = (F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("left"), F.substring(value, cut + 1, F.length(value)).alias("right"))

    def turn(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        half = F.when(even, state["left"]).otherwise(state["right"])
        stream = _keyed(key, kind, i, F.when(even, state["right"]).otherwise(state["left"]))
        return _let(_let(stream, lambda x: _shifted(half, x, alphabets)), lambda moved: _pair(even, state, moved))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["left"], s["right"]))


def _pair(even: Column, state: Column, moved: Column) -> Column:
    return F.struct(F.when(even, moved).otherwise(state["left"]).alias("left"), F.when(even, state["right"]).otherwise(moved).alias("right"))


def permute_pair(high: Column, low: Column, n_high: int, n_low: int, kind: str, key: str) -> Column:
    """Feistel network by modular addition on n_high x n_low; a permutation of the product."""

    def turn(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, state["low"]).otherwise(state["high"])
        by = F.conv(F.substring(_keyed(key, kind, i, other), F.lit(1), F.lit(12)), 16, 10).cast("long")
        return F.struct(F.when(even, (state["high"] + by) % n_high).otherwise(state["high"]).alias("high"), F.when(even, state["low"]).otherwise((state["low"] + by) % n_low).alias("low"))

    start = F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted once."""
    return _let(digits, _luhn_sum)


def _luhn_sum(digits: Column) -> Column:
    n = F.length(digits)
    figures = F.filter(F.split(digits, ""), lambda c: c != "")

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when((n - 1 - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(figures, part), F.lit(0), lambda a, b: a + b)


def _refill(shape: Column, digits: Column) -> Column:
    """Put a run of digits into the digit places of ``shape``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def card(value: Column, key: str) -> Column:
    """All digits but the last, which is the new check digit."""

    def checked(body: Column) -> Column:
        check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
        return F.concat(body, check.cast("string"))

    digits = F.regexp_replace(value, "[^0-9]", "")
    body = _let(digits, lambda d: permute_characters(F.substring(d, F.lit(1), F.length(d) - 1), "card", (DIGITS,), key))
    return _let(_let(body, checked), lambda d: _refill(value, d))


def phone(value: Column, key: str) -> Column:
    """All digits but those of the country code."""
    digits = F.regexp_replace(value, r"^\+[0-9]{1,3}|[^0-9]", "")
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3})?", 0)
    new = _let(digits, lambda d: permute_characters(d, "phone", (DIGITS,), key))
    return _let(code, lambda c: F.concat(c, _let(new, lambda d: _refill(F.substring(value, F.length(c) + 1, F.length(value)), d))))


def ipv4(value: Column, key: str) -> Column:
    octet = lambda k: F.split(value, r"\.")[k].cast("long")
    out = permute_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, "ipv4", key)
    return F.transform(F.array(out), lambda p: F.concat_ws(".", *(x.cast("string") for h in ("high", "low") for x in ((p[h] / 256).cast("long"), p[h] % 256))))[0]


def parsed_date(value: Column) -> Column:
    """The day a date names (year first, else day before month where that exists); null if none."""
    order = F.regexp_replace(value, "[./]", "-")
    year_first = value.rlike(r"^[0-9]{4}")
    swap = F.concat_ws("-", F.substring(order, F.lit(7), F.lit(4)), F.substring(order, F.lit(4), F.lit(2)), F.substring(order, F.lit(1), F.lit(2)))
    other = F.concat_ws("-", F.substring(order, F.lit(7), F.lit(4)), F.substring(order, F.lit(1), F.lit(2)), F.substring(order, F.lit(4), F.lit(2)))
    day = F.when(year_first, order.try_cast("date")).otherwise(F.coalesce(swap.try_cast("date"), other.try_cast("date")))
    return F.when(day.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), day)


def day_name(number: Column) -> Column:
    return F.date_add(F.lit("1900-01-01").cast("date"), number.cast("int"))


def permute_day(number: Column, month_first: Column, key: str) -> Column:
    """Cycle-walking permutation of the days, or of those past the twelfth of a month."""
    start = F.struct(number.cast("long").alias("day"), F.lit(False).alias("done"))

    def step(state: Column, i: Column) -> Column:
        def taken(p: Column) -> Column:
            day = p["high"] * DAYS_LOW + p["low"]
            inside = (day < DAYS) & (~month_first | (F.dayofmonth(day_name(day)) > 12))
            return F.struct(day.alias("day"), inside.alias("done"))

        moved = permute_pair((state["day"] / DAYS_LOW).cast("long"), state["day"] % DAYS_LOW, DAYS_HIGH, DAYS_LOW, "date", key)
        return F.when(state["done"], state).otherwise(_let(moved, taken))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda s: F.when(s["done"], s["day"]).otherwise(number))


def date(value: Column, key: str) -> Column:
    order = F.regexp_replace(value, "[./]", "-")
    year_first = value.rlike(r"^[0-9]{4}")
    month_first = ~year_first & F.concat_ws("-", F.substring(order, F.lit(7), F.lit(4)), F.substring(order, F.lit(4), F.lit(2)), F.substring(order, F.lit(1), F.lit(2))).try_cast("date").isNull()
    mark = F.regexp_extract(value, "[./-]", 0)

    def written(day: Column) -> Column:
        year, month, dom = (F.date_format(day, x) for x in ("yyyy", "MM", "dd"))
        return F.when(year_first, F.concat(year, mark, month, mark, dom)).when(month_first, F.concat(month, mark, dom, mark, year)).otherwise(F.concat(dom, mark, month, mark, year))

    number = F.datediff(parsed_date(value), F.lit("1900-01-01").cast("date"))
    return _let(_let(number, lambda n: day_name(permute_day(n, month_first, key))), written)


def ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.split(value, "-")[k].cast("long") for k in range(3))
    out = permute_pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * SERIALS + serial - 1, AREAS, GROUPS * SERIALS, "ssn", key)
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return _let(out, lambda p: F.concat_ws("-", pad(p["high"] + 1 + F.when(p["high"] >= 665, 1).otherwise(0), 3), pad(F.floor(p["low"] / SERIALS) + 1, 2), pad(p["low"] % SERIALS + 1, 4)))


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits: 98 less the number of account, country and 00 modulo 97."""
    figures = F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        # letters count from A = 10
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.lpad((98 - F.aggregate(figures, F.lit(0), step)).cast("string"), 2, "0")


def iban_ok(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (iban_check(F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))) == F.substring(plain, 3, 2))


def iban(value: Column, key: str) -> Column:
    """Country and blanks stay; the account is permuted and the check digits follow."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    account = _let(plain, lambda x: permute_characters(F.substring(x, F.lit(5), F.length(x)), "iban", (UPPER, DIGITS), key))
    new = _let(account, lambda a: F.concat(F.substring(plain, 1, 2), iban_check(F.substring(plain, 1, 2), a), a))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column, filled: Column) -> Column:
        return F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(filled, s["at"], F.lit(1)))).alias("out"), (s["at"] + F.when(c == " ", 0).otherwise(1)).alias("at"))

    return _let(new, lambda n: F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), start, lambda s, c: step(s, c, n), lambda s: s["out"]))


def kind_of(value: Column) -> Column:
    """The validated kind of a match; 'none' if it fails validation."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    octets = F.split(value, r"\.")
    full = lambda p: value.rlike(f"^(?:{p})$")
    ipv4_ok = F.forall(octets, lambda o: (F.length(o) <= 3) & (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))
    return (
        F.when(value.contains("@"), "email")
        .when(full("[0-9a-f]{32,}|[0-9A-F]{32,}"), "token")
        .when(full(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.when(ipv4_ok, "ipv4").otherwise("none"))
        .when(full(r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[-./][0-9]{2}[-./][0-9]{4}"), F.when(parsed_date(value).isNotNull(), "date").otherwise("none"))
        .when(full("[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.when(value.rlike("^(?!000|666|9)...-(?!00)..-(?!0000)"), "ssn").otherwise("none"))
        .when(full("[A-Z]{2}[0-9]{2}.*"), F.when(iban_ok(value), "iban").otherwise("none"))
        .when(full(r"[+(].*"), F.when(F.length(digits).between(8, 15), "phone").otherwise("none"))
        .when((luhn_sum(digits) % 10 == 0) & (F.length(digits).between(13, 19)), "card")
        .otherwise("none")
    )


def pseudonym(kind: Column, value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    return (
        F.when(kind == "email", F.concat(permute_characters(local, "email", (LOWER, UPPER, DIGITS, *BEYOND), key), F.substring(value, F.length(local) + 1, F.length(value))))
        .when(kind == "token", permute_characters(F.lower(value), "token", (HEX_LOWER,), key))
        .when(kind == "ipv4", ipv4(value, key))
        .when(kind == "date", date(value, key))
        .when(kind == "phone", phone(value, key))
        .when(kind == "ssn", ssn(value, key))
        .when(kind == "iban", iban(value, key))
        .when(kind == "card", card(value, key))
        .otherwise(value)
    )


def pieces(value: Column) -> Column:
    """The kind and text of the parts of a match, in order; only groups of digits have several."""
    return _let(kind_of(value), lambda kind: _pieces(value, kind))


def _pieces(value: Column, kind: Column) -> Column:
    # dates and tokens are of digits and dashes too
    run = value.rlike(r"^[0-9]+(?:[ -][0-9]+)*$") & (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 13) & kind.isin("card", "none")
    # what has the form of an IBAN and is none may hold a card after its first letters
    after = value.rlike(r"^[A-Z]{2}[0-9]{2} [0-9]+(?: [0-9]+)*$") & (kind == "none")
    head = F.when(after, F.array(F.struct(F.lit("none").alias("kind"), F.substring(value, 1, 5).alias("value")))).otherwise(F.expr("cast(array() as array<struct<kind:string,value:string>>)"))
    groups = _let(F.when(after, F.substring(value, F.lit(6), F.length(value))).otherwise(value), lambda x: _let(F.split(x, "[ -]"), lambda g: _card_pieces(x, g)))
    return F.when(run | after, F.concat(head, groups)).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def _card_pieces(value: Column, groups: Column) -> Column:
    """Cards of a run of digit groups, from left to right, and what stands between them."""
    digits = lambda i, n: F.array_join(F.slice(groups, i + 1, n), "")
    valid = lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
    index = F.sequence(F.lit(0), F.size(groups) - 1)
    # where each group starts in the value, and how many groups from it on have at most 19 digits
    length = lambda i, n: F.aggregate(F.slice(groups, i + 1, n), F.lit(0), lambda a, g: a + F.length(g))

    def own(i: Column) -> Column:
        """Groups of the printed card that starts here; 0 if none."""
        out = F.when((F.length(groups[i]) >= 13) & valid(groups[i]), 1)
        for shape in CARD_GROUPS:
            fits = i + len(shape) <= F.size(groups)
            for k, n in enumerate(shape):
                fits = fits & (F.length(F.get(groups, i + k)) == n)
            out = out.when(fits & valid(digits(i, F.lit(len(shape)))), len(shape))
        return out.otherwise(0)

    def reach(i: Column) -> Column:
        return F.aggregate(F.slice(groups, i + 1, 19), F.struct(F.lit(0).alias("n"), F.lit(0).alias("digits")), lambda a, g: F.struct(F.when((a["digits"] <= 19) & (a["digits"] + F.length(g) <= 19), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["digits"] + F.length(g)).alias("digits")), lambda a: a["n"])

    def found(owned: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.expr("cast(array() as array<struct<first:int,n:int>>)").alias("cards"))

        def step(s: Column, i: Column) -> Column:
            def taken(far: Column) -> Column:
                long = (i == s["free"]) & (far > 0) & (length(i, far) >= 13)
                whole = long & (F.aggregate(F.slice(owned, i + 1, F.greatest(far, F.lit(1))), F.lit(0), lambda a, x: a + x) == 0) & valid(digits(i, F.greatest(far, F.lit(1))))
                n = F.when(owned[i] > 0, owned[i]).when(whole, far).otherwise(0)
                free = F.when(n > 0, i + n).when(long, i + far).when(i == s["free"], i + 1).otherwise(s["free"])
                return F.struct(F.when(n > 0, i + n).otherwise(i + 1).alias("at"), free.alias("free"), F.when(n > 0, F.concat(s["cards"], F.array(F.struct(i.alias("first"), n.alias("n"))))).otherwise(s["cards"]).alias("cards"))

            return F.when(i < s["at"], s).otherwise(_let(reach(i), taken))

        return F.aggregate(index, start, step, lambda s: s["cards"])

    def cut(cards: Column) -> Column:
        """Characters before group i: its digits and a separator for each group before."""
        before = lambda i: length(F.lit(0), i) + i
        spans = F.transform(cards, lambda c: F.struct(before(c["first"]).alias("start"), (before(c["first"] + c["n"]) - 1).alias("stop")))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<kind:string,value:string>>)").alias("out"))
        piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.substring(value, a + 1, b - a).alias("value"))
        return F.aggregate(spans, start, lambda s, c: F.struct(c["stop"].alias("at"), F.concat(s["out"], F.array(piece("none", s["at"], c["start"]), piece("card", c["start"], c["stop"]))).alias("out")), lambda s: F.concat(s["out"], F.array(piece("none", s["at"], F.length(value)))))

    return _let(_let(F.transform(index, own), found), cut)


KINDS = ("card", "phone", "ipv4", "date", "email", "token", "ssn", "iban")


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` rewritten under the secret ``key``; a struct column ``found`` counts values by kind.

    Texts without any match are passed on as they are, so the costly
    expressions run only where something was found.
    """
    text = F.col(column)
    # columns of their own, so that no expression is evaluated twice
    found, values, new = (f"__factloom_{x}" for x in ("found", "values", "new"))
    rows = docs.withColumn(found, F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn(values, F.when(F.size(found) > 0, F.transform(found, pieces)))

    def rewritten(v: Column) -> Column:
        # upper-case tokens are permuted as the lower-case value and keep their case
        out = F.transform(F.array(pseudonym(v["kind"], v["value"], key)), lambda p: F.when((v["kind"] == "token") & (v["value"] == F.upper(v["value"])), F.upper(p)).otherwise(p))
        return out[0]

    rows = rows.withColumn(new, F.when(F.col(values).isNotNull(), F.transform(values, lambda parts: F.array_join(F.transform(parts, rewritten), ""))))
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), F.col(new), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    count = lambda kind: F.when(F.col(values).isNotNull(), F.size(F.filter(F.flatten(values), lambda v: v["kind"] == kind))).otherwise(0).cast("long")
    counts = F.struct(*(count(kind).alias(kind) for kind in KINDS))
    name = "found"
    while name in docs.columns:
        name += "_"
    return rows.withColumns({column: F.when(F.col(new).isNotNull(), joined).otherwise(text), name: counts}).drop(found, values, new)
