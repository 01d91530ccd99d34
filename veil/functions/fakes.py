"""Synthetic values by type, each a pure function of (seed, domain, value).

Types without a generator of their own come out as ``anon_`` and digits.
Check-digit types carry right check digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions.keyed import below, choice, digits, hexes, let, number, pick, text

FIRST = ("Ada", "Ben", "Clara", "David", "Elena", "Felix", "Greta", "Hugo", "Iris", "Jonas", "Karin", "Leo", "Mara", "Nils", "Olga", "Paul", "Quinn", "Rosa", "Simon", "Tara", "Uwe", "Vera", "Willem", "Xenia", "Yann", "Zoe")
LAST = ("Abel", "Baker", "Costa", "Duran", "Engel", "Fischer", "Garcia", "Hansen", "Ivanov", "Jensen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Peters", "Quist", "Rossi", "Santos", "Torres", "Unger", "Vidal", "Weber", "Young", "Ziegler")
WORDS = ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "harbor", "iris", "juniper", "kestrel", "lagoon", "meadow", "north", "orchid", "pine", "quartz", "river", "summit", "tundra", "umber", "valley", "willow", "yarrow", "zephyr")
TLDS = ("com", "org", "net", "io", "info", "biz")
FREE_DOMAINS = ("example.com", "example.org", "example.net", "mail.example")
JOBS = ("Accountant", "Analyst", "Architect", "Baker", "Carpenter", "Chemist", "Designer", "Editor", "Electrician", "Engineer", "Gardener", "Librarian", "Nurse", "Pilot", "Plumber", "Teacher", "Translator", "Welder")
AGENTS = ("Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)", "Mozilla/5.0 (Android 14; Mobile)")
STREETS = ("Ash Street", "Bridge Road", "Castle Lane", "Dock Street", "Elm Avenue", "Forest Way", "Garden Road", "Hill Street", "Island Road", "Kings Road", "Lake Avenue", "Mill Lane")
CITIES = ("Alden", "Brookfield", "Carver", "Dunmore", "Easton", "Fairview", "Glenwood", "Harlow", "Irvington", "Kingsley", "Linden", "Marlow")
COUNTRIES = ("Austria", "Belgium", "Brazil", "Canada", "Chile", "Denmark", "Finland", "France", "Ireland", "Japan", "Kenya", "Norway", "Portugal", "Spain", "Sweden")
COMPANIES = ("Group", "Holdings", "Industries", "Labs", "Partners", "Systems", "Works")
#: Vehicle numbers have no I, O or Q; values and weights of their check digit.
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
VIN_VALUES = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ0123456789", (1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)

Fake = Callable[[object, str, Column], Column]


def _check_digit(body: Column, n: int, weigh: Callable[[Column, Column], Column]) -> Column:
    """10 less the weighted sum of n digits, modulo 10; weigh gets a digit and its place from the right (0 first)."""
    part = lambda i: weigh(F.substring(body, F.lit(n) - i, F.lit(1)).cast("int"), i)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), part), F.lit(0), lambda t, x: t + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def luhn_digit(body: Column, n: int) -> Column:
    """The digit that makes n digits and it pass the Luhn test."""
    return _check_digit(body, n, lambda d, i: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2))


def retail_digit(body: Column, n: int) -> Column:
    """The modulo-10 check digit with weights 3 and 1 from the right."""
    return _check_digit(body, n, lambda d, i: F.when(i % 2 == 0, d * 3).otherwise(d))


def _other(made: Column, v: Column, options: tuple[str, ...], index: Column) -> Column:
    """made, or the next of few options where it is the value itself."""
    return F.when(made == text(v), pick(options, index + 1)).otherwise(made)


def _word(options: tuple[str, ...], salt: int) -> Fake:
    """One of few words, never the value itself."""

    def make(s: object, d: str, v: Column) -> Column:
        index = number(s, d, v, salt)
        return _other(pick(options, index), v, options, index)

    return make


def _first(s: object, d: str, v: Column) -> Column:
    return choice(s, d, v, FIRST, 1)


def _last(s: object, d: str, v: Column) -> Column:
    return choice(s, d, v, LAST, 2)


def _name(s: object, d: str, v: Column) -> Column:
    whole = F.concat(_first(s, d, v), F.lit(" "), _last(s, d, v))
    return F.when(whole == text(v), F.concat(_first(s, d, v), F.lit(" "), pick(LAST, number(s, d, v, 2) + 1))).otherwise(whole)


def _username(s: object, d: str, v: Column) -> Column:
    return F.concat(F.lower(_first(s, d, v)), F.lit("_"), digits(s, d, v, 6, 3))


def _domain(s: object, d: str, v: Column) -> Column:
    return F.concat(choice(s, d, v, WORDS, 4), F.lit("-"), choice(s, d, v, WORDS, 5), F.lit("."), choice(s, d, v, TLDS, 6))


def _email(s: object, d: str, v: Column) -> Column:
    return F.concat(F.lower(_first(s, d, v)), F.lit("."), F.lower(_last(s, d, v)), digits(s, d, v, 6, 3), F.lit("@"), choice(s, d, v, FREE_DOMAINS, 7))


def _phone(s: object, d: str, v: Column) -> Column:
    return F.concat(F.lit("("), (below(s, d, v, 800, 8) + 200).cast("string"), F.lit(") 555-"), digits(s, d, v, 4, 9))


def _uuid(s: object, d: str, v: Column) -> Column:
    return let(hexes(s, d, v, 32, 10), _uuid_of)


def _uuid_of(h: Column) -> Column:
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _ipv4(s: object, d: str, v: Column) -> Column:
    return F.concat_ws(".", F.lit("10"), *(below(s, d, v, 256, 11 + i).cast("string") for i in range(3)))


def _ipv6(s: object, d: str, v: Column) -> Column:
    h = hexes(s, d, v, 24, 14)
    return F.concat_ws(":", F.lit("2001"), F.lit("0db8"), *(F.substring(h, 1 + 4 * i, 4) for i in range(6)))


def _mac(s: object, d: str, v: Column) -> Column:
    h = hexes(s, d, v, 10, 15)
    return F.concat_ws(":", F.lit("02"), *(F.substring(h, 1 + 2 * i, 2) for i in range(5)))


def _vin(s: object, d: str, v: Column) -> Column:
    places = [F.substring(F.lit(VIN_LETTERS), below(s, d, v, len(VIN_LETTERS), 20 + i).cast("int") + F.lit(1), F.lit(1)) for i in range(16)]
    codes = F.create_map(*(F.lit(x) for pair in VIN_VALUES.items() for x in pair))
    weights = F.array(*(F.lit(w) for i, w in enumerate(VIN_WEIGHTS) if i != 8))

    def whole(letters: Column) -> Column:
        total = F.aggregate(F.zip_with(letters, weights, lambda c, w: F.element_at(codes, c) * w), F.lit(0), lambda t, x: t + x) % 11
        check = F.when(total == 10, F.lit("X")).otherwise(total.cast("string"))
        return F.concat(F.array_join(F.slice(letters, 1, 8), ""), check, F.array_join(F.slice(letters, 9, 8), ""))

    return let(F.array(*places), whole)


def _checked(size: int, start: str, check: Callable[[Column, int], Column], salt: int) -> Fake:
    def make(s: object, d: str, v: Column) -> Column:
        body = F.concat(F.lit(start), digits(s, d, v, size - len(start), salt)) if start else digits(s, d, v, size, salt)
        return let(body, lambda b: F.concat(b, check(b, size)))

    return make


def _ssn(s: object, d: str, v: Column) -> Column:
    area = below(s, d, v, 898, 50) + 1
    area = F.when(area >= 666, area + 1).otherwise(area)
    group, serial = below(s, d, v, 99, 51) + 1, below(s, d, v, 9999, 52) + 1
    return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0"))


def _card(s: object, d: str, v: Column) -> Column:
    whole = _checked(15, "4", luhn_digit, 53)(s, d, v)
    return let(whole, lambda w: F.concat_ws("-", *(F.substring(w, 1 + 4 * i, 4) for i in range(4))))


def _birth(s: object, d: str, v: Column) -> Column:
    return F.date_add(F.lit("1940-01-01").cast("date"), below(s, d, v, 23_000, 54).cast("int")).cast("string")


GENERATORS: dict[str, Fake] = {
    "name": _name,
    "full_name": _name,
    "first_name": _word(FIRST, 1),
    "last_name": _word(LAST, 2),
    "email": _email,
    "phone": _phone,
    "uuid": _uuid,
    "ipv4": _ipv4,
    "ipv6": _ipv6,
    "hostname": lambda s, d, v: F.concat(F.lit("host-"), digits(s, d, v, 4, 16), F.lit("."), _domain(s, d, v)),
    "domain": _domain,
    "url": lambda s, d, v: F.concat(F.lit("https://"), _domain(s, d, v), F.lit("/"), choice(s, d, v, WORDS, 17)),
    "username": _username,
    "password": lambda s, d, v: F.concat(choice(s, d, v, WORDS, 18), F.lit("-"), hexes(s, d, v, 10, 19)),
    "user_agent": _word(AGENTS, 40),
    "job_title": _word(JOBS, 41),
    "mac": _mac,
    "vin": _vin,
    "imei": _checked(14, "35", luhn_digit, 42),
    "ean13": _checked(12, "2", retail_digit, 43),
    "isbn13": _checked(12, "978", retail_digit, 44),
    "upca": _checked(11, "", retail_digit, 45),
    "tld": _word(TLDS, 46),
    "ssn": _ssn,
    "credit_card": _card,
    "address": lambda s, d, v: F.concat((below(s, d, v, 999, 47) + 1).cast("string"), F.lit(" "), choice(s, d, v, STREETS, 48)),
    "city": _word(CITIES, 49),
    "country": _word(COUNTRIES, 55),
    "zip": lambda s, d, v: digits(s, d, v, 5, 56),
    "company": lambda s, d, v: F.concat(_last(s, d, v), F.lit(" "), choice(s, d, v, COMPANIES, 57)),
    "ip_address": _ipv4,
    "date_of_birth": _birth,
}


def fake(kind: str | None, seed: object, domain: str, value: Column) -> Column:
    make = GENERATORS.get(kind or "")
    if make is None:
        return F.concat(F.lit("anon_"), (number(seed, domain, value) % 9000 + 1000).cast("string"))
    return make(seed, domain, value)


def register_generator(kind: str, make: Fake) -> None:
    GENERATORS[kind] = make
