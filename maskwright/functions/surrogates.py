"""Substitutes that keep the shape of what they replace.

Each is drawn from a generator seeded with the value alone, so that neither the
order of values nor the partitions matter. The draws need a Mersenne Twister,
which SQL does not have: they run in Arrow batches, over distinct values only.
"""

from __future__ import annotations

import hashlib
import random
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January February March April May June July August September October November December".split()
# Parts of substitutes for companies, cities and domains.
COMPANY_ENDS = ("Group", "Holdings", "Industries", "LLC", "Ltd", "Partners", "PLC", "Systems")
COMPANY_NAMES = "Alder Amber Anchor Apex Aspen Beacon Birch Bridge Cedar Cobalt Compass Copper Crescent Delta Ember Falcon Garnet Harbor Heron Indigo Juniper Keystone Lantern Laurel Linden Maple Meridian Northway Oakfield Orchard Pioneer Quarry Redwood Ridge Sable Sequoia Summit Sterling Thistle Willow".split()
CITIES = "Ashford Brackley Bridgeport Brookfield Burlington Clayton Clifton Dalewood Eastvale Edgewater Fairview Franklin Georgetown Glenwood Greenville Harrisburg Hillcrest Kingston Lakeside Lexington Madison Marlow Milford Newbridge Northfield Oakdale Oxbow Riverside Salem Springdale Stonebridge Sunbury Trenton Wakefield Westbrook Winfield".split()
DOMAIN_ENDS = ("com", "net", "org")
DIGIT = re.compile(r"\d")


def generator(value: str) -> random.Random:
    return random.Random(int(hashlib.sha256(value.encode()).hexdigest()[:12], 16))


def _pick(value: str, slot: str, names) -> str:
    return names[int(hashlib.sha256(f"{value}#{slot}".encode()).hexdigest()[:12], 16) % len(names)]


def _redrawn(value: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in value)


def phone(value: str) -> str:
    """Other digits in the same punctuation; spellings of one number agree, and a country code stays."""
    old = "".join(c for c in value if c.isdigit())
    draw, kept = generator(old), 2 * (len(old) >= 11)
    return _redrawn(value, old[:kept] + "".join(str(draw.randint(0, 9)) for _ in old[kept:]))


def is_postal_code(value: str) -> bool:
    return len(value.replace(" ", "")) == 6 == sum(c.isdigit() for c in value)


def postal_code(value: str) -> str:
    draw = generator(value)
    count = sum(c.isdigit() for c in value)
    return _redrawn(value, "".join(str(draw.randint(int(k == 0), 9)) for k in range(count)))


def birth_date(value: str) -> str:
    """Another date in the same format: numbers of the same width, or the month's name on the same side."""
    draw = generator(value)
    day, month, year = draw.randint(1, 28), draw.randint(1, 12), draw.randint(1950, 2000)
    if shape := re.match(r"(\d{1,2})([/.-])(\d{1,2})\2(\d{2,4})$", value.strip()):
        a, mark, b, y = shape.groups()
        return mark.join((str(day).zfill(len(a)), str(month).zfill(len(b)), str(year) if len(y) > 2 else f"{year % 100:02}"))
    month_first = re.search("[A-Za-z]{3}", value.strip()[:3])
    return f"{MONTHS[month - 1]} {day}, {year}" if month_first else f"{day} {MONTHS[month - 1]} {year}"


def _mark(value: str, default: str) -> str:
    return next((c for c in value if not c.isdigit()), default)


def ssn(value: str) -> str:
    draw, mark = generator(value), _mark(value, "-")
    return mark.join(f"{draw.randint(1, top):0{width}}" for top, width in ((665, 3), (99, 2), (9999, 4)))


def check_digit(digits: str) -> int:
    """The digit that makes a number pass the Luhn test."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[::-2])
    return -(doubled + sum(map(int, digits[-2::-2]))) % 10


def card(value: str) -> str:
    """Sixteen digits from 4 on that pass the Luhn test, in fours if the original has a mark."""
    draw = generator(value)
    drawn = [str(draw.randint(0, 9)) for _ in range(15)]
    body = "4" + "".join(drawn[1:])
    whole = body + str(check_digit(body))
    return _mark(value, "").join(whole[k : k + 4] for k in range(0, 16, 4))


def ip(value: str) -> str:
    draw = generator(value)
    return ".".join([str(draw.randint(1, 254)) for _ in range(4)])


def website(value: str) -> str:
    """The same scheme and www. with another domain, without a path."""
    scheme = value[: value.index("//") + 2] if "//" in value else ""
    www = "www." if re.match(r"(?:.*?//)?www\.", value, re.IGNORECASE) and (value.lower().startswith("www.") or "//www." in value.lower()) else ""
    return f"{scheme}{www}{_pick(value, 'domain', COMPANY_NAMES).lower()}.{_pick(value, 'end', DOMAIN_ENDS)}"


def cased(original: str, made: str) -> str:
    return made.upper() if original.isupper() else made.lower() if original.islower() else made


def substitute(label: str, value: str) -> str:
    """The substitute of a value with a label; PERSON and EMAIL come from identities instead."""
    simple = {"PHONE": phone, "DATE_OF_BIRTH": birth_date, "SSN": ssn, "CREDIT_CARD": card, "IP_ADDRESS": ip, "URL": website}
    if label in simple:
        return simple[label](value)
    if label == "ORGANIZATION":
        return cased(value, f"{_pick(value, 'company', COMPANY_NAMES)} {_pick(value, 'end', COMPANY_ENDS)}")
    if label == "LOCATION":
        return postal_code(value) if is_postal_code(value) else cased(value, _pick(value, "city", CITIES))
    return f"[{label}]"


def substitutes(label: Column, value: Column) -> Column:
    """Arrow batches of ``substitute``."""

    @F.pandas_udf("string")
    def of(labels: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else substitute(k, v) for k, v in zip(labels, values, strict=True)], dtype=object)

    return of(label, value)
