"""Contribution amounts, days covered, payment links and the allocation split."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import browser_trim

#: Shares of each unit of money; the programme gets what is left.
RATES = {"operating": "0.10", "direct": "0.10", "secondary": "0.01"}

#: Amounts shown as equivalents of one unit a day.
EQUIVALENTS = {"day": 1, "week": 7, "month": 30, "year": 365}


def equivalent(a: Column) -> Column:
    """The name of the equivalent that an amount is, or null."""
    out = F.lit(None).cast("string")
    for name, n in EQUIVALENTS.items():
        out = F.when(a == n, name).otherwise(out)
    return out


def valid_amount(a: Column) -> Column:
    """True for a positive finite number; null is invalid."""
    return F.coalesce(~F.isnan(a) & (a > 0) & (a < F.lit(float("inf"))), F.lit(False))


#: The browser's grammar of numbers, after trimming, and the digits of its other bases.
NUMBER = r"^[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"
BASES = {16: r"^0[xX][0-9a-fA-F]+$", 8: r"^0[oO][0-7]+$", 2: r"^0[bB][01]+$"}


def _digits(s: Column, base: int) -> Column:
    """The value of digits of a base, as a double."""
    digit = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    return F.aggregate(F.filter(F.split(F.lower(s), ""), lambda c: c != ""), F.lit(0.0), lambda n, c: n * F.lit(float(base)) + digit(c))


def parse_amount(s: Column) -> Column:
    """Number(x || 0): blank or null is 0, text that is no number of the browser's is NaN."""
    t = browser_trim(F.coalesce(s.cast("string"), F.lit("")))
    out = F.when(t == "", F.lit(0.0)).when(t.rlike(NUMBER), t.try_cast("double"))
    for base, form in BASES.items():
        out = out.when(t.rlike(form), _digits(F.substring(t, 3, 2**31 - 1), base))
    return out.otherwise(F.lit(float("nan")))


def choose_amount(custom: Column, choice: Column) -> Column:
    """A positive custom amount (NaN is none), else the chosen option, else 1."""
    own = custom.cast("double")
    return F.when(F.coalesce(~F.isnan(own) & (own > 0), F.lit(False)), own).otherwise(F.coalesce(choice.cast("double"), F.lit(1.0)))


def cents(a: Column) -> Column:
    """Round to cents with the browser's floor form; invalid amounts become 0. From 2 ** 53 cents on there is nothing to round."""
    hundred = a.cast("double") * F.lit(100.0)
    rounded = F.when(hundred < F.lit(2.0**53), F.floor(hundred + F.lit(0.5)).cast("double")).otherwise(hundred)
    return F.when(valid_amount(a), rounded / F.lit(100.0)).otherwise(F.lit(0.0))


def days_covered(a: Column) -> Column:
    """Whole units of the amount, as long; null from 2 ** 63 on."""
    c = cents(a)
    return F.when(c < F.lit(2.0**63), F.floor(c))


#: Days from 1970-01-01 to 9999-12-31, the last day that Python and most databases can hold.
LAST_DAY = 2_932_896


def next_payment(day: Column, a: Column) -> Column:
    """The day after the days covered, the next day at least; null beyond LAST_DAY."""
    covered = days_covered(a)
    days = F.greatest(covered, F.lit(1))
    return F.when(covered.isNotNull() & (days <= F.lit(LAST_DAY) - F.unix_date(day)), F.date_add(day, days.cast("int")))


def currency(a: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(a, 2))


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, y")


def amount_text(a: Column) -> Column:
    """A number as the browser writes it: 7 and 7.5, never 7.00 or 1.2E7; from 1e21 on with an exponent. Null for NaN."""
    d = a.cast("double")
    exponent = F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0E", "E"), "E", "e+")
    plain = F.regexp_replace(a.try_cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
    return F.when(F.isnan(d), F.lit(None)).when(F.abs(d) < F.lit(1e21), plain).otherwise(exponent)


def _address(front: Column) -> Column:
    """Scheme and host in lower case, without the scheme's own port, ``/`` for no path; null without a scheme."""
    form = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/@]*@)?([^/]*))?(.*)$"
    part = lambda i: F.regexp_extract(front, form, i)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(3)), ":$", "")
    for name, port in (("http", ":80"), ("https", ":443"), ("ftp", ":21")):
        host = F.when((scheme == name) & host.endswith(port), F.substring_index(host, ":", 1)).otherwise(host)
    path = F.when((part(3) != "") & (part(4) == ""), "/").otherwise(part(4))
    authority = F.when(part(3) != "", F.concat(F.lit("//"), part(2), host)).otherwise("")
    return F.when(front.rlike(form), F.concat(scheme, F.lit(":"), authority, path))


def _form(s: Column) -> Column:
    """Decoded and encoded again as form data; a percent sign that begins no code is a character."""
    return F.url_encode(F.url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")))


def payment_url(base: Column, a: Column) -> Column:
    """``base`` with the query parameter ``amount`` set as browsers set it: the first one is replaced in its place, later ones go, without one
    it is appended; the fragment stays last, and the address takes its normal form. Null where base is no absolute URL."""
    bare, mark = F.substring_index(base, "#", 1), F.instr(base, "#")
    fragment = F.when(mark > 0, F.substring(base, mark, F.length(base))).otherwise("")
    at = F.instr(bare, "?")
    query = F.when(at > 0, F.substring(bare, at + 1, F.length(bare))).otherwise("")
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: _form(F.substring_index(p, "=", 1))
    value = lambda p: _form(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(""))
    mine = F.concat(F.lit("amount="), amount_text(a))
    first = F.array_position(F.transform(pairs, name), "amount")
    set_ = F.transform(pairs, lambda p, i: F.when(i + 1 == first, mine).when(name(p) != "amount", F.concat(name(p), F.lit("="), value(p))))
    new = F.concat(F.filter(set_, lambda p: p.isNotNull()), F.when(first == 0, F.array(mine)).otherwise(F.array().cast("array<string>")))
    return F.concat(_address(F.substring_index(bare, "?", 1)), F.lit("?"), F.array_join(new, "&"), fragment)


def live_url(u: Column) -> Column:
    v = F.coalesce(u, F.lit(""))
    return (v != "") & ~F.contains(v, F.lit("PASTE_")) & v.rlike(r"(?i)^https?://")


def money(a: Column) -> Column:
    """As decimal(18,2); null where it does not fit."""
    return a.try_cast("decimal(18,2)")


def too_large(a: Column) -> Column:
    """True for an amount that ``money`` cannot hold (or that is no number); false for null."""
    return a.isNotNull() & money(a).isNull()


def share(a: Column, name: str) -> Column:
    return F.round(money(a) * F.lit(RATES[name]).cast("decimal(3,2)"), 2).cast("decimal(18,2)")


def allocation(a: Column) -> dict[str, Column]:
    """Columns operating, direct, secondary and programme (the remainder), in decimal(18,2), all null where the amount does not fit, which
    ``rejected`` says."""
    out = {k: share(a, k) for k in RATES}
    rest = money(a)
    for c in out.values():
        rest = rest - c
    return out | {"programme": rest.cast("decimal(18,2)"), "rejected": too_large(a)}
