"""Intake validation: every row gets a status code; rejects are kept, never dropped."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import LIMITS, browser_trim, clean

_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_QUOTED = r'"(?:[\x01-\x08\x0B\x0C\x0E-!#-\[\]-\x7F]|\\[\x00-\x7F])*"'
_WORD = rf"(?:{_ATOM}|{_QUOTED})"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_LAST = r"[A-Za-z](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = rf"IPv6:(?:(?:{_HEX}:){{7}}{_HEX}|(?=(?:[0-9A-Fa-f]*:){{2,7}}[0-9A-Fa-f]*\])(?:{_HEX}(?::{_HEX})*)?::(?:{_HEX}(?::{_HEX})*)?)"
EMAIL = rf"^{_WORD}(?:\.{_WORD})*@(?:(?:{_LABEL}\.)+{_LAST}|\[(?:{_BYTE}(?:\.{_BYTE}){{3}}|{_IPV6})\])$"
#: Characters of the longest address: a local part of 64, all quoted, and 254 in all otherwise.
LONGEST = 320


def email_ok(s: Column) -> Column:
    """Words, plain or quoted, with dots between them, of up to 64 characters (quotes do not count), and a dotted host whose last
    label begins with a letter, or an IP address in brackets; 254 characters at most. Null is invalid. The pattern sees no more than LONGEST characters."""
    unquoted = lambda x: F.length(F.regexp_replace(x, r'\\(.)|"', "$1"))
    local = F.substring(s, F.lit(1), F.length(s) - F.length(F.substring_index(s, "@", -1)) - 1)
    fits = F.when(F.length(s) <= LONGEST, s.rlike(EMAIL) & (unquoted(local) <= 64) & (unquoted(s) <= 254))
    return F.coalesce(fits, F.lit(False))


def required(*cols: Column) -> Column:
    """All columns are non-null and not ''."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit("")) != "" for c in cols])


#: Fields that each intake form requires.
REQUIRED = {
    "server": ("title", "email", "source"),
    "export_form": ("title", "email", "source", "description"),
    "mail_form": ("originator", "email", "title", "description"),
    "membership": ("username", "email", "postal"),
    "glossary": ("term", "expansion"),
    "glossary_typed": ("term",),
}


def form_complete(df: DataFrame, form: str) -> Column:
    """The form's required fields hold after trimming, with a valid address where one is asked for."""
    fields = REQUIRED[form]
    ok = required(*[browser_trim(df[c]) for c in fields])
    return ok & email_ok(browser_trim(df["email"])) if form in ("mail_form", "membership") else ok


def resolve_source(source: Column, other: Column) -> Column:
    """``Other`` gives way to the trimmed custom text; text typed beside any other option is not used."""
    return F.when(source == "Other", browser_trim(F.coalesce(other, F.lit("")))).otherwise(source)


def custom_entry_visible(source: Column, sent_by: Column) -> Column:
    return F.coalesce(source == "Other", F.lit(False)) | F.coalesce(sent_by == "Other", F.lit(False))


def clean_submission(df: DataFrame) -> DataFrame:
    """Clean and cut the four payload fields; the input's text stays in ``raw_*`` columns."""
    keep = {f"raw_{c}": df[c] for c in LIMITS}
    return df.withColumns(keep | {c: clean(df[c], n) for c, n in LIMITS.items()})


def status_code(df: DataFrame) -> Column:
    """405 for a method other than POST (if the column ``method`` is there), 400 for a bad payload, 200 else."""
    bad = ~required(df["title"], df["email"], df["source"]) | ~email_ok(df["email"])
    out = F.when(bad, 400).otherwise(200)
    if "corrupt" in df.columns:
        out = F.when(df["corrupt"].isNotNull(), 400).otherwise(out)
    return F.when(F.coalesce(df["method"], F.lit("")) != "POST", 405).otherwise(out) if "method" in df.columns else out


def gate(*conditions: Column) -> Column:
    """All conditions hold; null counts as not held."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def checklist(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``n_done`` and ``complete`` over the checklist columns (non-null and not '')."""
    done = [F.when(F.coalesce(df[c].cast("string"), F.lit("")) != "", 1).otherwise(0) for c in cols]
    total = reduce(lambda a, b: a + b, done)
    return df.withColumns({"n_done": total, "complete": total == len(cols)})
