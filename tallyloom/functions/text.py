"""Text cleaning, labelled blocks and record bodies as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Byte set of the server-side trim, field limits.
SERVER_TRIM = " \t\n\r\x00\x0B"
#: What browsers trim (white space, line ends and the byte order mark; not U+0085).
BROWSER_TRIM = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
LIMITS = {"title": 120, "email": 255, "source": 120, "description": 3000}


def server_trim(s: Column) -> Column:
    """Strip space, tab, LF, CR, NUL and VT only; NBSP stays."""
    return F.btrim(s, F.lit(SERVER_TRIM))


def browser_trim(s: Column) -> Column:
    """Strip any Unicode whitespace (and BOM), as browsers do."""
    return F.btrim(s, F.lit(BROWSER_TRIM))


def clean(s: Column, limit: int = 3000) -> Column:
    """Trim, collapse whitespace runs to one space, keep the first ``limit`` characters. Null: ''."""
    return F.substring(F.regexp_replace(server_trim(F.coalesce(s, F.lit(""))), r"(?U)\s+", " "), 1, limit)


def labelled_block(label: str, v: Column) -> Column:
    """``label: value``, or '' when the value is null or blank."""
    t = browser_trim(F.coalesce(v, F.lit("")))
    return F.when(t != "", F.concat(F.lit(f"{label}: "), t)).otherwise("")


def line_or_blank(label: str, v: Column) -> Column:
    """``label: value`` with the label always kept."""
    return F.concat(F.lit(f"{label}: "), F.coalesce(v, F.lit("")))


def record_body(*blocks: Column) -> Column:
    """Non-empty blocks joined by a blank line."""
    return F.concat_ws("\n\n", F.filter(F.array(*blocks), lambda x: x != ""))


def idea_markdown(title: Column, heading: str, sections: list[tuple[str, list[Column]]]) -> Column:
    """A Markdown record: heading, the idea's title (``Untitled idea`` if blank), then the sections, split by rules."""
    t = browser_trim(F.coalesce(title, F.lit("")))
    parts = [F.lit(f"# {heading}"), F.concat(F.lit("## IDEA\n"), F.when(t == "", "Untitled idea").otherwise(t))]
    parts += [F.concat_ws("\n", F.lit(f"## {name}"), *lines) for name, lines in sections]
    return F.concat_ws("\n\n---\n\n", *parts)


def url_component(s: Column) -> Column:
    """Percent-encoding as encodeURIComponent gives it: space is %20 and ``!'()~*`` stay."""
    out = F.url_encode(F.coalesce(s, F.lit("")))
    for a, b in ((r"\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, a, b)
    return out


def mailto(address: str, subject: Column, body: Column) -> Column:
    return F.concat(F.lit(f"mailto:{address}?subject="), url_component(subject), F.lit("&body="), url_component(body))


def search_url(base: str, term: Column, expansion: Column) -> Column:
    return F.concat(F.lit(base), url_component(F.concat_ws(" ", term, expansion)))


def query_url(base: str, **params: Column) -> Column:
    """``base`` with form-encoded query parameters (space is ``+``)."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(F.coalesce(v, F.lit("")))) for k, v in params.items()]
    return F.concat(F.lit(base + ("&" if "?" in base else "?")), F.concat_ws("&", *pairs))


def upper_postal(s: Column) -> Column:
    return F.upper(browser_trim(F.coalesce(s, F.lit(""))))
