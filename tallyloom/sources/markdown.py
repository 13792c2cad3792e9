"""Markdown records as rows: one file per row, parsed with built-in functions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The labels of an asset record.
ASSET_FIELDS = ("ASSET ID", "TITLE", "ORIGINATOR", "CONTRIBUTORS", "STATUS", "VERSION", "DATE LOCKED", "SOURCE", "TERMS", "OUTPUT", "VALUE EVENT", "VALUE TYPE", "DISTRIBUTION", "SETTLEMENT METHOD", "HISTORY")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), a row a file. Files are records of a few kB; each is one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def field(text: Column, label: str) -> Column:
    """The paragraph below ``LABEL:``, up to the first blank line; '' when absent."""
    below = F.regexp_extract(text, rf"(?ms)^{label}:[ \t]*\n(.*)", 1)
    return F.btrim(F.element_at(F.split(below, r"\n[ \t]*\n", 2), 1), F.lit(" \t\n\r"))


def asset_records(files: DataFrame) -> DataFrame:
    return files.select("path", *[field(F.col("text"), f).alias(f.lower().replace(" ", "_")) for f in ASSET_FIELDS])


def section(text: Column, heading: str) -> Column:
    """The text below ``## heading`` up to the next heading of that level or a rule."""
    return F.trim(F.regexp_extract(text, rf"(?ms)^##[ \t]+{heading}[ \t]*\n(.*?)(?=^##[ \t]|^---|\z)", 1))


def bullets(text: Column) -> Column:
    """Trimmed items of a ``- `` list."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[-*][ \t]+(.+)$"), 1), lambda x: F.btrim(x, F.lit(" \t\r")))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def node_edges(files: DataFrame, node: Column) -> DataFrame:
    """(src, dst) from each file's ``Related Nodes`` list."""
    return files.select(node.alias("src"), F.explode(bullets(section(F.col("text"), "Related Nodes"))).alias("name")).select("src", slug(F.col("name")).alias("dst"))


def glossary(files: DataFrame) -> DataFrame:
    """A row per ``### term`` entry with its eight bold-labelled fields; '' where an entry lacks one."""
    parts = F.split("text", r"(?m)^###[ \t]+")
    entry = F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("entry")
    one = lambda label: F.trim(F.regexp_extract("entry", rf"(?m)^\*\*(?:[^*\n]*?){label}:\*\*[ \t]*(.*)$", 1))
    names = ("Expansion", "Source", "Category", "Meaning", "Usage", "Status", "Related Nodes", "Date Added")
    return files.select("path", entry).select("path", F.trim(F.regexp_extract("entry", r"\A([^\n]*)", 1)).alias("term"), *[one(n).alias(n.lower().replace(" ", "_")) for n in names])


def file_index(files: DataFrame) -> DataFrame:
    """(name, type, tags array, suggested_path, path_parts array) per indexed file: a ``- name`` line with ``  - Field: value`` lines right
    below it. The text is cut at ``- `` lines first, so no pattern repeats a group over it."""
    pieces = F.split("text", r"(?m)^- ")
    piece = files.select(F.explode(F.slice(pieces, F.lit(2), F.size(pieces))).alias("piece")).filter(F.col("piece").rlike(r"\A[^\n]+\n[ \t]+- [^\n]"))
    # the entry ends before the first line that is none of its fields
    entry = piece.select(F.element_at(F.split("piece", r"\n(?![ \t]+- [^\n])", 2), 1).alias("entry"))
    get = lambda p: F.trim(F.regexp_extract("entry", p, 1))
    path = get(r"Suggested path:[ \t]*`?([^`\n]*)`?")
    return entry.select(
        get(r"\A([^\n]+)").alias("name"),
        F.regexp_replace(get(r"Type:[ \t]*([^\n]*)"), r"\.$", "").alias("type"),
        F.split(F.regexp_replace(get(r"Tags:[ \t]*([^\n]*)"), r"\.$", ""), r",\s*").alias("tags"),
        path.alias("suggested_path"),
        F.split(path, "/").alias("path_parts"),
    )


FILE_NAME = r"^(\d{4}-\d{2}-\d{2})_([^_]+)_([^_]+)_([^_]+)_([^_.]+)\.([A-Za-z0-9]+)$"


def file_name_parts(name: Column) -> dict[str, Column]:
    """Parts of ``YYYY-MM-DD_project_category_short-description_status.ext``; '' where it does not fit."""
    keys = ("date", "project", "category", "description", "status", "ext")
    return {k: F.regexp_extract(name, FILE_NAME, i + 1) for i, k in enumerate(keys)}
