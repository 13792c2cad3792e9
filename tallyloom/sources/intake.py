"""Submission payloads: one JSON body per line or row."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schemas import SUBMISSION

#: JSON's own white space, and the grammar without a reader's usual liberties.
SPACE = " \t\n\r"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowComments": "false", "allowUnquotedFieldNames": "false", "mode": "PERMISSIVE"}


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Columns of SUBMISSION plus ``corrupt``: the raw line where it is no JSON object or list.

    Missing keys are null (cleaning makes them ''), unknown keys are ignored, of a repeated key the last counts. Read as text
    and parsed with a fixed schema, so nothing is inferred and no extra pass is made.
    """
    return parse_submissions(spark.read.text(path), "value")


def json_body(raw: Column) -> Column:
    """The body, an object or a list, as JSON text; null where it is anything else.

    The parser stops where a value ends, whatever follows. So the body is read as the first element of a list whose second one is the
    body's own digest: only a body that is one whole value leaves exactly these two."""
    body = F.btrim(F.coalesce(raw, F.lit("")), F.lit(SPACE))
    mark = F.sha2(body, 256)
    both = F.from_json(F.concat(F.lit("["), body, F.lit(',"'), mark, F.lit('"]')), "array<string>", STRICT)
    whole = (F.size(both) == 2) & (F.try_element_at(both, F.lit(2)) == mark)
    return F.when((body.startswith("{") | body.startswith("[")) & whole, F.try_element_at(both, F.lit(1)))


def text_value(v: Column) -> Column:
    """A JSON value as the server casts it to text: true is 1, false and null are '', whole numbers have no fraction, lists and
    objects are the word ``Array``."""
    kind = F.schema_of_variant(v)
    as_text, as_double = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    number = F.when((F.abs(as_double) < 1e15) & (as_double == F.floor(as_double)), F.floor(as_double).cast("string")).otherwise(as_double.cast("string"))
    return (
        F.when(kind == "STRING", as_text)
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "1").otherwise(""))
        .when(kind == "BIGINT", as_text)
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), number)
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), "Array")
    )


def parse_submissions(df: DataFrame, raw: str) -> DataFrame:
    """As ``read_submissions`` for a text column; other columns are kept."""
    body = json_body(F.col(raw))
    fields = F.from_json(F.when(body.startswith("{"), body), ", ".join(f"{f.name} variant" for f in SUBMISSION), STRICT)
    parsed = df.withColumns({"__whole": body.isNotNull(), "__fields": fields})
    values = {f.name: text_value(F.col("__fields")[f.name]) for f in SUBMISSION}
    return parsed.withColumns(values | {"corrupt": F.when(~F.col("__whole"), F.coalesce(F.col(raw), F.lit("")))}).drop("__whole", "__fields")
