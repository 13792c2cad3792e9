"""Reads over the stored records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import browser_trim
from tallyloom.operators.numbering import with_previous

PUBLIC = ("asset_id", "title", "source", "status", "created_at")


def recent_records(ideas: DataFrame, n: int = 25) -> DataFrame:
    """The newest n ideas without private columns; ties by asset_id descending (TakeOrderedAndProject)."""
    return ideas.select(*PUBLIC).orderBy(F.desc("created_at"), F.desc("asset_id")).limit(n)


def as_response(df: DataFrame, *cols: str) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*(cols or df.columns))).alias("json"))


def current_versions(history: DataFrame, key: str, version_ts: str) -> DataFrame:
    """The latest version per key of an append-only history (max_by: no sort, partial aggregation)."""
    rest = [c for c in history.columns if c != key]
    latest = history.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version_ts, *[c for c in rest if c != version_ts])).alias("__v"))
    return latest.select(key, "__v.*")


def validity(history: DataFrame, key: str, since: str, tiebreak: str) -> DataFrame:
    """Adds ``valid_from`` and ``valid_to`` to every version: to the next one's time, null for the current one. Of versions with one time the
    last by ``tiebreak`` holds; the others' intervals are empty."""
    timed = with_previous(history, [key], [F.desc(since), F.desc(tiebreak)], F.col(since), "valid_to")
    return timed.withColumn("valid_from", F.col(since)).select(*history.columns, "valid_from", "valid_to")


def as_of(refs: DataFrame, history: DataFrame, key: str, at: str, since: str, tiebreak: str, name: str = "version") -> DataFrame:
    """Every reference with the version of its key that held at its time, as the struct ``name`` (the history's columns but the key); null
    where there was none yet, or where key or time is null. A version holds from its own time on; of several with one time the last by ``tiebreak`` does. Versions that
    come late count from their own time, not from their arrival.

    References and versions are put into one order and the last version is carried forward (see ``numbering``), so no key's versions meet
    all its references, and a key of any share of the rows lies in many ranges."""
    columns = [c for c in history.columns if c != key]
    ref, version = F.struct(*refs.columns), F.struct(*columns)
    no_tie = F.lit(None).cast(history.schema[tiebreak].dataType)
    both = history.select(F.col(key).alias("__key"), F.col(since).alias("__at"), F.lit(0).alias("__kind"), F.col(tiebreak).alias("__tie"), F.lit(None).cast("long").alias("__spread"), version.alias("version")).filter("__key IS NOT NULL AND __at IS NOT NULL")
    asked = refs.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__kind"), no_tie.alias("__tie"), F.xxhash64(*refs.columns).alias("__spread"), ref.alias("__ref"))
    order = ["__at", "__kind", "__tie", "__spread"]
    carried = with_previous(both.unionByName(asked, allowMissingColumns=True), ["__key"], order, F.col("version"), "__version", F.col("version").isNotNull())
    known = F.when(F.col("__key").isNotNull() & F.col("__at").isNotNull(), F.col("__version"))
    return carried.filter("__kind = 1").select("__ref.*", known.alias(name))


def stage_violations(events: DataFrame, entity: str, ts: str, tiebreak: str, stage: str, order: tuple[str, ...]) -> DataFrame:
    """(entity, ts, tiebreak, from_stage, to_stage, rule): the events that leave an ordered vocabulary's path, by the first rule that applies:
    ``unknown_stage``, ``not_first`` (an entity begins elsewhere than at the first stage), ``skipped``, ``backwards``. Staying is allowed."""
    ordered = with_previous(events.select(entity, ts, tiebreak, stage), [entity], [ts, tiebreak], F.col(stage), "from_stage")
    now, was = (F.coalesce(stage_number(F.col(c), order), F.lit(0)) for c in (stage, "from_stage"))
    rule = (
        F.when(now == 0, "unknown_stage")
        .when(F.col("from_stage").isNull() & (now > 1), "not_first")
        .when((was > 0) & (now > was + 1), "skipped")
        .when((was > 0) & (now < was), "backwards")
    )
    return ordered.withColumn("rule", rule).filter("rule IS NOT NULL").select(entity, ts, tiebreak, "from_stage", F.col(stage).alias("to_stage"), "rule")


def search(df: DataFrame, text: str, *cols: str) -> DataFrame:
    """Rows where any column contains ``text``, case-insensitively; no ranking."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.contains(F.lower(F.coalesce(df[c], F.lit(""))), F.lit(text.lower()))
    return df.filter(hit)


def labelled(issues: DataFrame, label: str) -> DataFrame:
    return issues.filter((F.col("kind") == "issue") & (F.col("state") == "open") & F.array_contains("labels", label))


def with_node(ideas: DataFrame, node: str, known: tuple[str, ...]) -> DataFrame:
    """Adds ``assigned_node``: the trimmed form field where it names a known node, else null."""
    name = browser_trim(F.coalesce(F.col(node), F.lit("")))
    return ideas.withColumn("assigned_node", F.when(name.isin(*known), name))


def public_only(df: DataFrame, visibility: str = "visibility") -> DataFrame:
    return df.filter(F.col(visibility) == "public")


def stage_number(stage: Column, order: tuple[str, ...]) -> Column:
    """1-based position in an ordered vocabulary; 0 when unknown, null when null."""
    return F.array_position(F.array(*map(F.lit, order)), stage).cast("int")
