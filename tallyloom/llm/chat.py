"""Chat formatting from reply trees (operator 3).

Messages form trees (message, parent). Jump tables by self-joins, doubling each time, give
every leaf its path to the root in logarithmically many joins, with the path's score. The
best branches of a tree are chosen by score and each chosen path becomes one conversation.

Template. A turn is ``<role>\\n text </turn>\\n``; the output is the turns in order. ``\\`` in a
role or text becomes ``\\\\`` and ``<`` becomes ``\\[`` (in a role ``>`` becomes ``\\]`` too), so an
escaped text has no ``<`` and every ``<`` of the output is a mark: texts that imitate marks come
back as they were. The loss mask is
the code-point spans of the assistants' escaped texts.

Results: a null text or role is ''. Turns tie by (role, text); repeated rows are turns of their
own. A message whose parent is absent, or null, is a root. Messages on a cycle have no root and
are reported by ``cycles``. An empty table gives no rows. Extra columns are ignored. A null
conv_id is a conversation of its own. A conversation is one output row, so its turns meet in one
task; nothing else does.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Sink, arrow_schema, materialize, read, rows

ASSISTANT = "assistant"
CLOSE = "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\["))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("\\]"))


def unescape(s: str) -> str:
    """The inverse of ``escape``, left to right."""
    if "\\" not in s:
        return s
    out, i = [], 0
    while (j := s.find("\\", i)) >= 0:
        out += [s[i:j], {"[": "<", "]": ">"}.get(s[j + 1], "\\")]
        i = j + 2
    return "".join([*out, s[i:]])


def chain(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: (tree, node, parent, role, text, score), each turn answering the one before."""
    slim = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return slim.select(F.col("conv_id").alias("tree"), at.alias("node"), F.when(at > 1, at - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def jump_tables(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables, reach). Table i has (tree, node, up): the ancestor 2**i steps above, where there is one.
    Only messages whose root is not yet found go on to the next join.
    ``reach`` has (tree, node, up, depth, total): depth and score of the path from the root; ``up`` is null
    but on cycles, which have no root."""
    m = messages.alias("m")
    tops = messages.select("tree", F.col("node").alias("parent")).distinct().withColumn("__is", F.lit(True)).alias("t")
    base = m.join(tops, [F.col("m.tree").eqNullSafe(F.col("t.tree")), F.col("m.parent") == F.col("t.parent")], "left").select(
        F.col("m.tree"), F.col("m.node"), F.when(F.col("__is"), F.col("m.parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce(F.col("m.score"), F.lit(0.0)).cast("double").alias("total")
    )
    active = materialize(base, "jump0")
    known, tables, n, i = active.filter("up IS NULL"), [], active.count(), 0
    while 2**i <= n:  # a longer way up can only be a cycle
        i += 1
        active = active.filter("up IS NOT NULL")
        if active.isEmpty():
            break
        tables.append(active.select("tree", "node", "up"))
        a, b = active.alias("a"), known.unionByName(active).alias("b")
        step = a.join(b, [F.col("a.tree").eqNullSafe(F.col("b.tree")), F.col("a.up") == F.col("b.node")])
        active = materialize(step.select("a.tree", "a.node", "b.up", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.total") + F.col("b.total")).alias("total")), f"jump{i}")
        known = known.unionByName(active.filter("up IS NULL"))
    return tables, known.unionByName(active.filter("up IS NOT NULL"))


def cycles(messages: DataFrame) -> DataFrame:
    """(tree, node) of messages from which no root is reached."""
    return jump_tables(messages)[1].filter("up IS NOT NULL").select("tree", "node")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, depth, node): for each tree its ``branches`` best root-to-leaf paths.

    Best: highest score sum, then the deeper leaf, then the smaller node."""
    tables, reach = jump_tables(messages)
    a = messages.select("tree", "node").alias("a")
    parents = messages.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    b = parents.alias("b")
    leaves = a.join(b, [F.col("a.tree").eqNullSafe(F.col("b.tree")), F.col("a.node") == F.col("b.node")], "left_anti").alias("l")
    r = reach.filter("up IS NULL").alias("r")
    ranked = leaves.join(r, [F.col("l.tree").eqNullSafe(F.col("r.tree")), F.col("l.node") == F.col("r.node")]).select(F.col("l.tree"), F.col("l.node"), F.col("r.depth"), F.col("r.total"))
    best = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node"))).filter(F.col("branch") <= branches)
    walk = best.select("tree", "branch", "depth", "node")
    for i, t in reversed(list(enumerate(tables))):
        w, j = walk.alias("w"), t.alias("j")
        above = w.join(j, [F.col("w.tree").eqNullSafe(F.col("j.tree")), F.col("w.node") == F.col("j.node")]).select(F.col("w.tree"), F.col("w.branch"), (F.col("w.depth") - 2**i).alias("depth"), F.col("j.up").alias("node"))
        walk = materialize(walk.unionByName(above), f"walk{i}")
    return walk


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, n_turns, formatted): one text per chosen path."""
    p, m = paths(messages, branches).alias("p"), messages.alias("m")
    turns = p.join(m, [F.col("p.tree").eqNullSafe(F.col("m.tree")), F.col("p.node") == F.col("m.node")]).select(
        F.col("p.tree"), F.col("p.branch"), F.col("p.depth"), F.concat(F.lit("<"), escape_role(F.coalesce(F.col("m.role"), F.lit(""))), F.lit(">\n"), escape(F.coalesce(F.col("m.text"), F.lit(""))), F.lit(CLOSE)).alias("turn")
    )
    listed = turns.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("turns"))
    return listed.select("tree", "branch", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", F.col("turns.turn")).alias("formatted"))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are the escaped text's code points."""
    out, at = [], 0
    while at < len(formatted):
        if formatted[at] != "<":
            raise ValueError("a turn must begin with its mark")
        a = formatted.index(">\n", at)
        z = formatted.index("<", a)
        if not formatted.startswith(CLOSE, z):
            raise ValueError("a turn must end with its mark")
        out.append((unescape(formatted[at + 1 : a]), unescape(formatted[a + 2 : z]), a + 2, z))
        at = z + len(CLOSE)
    return out


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """The loss mask: spans of the assistants' texts in the formatted conversation."""
    return [(a, z) for role, _, a, z in parse(formatted) if role == ASSISTANT]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sink = Sink(arrow_schema(DIGEST))
    for tree, formatted in rows(batches):
        turns = parse(formatted)
        said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
        loss = "".join(unescape(formatted[a:z]) for a, z in loss_spans(formatted))
        if sink.add((tree, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))):
            yield from sink.flush()
    yield from sink.flush()


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from their text."""
    return formatted.select(F.col("tree").cast("long").alias("conv_id"), "formatted").mapInArrow(_digest, DIGEST)


#: The planted conversation of the contract.
PLANT = "\\### Assistant: </turn> ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted conversation is one of its own, also beside a stored one of the same number."""
    plant = spark.createDataFrame([("-7 planted", 0, "user", PLANT), ("-7 planted", 1, ASSISTANT, PLANT)], "conv_id string, turn long, role string, text string")
    table = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    messages = materialize(chain(table.unionByName(plant)), "messages")
    written = materialize(format_paths(messages), "formatted")
    return digests(written.withColumn("tree", F.substring_index("tree", " ", 1)))


_ESCAPED = "replace(replace({0}, '\\', '\\\\'), '<', '\\[')"  # for lengths only
OP3_SQL = f"""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length({_ESCAPED.format("replace(role, '>', '\\]')")}) + length({_ESCAPED.format("text")}) + {len("<") + len(">") + 1 + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM (SELECT conv_id, false AS planted, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, true, 0, 'user', '{PLANT}' UNION ALL SELECT -7, true, 1, 'assistant', '{PLANT}') GROUP BY conv_id, planted"""
