import hashlib
from collections import defaultdict

import duckdb

from tallyloom.llm import chat

D = "/root/testdata/sf0.001"


def test_whole_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{D}/conversations.parquet'")
    want = con.execute(chat.OP3_SQL)
    cols = [c[0] for c in want.description]
    got = chat.op3_chat_formatting(spark, D).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_texts_that_imitate_marks_come_back(spark):
    texts = [chat.PLANT, "<assistant>\n", "\\[", "\\\\[<", "a</turn>\nb", "", None, "\\", "]>\\]", "é\U0001f600"]
    roles = ["user", "assistant", "a>\nb<", None, "\\]", "assistant"]
    data = [(5, i, roles[i % len(roles)], t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, tree string")
    out = chat.format_paths(chat.chain(df)).collect()
    assert len(out) == 1
    parsed = chat.parse(out[0].formatted)
    assert [(r, t) for r, t, _, _ in parsed] == [(r or "", t or "") for _, _, r, t, _ in data]
    spans = chat.loss_spans(out[0].formatted)
    assert [chat.unescape(out[0].formatted[a:z]) for a, z in spans] == [t or "" for _, _, r, t, _ in data if r == "assistant"]


def test_ties_repeats_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    data = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "n"), (2, None, None, None)]
    out = {r.conv_id: r for r in chat.digests(chat.format_paths(chat.chain(spark.createDataFrame(data, schema)))).collect()}
    assert out[1].n_turns == 3
    assert out[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert out[None].loss_chars == 1 and out[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.format_paths(chat.chain(spark.createDataFrame([], schema))).count() == 0


def brute(messages, branches):
    by, kids = {}, defaultdict(list)
    for t, n, p, _, _, s in messages:
        by[t, n] = (p, s)
    for (t, n), (p, _) in by.items():
        kids[t, p].append(n)
    found = defaultdict(list)
    for (t, n) in by:
        if not kids[t, n]:
            path, at = [], n
            while at is not None and (t, at) in by:
                path.append(at)
                at = by[t, at][0]
            found[t].append((-sum(by[t, x][1] for x in path), -len(path), n, path[::-1]))
    return {(t, i + 1): p for t, f in found.items() for i, (_, _, _, p) in enumerate(sorted(f)[:branches])}


def test_branches_of_trees(spark):
    data = []
    for t in range(6):
        for n in range(1, 60):
            p = None if n == 1 or n % 29 == 0 else (n * 7 + t) % (n - 1) + 1
            data.append((t, n, p, "user", f"m{n}", float((n * 13 + t) % 11)))
    data += [(9, i, i - 1 if i > 1 else None, "user", "x", None) for i in range(1, 40)]
    m = spark.createDataFrame(data, "tree long, node long, parent long, role string, text string, score double")
    got = defaultdict(list)
    for r in chat.paths(m, 3).collect():
        got[r.tree, r.branch].append((r.depth, r.node))
    want = brute([(*d[:5], d[5] or 0.0) for d in data], 3)
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want
    assert all([d for d, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_cycles_are_reported(spark):
    data = [(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0), (1, 3, None, "u", "c", 0.0), (1, 4, 3, "u", "d", 0.0)]
    m = spark.createDataFrame(data, "tree long, node long, parent long, role string, text string, score double")
    assert sorted(r.node for r in chat.cycles(m).collect()) == [1, 2]
    assert [r.node for r in chat.paths(m).orderBy("depth").collect()] == [3, 4]


def test_a_stored_conversation_of_the_planted_number_stays_apart(spark, tmp_path):
    spark.createDataFrame([(-7, 0, "user", "mine"), (3, 0, "assistant", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.n_turns, r.loss_chars) for r in chat.op3_chat_formatting(spark, str(tmp_path)).collect())
    assert got == [(-7, 1, 0), (-7, 2, len(chat.PLANT)), (3, 1, 1)]
