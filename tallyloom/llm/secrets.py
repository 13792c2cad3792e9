"""Secret scans with a trigram inverted index (operator 7). Native: built-in functions only.

Each rule's regular expression is parsed and turned into a Boolean trigram query: an OR over
the ways through its branches, each an AND over the trigrams of the literals on that way,
lower-cased. The index has a row for each (trigram, document) with the trigrams that any query
names. Postings are intersected by document: a way holds where all of its trigrams meet. Only the
candidates are verified with the rule's expression. A rule with a way that has no trigram (here
``hex``) is verified on every text. Candidates are few and narrow: up to ``SMALL`` of them, by count, are
broadcast, so that texts are verified where they are read; more of them are joined by a shuffle.

Matches are leftmost and do not overlap, per kind; those whose value is too short are dropped
after matching. Positions are code points, end exclusive: the running sum of the lengths of what
lies between matches and of the matches themselves, in blocks, so that a text with very many
matches does not take quadratic time.

Results: a null text is empty. Repeated rows and equal doc_ids are scanned each on its own (their
candidates are shared, which can only add candidates). Rows with a null doc_id are verified with
every rule. An empty table gives no rows. Extra columns are ignored, and kept by ``redact``.
"""

import re
import re._parser as parser
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, read, text_of


@dataclass(frozen=True)
class Rule:
    """``value``: the group that must have ``least`` characters (0: the match); base rules come first.
    ``whole``: what ``redact`` replaces, where that is more than the match; it starts with a match."""

    kind: str
    pattern: str
    least: int = 1
    value: int = 0
    base: bool = False
    whole: str = ""


#: The base rules. A greedy run is as long with ``{n,}`` as with ``+``, so the
#: lengths of ``access`` and ``hex`` are in their expressions.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
)
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
#: Public key formats, in addition. A key's body goes with its first line: up to its END line, whatever lies between but
#: another key's first line, or where there is none as far as its Base64 lines go, however many (possessive, so no step is taken back).
MORE = (
    Rule("pem", PEM, whole=PEM + r"(?:[^-]*+(?:-(?!----(?:END|BEGIN) )[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:[\s\\]{0,4}[A-Za-z0-9+/=]{20,}+)*+(?:[\s\\]{0,4}[A-Za-z0-9+/]{1,19}={1,2})?)"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE + MORE
PLACE = "[SECRET]"
#: Matches per block of the running sums.
BLOCK = 512
#: Most candidates that are broadcast: rows of a doc_id and the rules' bits.
SMALL = 1_000_000
#: Ways through a rule's branches that are told apart; past it a branch counts as no literal.
MOST_WAYS = 64


def ways(pattern: str) -> list[list[str]]:
    """For each way through the expression, the lower-case literals that a match must contain."""

    def walk(nodes) -> list[list[str]]:
        """Each way is a list of parts; "" marks a break between literals."""
        out: list[list[str]] = [[]]
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                got = [[chr(arg).lower()]]
            elif name == "BRANCH":
                got = [w for branch in arg[1] for w in walk(branch)]
            elif name == "SUBPATTERN":
                got = walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = arg
                once = walk(body)
                if low == 0 and high == 1:
                    got = [[], *once]
                elif low == 0:
                    got = [[""]]
                else:  # the first time is certain; what follows it is a break
                    got = [w if low == high == 1 else [*w, ""] for w in once]
            else:
                got = [[""]]
            if len(out) * len(got) > MOST_WAYS:
                got = [[""]]
            out = [a + b for a, b in product(out, got)]
        return out

    def literals(way: list[str]) -> list[str]:
        return [x for x in "".join(c or "\0" for c in way).split("\0") if len(x) >= 3]

    return [literals(w) for w in walk(parser.parse(pattern))]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The OR of ANDs of trigrams; None when a way has no trigram."""
    out = {frozenset(x[i : i + 3] for x in way for i in range(len(x) - 2)) for way in ways(pattern)}
    return None if frozenset() in out else sorted(out, key=sorted)


def queries(rules: tuple[Rule, ...]) -> dict[int, list[frozenset[str]]]:
    """Trigram queries of the rules that have one, by rule number."""
    return {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: (gram, doc_id), a row for each of ``grams`` in each text, lower-cased."""
    low = docs.filter("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select("doc_id", found.alias("grams")).select(F.explode("grams").alias("gram"), "doc_id")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): bit i is set where rule i's trigram query holds.

    A document's postings meet as one OR of gram bits, summed up before the shuffle."""
    by_rule = queries(rules)
    grams = sorted({g for q in by_rule.values() for way in q for g in way})
    words = [grams[i : i + 60] for i in range(0, len(grams), 60)]
    at = {g: (k, i) for k, some in enumerate(words) for i, g in enumerate(some)}
    met = postings(docs, grams).groupBy("doc_id").agg(*[_shift(k) for k in range(len(words))])

    def holds(way: frozenset[str]) -> Column:
        out = F.lit(True)
        for k in range(len(words)):
            need = sum(1 << at[g][1] for g in way if at[g][0] == k)
            if need:
                out = out & (F.col(f"g{k}").bitwiseAND(F.lit(need)) == F.lit(need))
        return out

    bits = F.lit(0)
    for i, q in by_rule.items():
        bits = bits + F.when(reduce(lambda a, b: a | b, map(holds, q)), F.lit(1 << i)).otherwise(F.lit(0))
    return met.select("doc_id", bits.alias("rules")).filter("rules <> 0")


def _shift(k: int) -> Column:
    """Bits of the grams of word k of a document's bit set."""
    own = (F.col("gram") >= 60 * k) & (F.col("gram") < 60 * (k + 1))
    value = F.expr(f"shiftleft(1L, gram - {60 * k})")
    return F.bit_or(F.when(own, value).otherwise(F.lit(0).cast("long"))).alias(f"g{k}")


def with_candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``rules``: the bits of the rules to verify on each row."""
    always = sum(1 << i for i in range(len(rules)) if i not in queries(rules))
    every = (1 << len(rules)) - 1
    found = candidates(docs.select("doc_id", text_of().alias("text")), rules).withColumnRenamed("doc_id", "__id").withColumnRenamed("rules", "__found")
    found = materialize(found, "candidates")
    side = F.broadcast(found) if found.count() <= SMALL else found
    joined = docs.join(side, docs["doc_id"] == F.col("__id"), "left").drop("__id")
    return joined.withColumn("rules", F.when(F.col("doc_id").isNull(), F.lit(every)).otherwise(F.coalesce("__found", F.lit(0)).bitwiseOR(F.lit(always)))).drop("__found")


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda a, x: a + x)


def _once(make, *columns: str) -> Column:
    """``make`` of a struct of the columns as a lambda's argument: they are found once a row. A column that a lambda names itself may be put in
    its place by the optimizer, and is then found once an element."""
    return F.get(F.transform(F.array(F.struct(*columns)), make), 0)


def with_matches(df: DataFrame, i: int, rule: Rule, text: str) -> DataFrame:
    """Adds the arrays ``__full`` (matches), ``__value`` and ``__between`` (what lies around them) of one
    rule; a text that the rule need not see, or does not match, has none."""
    go = (F.col("rules").bitwiseAND(F.lit(1 << i)) != 0) & F.col(text).rlike(rule.pattern)
    none = F.array().cast("array<string>")
    p = F.lit(rule.pattern)
    df = df.withColumn("__go", go)
    take = lambda g: F.when(F.col("__go"), F.regexp_extract_all(text, p, g)).otherwise(none)
    return df.withColumns({"__full": take(0), "__value": take(rule.value), "__between": F.when(F.col("__go"), F.split(text, rule.pattern, -1)).otherwise(none)}).drop("__go")


def with_spans(df: DataFrame, i: int, rule: Rule) -> DataFrame:
    """Adds ``__s{i}``: array of (start, kind number, end) of the rule's matches that hold."""
    df = with_matches(df, i, rule, "text")
    step = F.transform("__full", lambda f, k: F.length(F.get("__between", k)) + F.coalesce(F.length(F.get("__full", k - 1)), F.lit(0)))
    df = df.withColumn("__step", step)
    blocks = F.sequence(F.lit(0), F.floor(F.size("__step") / BLOCK).cast("int"))
    df = df.withColumn("__sums", F.transform(blocks, lambda b: _total(F.slice("__step", b * BLOCK + 1, F.lit(BLOCK)))))
    df = df.withColumn("__base", F.transform(blocks, lambda b: _total(F.slice("__sums", F.lit(1), b))))

    def spans(z: Column) -> Column:
        def span(f: Column, k: Column) -> Column:
            b = F.floor(k / BLOCK).cast("int")
            start = F.get(z["__base"], b) + _total(F.slice(z["__step"], b * BLOCK + 1, k - b * BLOCK + 1))
            return F.struct(start.cast("long").alias("start"), F.lit(i).alias("kind"), (start + F.length(f)).cast("long").alias("end"), (F.length(F.get(z["__value"], k)) >= rule.least).alias("ok"))

        kept = F.filter(F.transform(z["__full"], span), lambda x: x["ok"])
        return F.transform(kept, lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return df.withColumn(f"__s{i}", _once(spans, "__full", "__value", "__step", "__base")).drop("__full", "__value", "__between", "__step", "__sums", "__base")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): spans of all rules as (start, kind number, end), in that order."""
    df = with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), rules)
    for i, r in enumerate(rules):
        df = with_spans(df, i, r)
    return df.select("doc_id", F.sort_array(F.concat(*[f"__s{i}" for i in range(len(rules))])).alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def _without_values(rule: Rule):
    """The text put together again: what lies between the matches, and the matches without the values that hold."""

    def join(z: Column) -> Column:
        def piece(b: Column, k: Column) -> Column:
            f, n = F.get(z["__full"], k), F.length(F.get(z["__value"], k))
            return F.concat(b, F.coalesce(F.when(n >= rule.least, F.concat(F.left(f, F.length(f) - n), F.lit(PLACE))).otherwise(f), F.lit("")))

        return F.array_join(F.transform(z["__between"], piece), "")

    return join


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the value of every match that holds replaced by ``[SECRET]``, rule after rule.
    Rows, columns and null texts stay as they are; repeated rows are redacted each. Matches are joined back from their pieces in
    one pass a rule, in linear time, however long the text."""
    names = docs.columns
    slim = docs.withColumnsRenamed({c: f"__in_{k}" for k, c in enumerate(names) if c not in ("doc_id", "text")})
    df = with_candidates(slim, rules)
    for i, r in enumerate(rules):
        df = with_matches(df, i, replace(r, pattern=r.whole or r.pattern), "text")
        whole = _once(_without_values(r), "__full", "__value", "__between")
        df = df.withColumn("text", F.when(F.size("__full") > 0, whole).otherwise(F.col("text"))).drop("__full", "__value", "__between")
    return df.select(*[F.col(c if c in ("doc_id", "text") else f"__in_{k}").alias(c) for k, c in enumerate(names)])


def op7_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(listed(base, RULES), 256).alias("base_sha256"), listed(F.col("spans"), RULES).alias("spans"))


def _op7_sql() -> str:
    """The query in DuckDB's SQL. Its engine folds the case of non-ASCII letters too, so letters of either
    case are spelt out."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def spelt(pattern: str) -> str:
        m = re.search(r"\(\?i:([^)]*)\)", pattern)
        return pattern if not m else pattern.replace(m[0], "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m[1]) + ")")

    parts = []
    for i, r in enumerate(RULES):
        p = q(spelt(r.pattern))
        parts.append(
            f"SELECT rid, {i} AS k, {q(r.kind)} AS kind, f, v, list_sum(list_transform(between[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:j - 1], lambda x: length(x))), 0) AS a, {r.least} AS least FROM "
            f"(SELECT rid, matches, between, unnest(range(1, len(matches) + 1)) AS j, unnest(matches) AS f, unnest(vals) AS v FROM (SELECT rid, regexp_extract_all(t, {p}) AS matches, regexp_extract_all(t, {p}, {r.value}) AS vals, string_split_regex(t, {p}) AS between FROM d))"
        )
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
h AS (SELECT rid, CAST(count(*) FILTER (WHERE k = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE k = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (WHERE k = 2) AS BIGINT) AS n_hex,
string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(f) AS BIGINT), ',' ORDER BY a, k) FILTER (WHERE k < {len(BASE)}) AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(f) AS BIGINT), ',' ORDER BY a, k) AS spans FROM s WHERE length(v) >= least GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN h USING (rid)"""


OP7_SQL = _op7_sql()
