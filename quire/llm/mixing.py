"""Operator 6, mixing sources to target weights by hierarchical budgeting.

The sources form a tree of domain, language and source. The budget of tokens at the root is split among the children of a
node by their weights, but none gets more than its capacity, the tokens below it times ``max_epochs``; what a full child
can't take goes to its siblings by their weights, and so reaches the level above only if all siblings are full. Budgets are
whole numbers; fractions are dropped. A leaf takes its budget as whole epochs and then the prefix of one more, in the order
of a hash of seed, epoch and doc_id, as far as the running sum of tokens fits.

Scale: sorting a leaf is avoided. Tokens are summed by leaf and 4,096 ranges of the hash, the range in which the prefix ends
is the only one whose rows are sorted, and the last hash that fits decides for all rows in a filter. Leaves (not documents)
are collected on the driver, as the tree is small; their table is broadcast to the rows if it has at most 50,000 of them.

Cases: a token is a run of characters other than space, tab, newline, return and form feed; null and empty texts have
none, and come along with an epoch in which they lie. Null languages or sources are the leaf 'unknown'. Rows with equal
doc_id in a leaf tie: they enter a prefix together or not at all. A leaf without tokens has no copies, an empty table none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import drop_dir, local_rows, materialize

SEED, SHARE, MAX_EPOCHS = 17, (4, 5), 2
DOMAINS = {f"src{i}": "web" if i < 8 else "books" if i < 14 else "news" for i in range(20)}
WEIGHTS = {"domain": {"web": 5, "books": 3, "news": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 2}}
"""Whole numbers; what isn't named weighs 1, and a source of no named domain is in the domain 'other'."""
LEAF = ["domain", "lang", "source"]
WORD = "[^ \\t\\n\\r\\f]+"


def _leaf(domains: dict[str, str]):
    source = F.coalesce("source", F.lit("unknown"))
    table = F.create_map(*[F.lit(x) for kv in sorted(domains.items()) for x in kv])
    return F.coalesce(table[source] if domains else F.lit(None), F.lit("other")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), source.alias("source")


def fill(budget: int, children: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Split a budget among children, name to (weight, capacity); the fullest for their weight first."""
    rest = sum(w for w, _ in children.values())
    got = {}
    for name, (w, cap) in sorted(children.items(), key=lambda c: (c[1][1] / c[1][0], c[0])):
        if budget * w >= cap * rest:
            got[name] = cap
            budget, rest = budget - cap, rest - w
        else:
            got[name] = budget * w // rest  # no later child is full, so budget and rest stay
    return got


def budgets(tokens: dict[tuple[str, str, str], int], share: tuple[int, int], max_epochs: int, weights: dict[str, dict[str, int]]) -> dict[tuple[str, str, str], int]:
    """Budget of every leaf, from the tokens of every leaf."""

    def down(level: int, budget: int, below: dict[tuple[str, str, str], int]) -> dict:
        if level == len(LEAF):
            return dict.fromkeys(below, budget)
        groups: dict[str, dict] = {}
        for leaf, n in below.items():
            groups.setdefault(leaf[level], {})[leaf] = n
        got = fill(budget, {k: (weights.get(LEAF[level], {}).get(k, 1), max_epochs * sum(g.values())) for k, g in groups.items()})
        return {leaf: b for k, g in groups.items() for leaf, b in down(level + 1, got[k], g).items()}

    return down(0, sum(tokens.values()) * share[0] // share[1], tokens)


def _plan(slim: DataFrame, seed: int, share: tuple[int, int], max_epochs: int, weights: dict) -> DataFrame:
    """For each leaf its whole epochs and the last hash of the prefix (null: none), as a local table."""
    spark = slim.sparkSession
    tokens = {(r["domain"], r["lang"], r["source"]): r["n"] for r in slim.groupBy(LEAF).agg(F.sum("n_tokens").alias("n")).collect()}
    plan = [(*leaf, b // tokens[leaf] if tokens[leaf] else 0, b % tokens[leaf] if tokens[leaf] else 0) for leaf, b in budgets(tokens, share, max_epochs, weights).items()]
    leaves = local_rows(spark, plan, "domain string, lang string, source string, full bigint, rest bigint")
    rows = slim.join(leaves, LEAF).where("rest > 0").withColumn("h", _hash(seed, F.col("full"))).withColumn("range", F.substring("h", 1, 3))
    sums = rows.groupBy(*LEAF, "rest", "range").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(LEAF).orderBy("range"))
    cut = sums.withColumn("upto", upto).where("upto > rest").groupBy(LEAF).agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    edge = rows.join(local_rows(spark, [tuple(r) for r in cut.select(*LEAF, "cut.range", "cut.before").collect()], "domain string, lang string, source string, range string, before bigint"), [*LEAF, "range"])
    fits = edge.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(LEAF).orderBy("h").rangeBetween(Window.unboundedPreceding, 0))).where("upto <= rest")
    last = {tuple(r)[:3]: r["h"] for r in fits.groupBy(LEAF).agg(F.max("h").alias("h")).collect()}
    ranges = {tuple(r)[:3]: r["range"] for r in edge.select(*LEAF, "range").distinct().collect()}
    # where no row of the last range fits, the prefix ends with the range before: any hash below the range's first
    return local_rows(spark, [(*p[:4], last.get(p[:3], ranges.get(p[:3])) if p[4] else None) for p in plan], "domain string, lang string, source string, full bigint, last string")


def _hash(seed: int, epoch):
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _tokens():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def _copies(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (leaf, doc_id and more), once for every epoch in which the leaf takes it, with the column epoch."""
    n = F.col("full") + F.coalesce((_hash(seed, F.col("full")) <= F.col("last")).cast("bigint"), F.lit(0))
    return rows.join(plan, LEAF).withColumn("epochs", n).where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))


def mix(docs: DataFrame, seed: int = SEED, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, domains: dict[str, str] = DOMAINS, weights: dict = WEIGHTS) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch of every copy of a row of docs that the mixture takes.

    The budget is share[0] / share[1] of all tokens.
    """
    slim, _ = materialize(docs.select("doc_id", *_leaf(domains), _tokens().alias("n_tokens")), "mixing")
    return _copies(slim, _plan(slim, seed, share, max_epochs, weights), seed).select("doc_id", *LEAF, "n_tokens", F.col("epoch").cast("int"))


def mix_documents(docs: DataFrame, seed: int = SEED, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, domains: dict[str, str] = DOMAINS, weights: dict = WEIGHTS) -> DataFrame:
    """The rows of docs that the mixture takes, with its columns, once for every epoch. Texts aren't shuffled."""
    spark = docs.sparkSession
    slim, at = materialize(docs.select("doc_id", *_leaf(domains), _tokens().alias("n_tokens")), "mixing")
    plan = _plan(slim, seed, share, max_epochs, weights)
    drop_dir(spark, at)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", *_leaf(domains))
    return _copies(rows, plan, seed).select("row.*")


def _case(column: str, table: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in sorted(table.items())) + f" ELSE {other} END"


def _level(name: str, parent: str, up: str, keys: list[str], weight: str) -> str:
    """CTE that splits the budgets of the rows of ``parent`` among the groups ``keys`` of the leaves."""
    above, own = keys[:-1], keys[-1]
    join = " AND ".join(f"p.{k} = c.{k}" for k in above) or "true"
    by = f"PARTITION BY {', '.join('c.' + k for k in above)}" if above else ""
    cols = ", ".join("c." + k for k in keys)
    return f"""{name}_a AS (SELECT {", ".join(keys)}, ({weight})::HUGEINT AS w, max_cap AS cap FROM (SELECT {", ".join(keys)}, sum(cap) AS max_cap FROM leaf GROUP BY ALL)),
{name}_b AS (SELECT {cols}, c.w, c.cap, p.b, p.b - coalesce(sum(c.cap) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bb,
  sum(c.w) OVER ({by}) - coalesce(sum(c.w) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ww, sum(c.w) OVER ({by}) AS wt
  FROM {name}_a c JOIN {parent} p ON {join} WINDOW u AS ({by} ORDER BY c.cap::DOUBLE / c.w, c.{own})),
{name}_c AS (SELECT *, bb * w >= cap * ww AS is_full FROM {name}_b),
{name} AS (SELECT {", ".join(keys)}, CASE WHEN is_full THEN cap ELSE ((b - coalesce(sum(cap) FILTER (is_full) OVER ({by.replace("c.", "")}), 0)) * w) // (wt - coalesce(sum(w) FILTER (is_full) OVER ({by.replace("c.", "")}), 0)) END AS b FROM {name}_c)"""


SQL = f"""WITH slim AS (SELECT doc_id, {_case("coalesce(source, 'unknown')", DOMAINS, "'other'")} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS n, sum(n_tokens)::HUGEINT * {MAX_EPOCHS} AS cap FROM slim GROUP BY ALL),
root AS (SELECT sum(n) * {SHARE[0]} // {SHARE[1]} AS b FROM leaf),
{_level("d", "root", "", ["domain"], _case("domain", WEIGHTS["domain"], "1"))},
{_level("l", "d", "", ["domain", "lang"], _case("lang", WEIGHTS["lang"], "1"))},
{_level("s", "l", "", ["domain", "lang", "source"], _case("source", WEIGHTS["source"], "1"))},
plan AS (SELECT domain, lang, source, CASE WHEN n > 0 THEN b // n ELSE 0 END AS e, CASE WHEN n > 0 THEN b % n ELSE 0 END AS rest FROM s JOIN leaf USING (domain, lang, source)),
r AS (SELECT slim.*, e, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || e::BIGINT::VARCHAR || ':' || coalesce(doc_id::VARCHAR, ''))) AS upto FROM slim JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, unnest(range((e + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT))::INTEGER AS epoch FROM r"""
