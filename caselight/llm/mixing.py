"""Mixing sources to target weights, as DataFrame operations only.

A token budget flows down a tree of domain, language and source. At each node it is shared among the children by
weight; a child that cannot use its share (it has too few tokens, even over the allowed epochs) takes what it can,
and its siblings share the rest. Only what all siblings together cannot use goes back to the ancestor. A leaf then
takes whole epochs and, of the next epoch's seeded order, the prefix that fills its budget to the token.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import materialise

WORD = "[^\\x20\\x09-\\x0D]+"
LEAF = ["mix_domain", "mix_lang", "mix_source"]
#: Hex digits of the order key that deal a leaf's documents into buckets for the prefix sum.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Target weights per name (others: 1), the budget as a share of all tokens, and the epochs that a leaf may run."""

    domains: dict[str, int] = field(default_factory=lambda: {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    share: float = 0.6
    epochs: int = 2
    seed: int = 11


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number at its end."""
    number = F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999"))
    return F.coalesce(F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")), F.lit("domain"))


def weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1.0)
    for k, w in weights.items():
        out = F.when(name == k, F.lit(float(w))).otherwise(out)
    return out


def with_leaf(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """``docs`` with the leaf that each row is in and its tokens; null names count as ''."""
    named = {"mix_domain": F.coalesce(domain if domain is not None else domain_of(F.col("source")), F.lit("")), "mix_lang": F.coalesce("lang", F.lit("")), "mix_source": F.coalesce("source", F.lit(""))}
    return docs.withColumns(named | {"mix_tokens": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")})


def shared_out(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """``children`` (parents, child, cap, w, budget of the parent) with ``budget`` of the child: the level to which all are filled, or the child's cap."""
    inside = Window.partitionBy(*[F.col(c) for c in parents] or [F.lit(0)])
    rows = children.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    order = inside.orderBy("ratio", child)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("budget") - before).cast("double") / after)
    filled = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(inside)
    rows = rows.withColumn("filled", filled)
    given = F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.least("cap", F.floor(F.greatest(F.col("filled"), F.lit(0.0)) * F.col("w"))))
    return rows.withColumn("budget", given.cast("long")).drop("ratio", "level", "filled")


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_budgets(base: DataFrame, mix: Mix) -> DataFrame:
    """Budget of each leaf: (mix_domain, mix_lang, mix_source, tokens, whole epochs, tokens of the part epoch)."""
    leaves = materialise(base.groupBy(*LEAF).agg(F.sum("mix_tokens").alias("tokens")).where("tokens > 0"), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    names, out = [mix.domains, mix.langs, mix.sources], None
    for depth, weights in enumerate(names):
        keys = LEAF[: depth + 1]
        level = leaves.groupBy(*keys).agg((F.sum("tokens") * mix.epochs).alias("cap")).withColumn("w", weight(F.col(keys[-1]), weights))
        level = level.withColumn("budget", F.lit(int(total * mix.share)).cast("long")) if out is None else level.join(out.select(*keys[:-1], "budget"), keys[:-1])
        out = shared_out(level, keys[:-1], keys[-1])
    out = out.withColumn("tokens", F.expr(f"cap div {mix.epochs}"))
    return out.select(*LEAF, "tokens", F.expr("budget div tokens").cast("int").alias("full"), (F.col("budget") % F.col("tokens")).alias("part"))


def leaf_cuts(base: DataFrame, mix: Mix) -> DataFrame:
    """Leaf budgets with the order key at which the part epoch ends (``cut``) and the tokens taken of that document (``last``).

    Tokens are summed per bucket of the order first; only the bucket in which the part ends is looked at by document.
    """
    budgets = materialise(leaf_budgets(base, mix), "mix-budgets")
    keyed = base.where("mix_tokens > 0").join(budgets.where("part > 0"), LEAF).withColumn("key", order_key(F.col("full"), mix.seed)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*LEAF, "part", "bucket").agg(F.sum("mix_tokens").alias("size"))
    upto = F.sum("size").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    ends = sums.withColumn("upto", upto).where("upto >= part AND upto - size < part").select(*LEAF, "bucket", (F.col("upto") - F.col("size")).alias("before"))
    units = keyed.join(ends, [*LEAF, "bucket"]).groupBy(*LEAF, "part", "before", "key").agg(F.sum("mix_tokens").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy(*LEAF).orderBy("key"))
    cuts = units.withColumn("upto", upto).where("upto >= part AND upto - size < part")
    cuts = cuts.select(*LEAF, F.col("key").alias("cut"), (F.col("part") - F.col("upto") + F.col("size")).alias("last"))
    return materialise(budgets.join(cuts, LEAF, "left"), "mix-cuts")


def mix_tokens(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens): what each document gives to the mixture, a row per epoch.

    Tokens are words. Nulls: a null language or source is the name ''; a null text, like one without words, has no
    tokens and gives none. Ties: rows of one leaf with the same doc_id go together; if the budget ends in them each
    gives at most what is left. Empty table: an empty result. Budgets are whole tokens, so a node may give up to one
    token per child less. Texts are counted whole, of any length. Other columns are not read.
    """
    base = materialise(with_leaf(docs.select("doc_id", "text", "lang", "source"), domain).select("doc_id", *LEAF, "mix_tokens"), "mix-base")
    cuts = leaf_cuts(base, mix)
    rows = base.where("mix_tokens > 0").join(cuts, LEAF).withColumn("key", order_key(F.col("full"), mix.seed))
    take = F.when(F.col("key") < F.col("cut"), F.col("mix_tokens")).when(F.col("key") == F.col("cut"), F.least("mix_tokens", "last")).otherwise(F.lit(0))
    takes = F.transform(F.sequence(F.lit(0), F.col("full")), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("full"), F.col("mix_tokens")).otherwise(take).cast("long").alias("take")))
    rows = rows.withColumn("taken", F.explode(takes)).where("taken.take > 0")
    return rows.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("taken.epoch").cast("int").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("taken.take").alias("take_tokens"))


def chosen(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """The rows of ``docs``, with their own columns and values, of which the mixture takes anything.

    Nulls, ties, repeated rows, long texts and empty tables: as in ``mix_tokens``; rows of one leaf with the same doc_id
    are all taken or all left. Texts are counted whole, and not shuffled. Columns of any name keep their values.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "lang", "source")
    leafed = with_leaf(rows, domain)
    cuts = leaf_cuts(materialise(leafed.select("doc_id", *LEAF, "mix_tokens"), "mix-base"), mix)
    cuts = cuts.select(*LEAF, "full", "cut")
    taken = leafed.where("mix_tokens > 0").join(cuts, LEAF).where((F.col("full") > 0) | (order_key(F.col("full"), mix.seed) <= F.col("cut")))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def oracle(mix: Mix = Mix()) -> str:
    """The same mixture for DuckDB."""

    def case(name: str, weights: dict[str, int]) -> str:
        return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {float(w)}::DOUBLE" for k, w in weights.items()) + " ELSE 1.0::DOUBLE END" if weights else "1.0::DOUBLE"

    def fill(rows: str, parents: str, child: str) -> str:
        part = f"PARTITION BY {parents}" if parents else ""
        return f"""
      SELECT *, CAST(CASE WHEN ratio <= level THEN cap ELSE least(cap, floor(greatest(max(CASE WHEN ratio > level THEN level END) OVER ({part}), 0.0) * w)) END AS BIGINT) AS given
      FROM (SELECT *, CAST(budget - coalesce(sum(cap) OVER ({part} ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                      / sum(w) OVER ({part} ORDER BY ratio, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM ({rows})))"""

    return f"""
WITH base AS (
  SELECT doc_id, coalesce('domain' || CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4 AS VARCHAR), 'domain') AS d,
         coalesce(lang, '') AS l, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n
  FROM documents),
leaves AS (SELECT d, l, s, CAST(sum(n) AS BIGINT) AS tokens FROM base GROUP BY 1, 2, 3 HAVING sum(n) > 0),
top AS ({fill(f"SELECT d, CAST(sum(tokens) * {mix.epochs} AS BIGINT) AS cap, {case('d', mix.domains)} AS w, (SELECT CAST(floor(sum(tokens) * {mix.share}::DOUBLE) AS BIGINT) FROM leaves) AS budget FROM leaves GROUP BY d", "", "d")}),
mid AS ({fill(f"SELECT x.d, l, CAST(sum(tokens) * {mix.epochs} AS BIGINT) AS cap, {case('l', mix.langs)} AS w, any_value(top.given) AS budget FROM leaves x JOIN top ON x.d = top.d GROUP BY x.d, l", "d", "l")}),
low AS ({fill(f"SELECT x.d, x.l, s, tokens * {mix.epochs} AS cap, {case('s', mix.sources)} AS w, mid.given AS budget FROM leaves x JOIN mid ON x.d = mid.d AND x.l = mid.l", "d, l", "s")}),
plan AS (SELECT d, l, s, given // (cap // {mix.epochs}) AS full_epochs, given % (cap // {mix.epochs}) AS part FROM low),
keyed AS (SELECT base.*, full_epochs, part, md5('{mix.seed}:' || CAST(full_epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS k FROM base JOIN plan USING (d, l, s) WHERE n > 0),
summed AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY k) - n AS before FROM keyed)
SELECT doc_id, d AS domain, l AS lang, s AS source, CAST(epoch AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens, CAST(take AS BIGINT) AS take_tokens
FROM (SELECT *, CASE WHEN epoch < full_epochs THEN n ELSE greatest(0, least(n, part - before)) END AS take
      FROM summed, unnest(range(full_epochs + 1)) AS u(epoch)) WHERE take > 0
"""
