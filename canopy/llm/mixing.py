"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets: the sources, by code point with null last, weigh 5, 2, 1 and so on
   in turn and share 150 % of all words.  A target stops at twice its source's
   words; what is left is shared again by weight until none is above.
2. The words to take are cut into equal blocks of ``block_words`` tokens.  The
   blocks are given to sources by highest quotient target / (2 a - 1).
3. A source's documents fall into shards by a seeded hash, each of about
   ``shard_words`` words or ``shard_rows`` documents, whichever is less, so a
   source with a third of all rows, empty or not, is spread over many tasks.
   The source's blocks are given by the same rule to groups of ``GROUP_SHARDS``
   shards, and a group's to its shards, which leaves an integer quota per shard.
   So no task holds all shards of a source; one task holds a row per source.
4. In a shard the documents stand in seeded order and the quota takes the
   blocks in that order, in a second round once all are taken.  So documents
   are taken whole, once or twice, but for one at the end of a round.

All of it is DataFrame operations.  Quotients are only made for the seats that
can be in doubt (a few for each source or shard), not for every block.

Defined results: a null text has 0 words; null is a source of its own; a source
without words has target 0; a source at its cap is taken twice in full; equal
rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import plain, plain_name, settle, small, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 19
SHARD_ROWS = 1 << 14
GROUP_SHARDS = 1 << 12
SEED = 17

_M = "__mix_"


def seeded(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def apportion(cells: DataFrame, group: list[str], order: str, votes: str, seats: str) -> DataFrame:
    """``cells`` with a column ``quota``: within each group, the group's seats go to the highest quotients votes / (2 a - 1).

    For a cell with the share x of the seats, Sainte-Laguë differs from x by at
    most (share of the votes) * (cells + 1) / 2 + 1/2.  Seats below that range
    are certain, and quotients are made for those within it only.
    """
    every = Window.partitionBy(*group)
    c = cells.withColumns({"__all": F.sum(votes).over(every), "__n": F.count(F.lit(1)).over(every)})
    part = F.coalesce(F.col(votes) / F.nullif(F.col("__all"), F.lit(0)), F.lit(0.0))
    slack = F.ceil(part * (F.col("__n") + 1) / 2) + 1
    fair = F.floor(part * F.col(seats))
    c = c.withColumns({"__sure": F.greatest(F.lit(0), fair - slack).cast("long"), "__last": (fair + slack + 1).cast("long")})
    c = c.withColumn("__open", F.col(seats) - F.sum("__sure").over(every))
    runs = c.withColumn("__a", F.explode(F.sequence(F.col("__sure") + 1, F.col("__last"))))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("__a") - 1)), F.col(order))
    won = runs.withColumn("__won", (F.row_number().over(best) <= F.col("__open")) & (F.col(votes) > 0))
    keys = [*group, order]
    quota = won.groupBy(*keys).agg((F.first("__sure") + F.count_if("__won")).alias("quota"))
    return cells.join(quota, keys)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per source of ``sizes`` (source, size): rank, source_size, target, shards, whether it is at its cap, and its quota of blocks."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    one = Window.partitionBy("__one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("__one", F.lit(0)).withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumns({"weight": weight, "cap": most * F.col("source_size"), "__total": F.sum("source_size").over(one) * F.lit(float(share))})
    by = one.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"__pos": F.row_number().over(by), "__level": (F.col("__total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)})
    level = F.min(F.when(F.col("__level") <= F.col("cap") / F.col("weight"), F.struct("__pos", "__level"))).over(one)["__level"]
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    s = s.withColumns({
        "full": F.col("target") >= F.col("cap"),
        "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("__rows") / shard_rows)).cast("long"),
        "seats": F.round(F.col("__total") / block_words).cast("long"),
    })
    s = apportion(s, ["__one"], "rank", "target", "seats")
    return s.select("source", "rank", "source_size", "target", "full", "shards", "quota")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, group_shards: int = GROUP_SHARDS, weights=WEIGHTS, share: float = SHARE, most: int = MOST, carry: bool = False,
) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target and taken, the words that the mix takes of it.

    With ``carry`` all columns of ``docs`` stay and the results come in one
    struct ``__mix_``; otherwise texts don't leave the first stage.
    """
    key = {_M + "size": F.size(words(F.col(text))).cast("long"), _M + "key": seeded(F.col(doc_id), seed)}
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *[c.alias(n.removeprefix(_M)) for n, c in key.items()])
    bare = settle(bare)
    plan = settle(targets(bare.select("source", "size"), weights, share, most, block_words, shard_words, shard_rows))
    plan = small(plan, plan.count())
    shard = lambda key, shards: F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % shards

    placed = bare.join(plan, bare["source"].eqNullSafe(plan["source"])).drop("source").withColumn("shard", shard(F.col("key"), F.col("shards")))
    cells = placed.groupBy("rank", "shard").agg(F.sum("size").alias("cell_size"), F.first("quota").alias("source_quota"), F.first("full").alias("full"))
    cells = settle(cells).withColumn("group", F.floor(F.col("shard") / group_shards))
    groups = cells.groupBy("rank", "group").agg(F.sum("cell_size").alias("group_size"), F.first("source_quota").alias("source_quota"))
    groups = settle(apportion(groups, ["rank"], "group", "group_size", "source_quota").select("rank", "group", F.col("quota").alias("group_quota")))
    cells = apportion(cells.join(groups, ["rank", "group"]), ["rank", "group"], "shard", "cell_size", "group_quota")
    blocks = F.ceil(F.col("cell_size") / block_words)
    quota = F.when(F.col("full"), blocks * most).otherwise(F.least(F.col("quota"), blocks * most))
    rounds = F.array(*[F.least(F.greatest(quota - r * blocks, F.lit(0)), blocks) * block_words for r in range(most)])
    cells = cells.select(F.col("rank").alias(_M + "rank"), F.col("shard").alias(_M + "shard"), rounds.alias(_M + "rounds"))

    if carry:
        p = plan.select(*[F.col(x).alias(_M + x) for x in plan.columns])
        rows = docs.withColumns(key)
        rows = rows.join(p, rows[source].eqNullSafe(p[_M + "source"])).withColumn(_M + "shard", shard(F.col(_M + "key"), F.col(_M + "shards")))
    else:
        rows = placed.select("doc_id", *[F.col(x).alias(_M + x) for x in ("size", "key", "rank", "shard", "source_size", "target")])
    rows = rows.join(cells, [_M + "rank", _M + "shard"])
    order = Window.partitionBy(_M + "rank", _M + "shard").orderBy(_M + "key", doc_id if carry else "doc_id", _M + "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(_M + "end", F.sum(_M + "size").over(order))
    start = F.col(_M + "end") - F.col(_M + "size")
    cut = lambda r: F.least(F.greatest(F.get(F.col(_M + "rounds"), F.lit(r)) - start, F.lit(0)), F.col(_M + "size"))
    taken = sum((cut(r) for r in range(1, most)), cut(0)).cast("long")
    if carry:
        return rows.select(*[F.col(f"`{x}`") for x in docs.columns], F.struct(F.col(_M + "size").alias("size"), taken.alias("taken")).alias(_M))
    return rows.select("doc_id", F.col(_M + "size").alias("size"), F.col(_M + "source_size").alias("source_size"), F.col(_M + "target").alias("target"), taken.alias("taken"))


def blend(docs: DataFrame, **named) -> DataFrame:
    """``docs`` as the mix has them: a document taken for at least half of its words in a round stays whole for that round, so it comes 0, 1 or 2 times."""
    names, docs, named = docs.columns, plain(docs), {x: plain_name(docs, named.get(x, x)) for x in ("doc_id", "text", "source")} | {k: v for k, v in named.items() if k not in ("doc_id", "text", "source")}
    rows = mix(docs, carry=True, **named)
    times = F.floor(rows[_M]["taken"] / F.nullif(rows[_M]["size"], F.lit(0)) + 0.5).cast("int")
    rows = rows.withColumn(_M, F.coalesce(times, F.lit(0)))
    return rows.where(F.col(_M) > 0).withColumn(_M, F.explode(F.array_repeat(F.lit(0), F.col(_M)))).drop(_M).toDF(*names)


def oracle(block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> str:
    """The same in DuckDB SQL, with a quotient for every block, for sources of up to ``GROUP_SHARDS`` shards."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':{seed}') AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z, count(*) AS cnt, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
c AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * z AS cap, (sum(z) OVER ())::DOUBLE * 1.5 AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
              / (sum(w) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lam FROM c),
t AS (SELECT *, least(cap::DOUBLE, coalesce((SELECT arg_min(lam, (cap::DOUBLE / w, rank)) FROM l WHERE lam <= cap::DOUBLE / w), 0) * w) AS target FROM l),
q1 AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * a - 1) DESC, rank) AS n, total FROM (SELECT rank, target, total, unnest(range(1, (target / {block_words})::BIGINT + 40)) AS a FROM t WHERE target > 0)),
qs AS (SELECT rank, count(*) AS quota FROM q1 WHERE n <= round(total / {block_words}) GROUP BY rank),
p AS (SELECT doc_id, size, key, t.rank, z, target, cap, coalesce(qs.quota, 0) AS quota, ('0x' || key[1:8])::BIGINT % greatest(1, ceil(z / {shard_words}), ceil(cnt / {shard_rows}))::BIGINT AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN qs ON qs.rank = t.rank),
cell AS (SELECT rank, shard, sum(size)::BIGINT AS cz, any_value(quota) AS quota, any_value(target >= cap) AS is_full, any_value(z) AS z FROM p GROUP BY rank, shard),
q2 AS (SELECT rank, shard, quota, row_number() OVER (PARTITION BY rank ORDER BY cz / (2 * a - 1) DESC, shard) AS n
       FROM (SELECT rank, shard, quota, cz, unnest(range(1, (quota * cz / z)::BIGINT + 40)) AS a FROM cell WHERE cz > 0)),
qc AS (SELECT rank, shard, count(*) AS quota FROM q2 WHERE n <= quota GROUP BY rank, shard),
b AS (SELECT cell.rank, cell.shard, ceil(cz / {block_words})::BIGINT AS n, CASE WHEN is_full THEN 2 * ceil(cz / {block_words})::BIGINT ELSE coalesce(qc.quota, 0) END AS q
      FROM cell LEFT JOIN qc ON qc.rank = cell.rank AND qc.shard = cell.shard),
r AS (SELECT p.*, least(q, n) * {block_words} AS r1, least(greatest(q - n, 0), n) * {block_words} AS r2,
             (sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS beg
      FROM p JOIN b ON b.rank = p.rank AND b.shard = p.shard)
SELECT doc_id, size, z AS source_size, target, (least(greatest(r1 - beg, 0), size) + least(greatest(r2 - beg, 0), size))::BIGINT AS taken FROM r"""
