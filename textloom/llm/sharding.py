"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities.

The sizes of the old shards are the supplies and the new shards' capacities the
demands of a transport network in which keeping bytes in place is free and
moving a byte costs one.  The flow says how many bytes go from each old shard to
each new one; each old shard is then cut, in a fixed order, into consecutive
blocks of those sizes, and the shards that gain or lose rows are written anew.

Defined results: a null text counts as no bytes and as CRC 0; a null or repeated
doc_id is an ordinary row (ties are ordered by CRC and size); an empty table gives
an empty plan; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, prefix_sums, shared_dir, table, written

OLD_SHARDS = 16
NEW_SHARDS = 24
#: Rows of an old shard of mean size that go to one task when shards are written.
FILE_ROWS = 1 << 11


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]] | None = None) -> list[list[int]]:
    """Units sent from each supply i to each j, all supplies met, at the least total cost.

    Successive shortest augmenting paths; the default cost is 0 for i == j, else 1.
    ``sum(capacity)`` must be at least ``sum(supply)``.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities are smaller than the supplies")
    cost = cost or [[int(i != j) for j in range(m)] for i in range(n)]
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Bellman-Ford queue over suppliers 0..n-1 and receivers n..n+m-1
        dist = [0 if i < n and left[i] else None for i in range(n + m)]
        parent: list[int | None] = [None] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        while queue:
            u = queue.popleft()
            steps = ([(n + j, cost[u][j]) for j in range(m)] if u < n
                     else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]])
            for v, c in steps:
                d = dist[u] + c
                if dist[v] is None or d < dist[v]:
                    dist[v], parent[v] = d, u
                    queue.append(v)
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v])
        path = [end]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for u, v in zip(path, path[1:]):
            if u >= n:
                amount = min(amount, flow[v][u - n])
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return flow


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def sized(docs: DataFrame, old_shard: Column, *more: Column | str) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"), *more,
    )


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, capacities: list[int] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, shard, slot.

    ``old_shard`` gives 0 to n_old - 1.  The driver sees the n_old sizes and at
    most n_old * n_new blocks, never documents.  A document goes where its middle
    byte falls, so a shard misses its capacity by one document at most at each block edge.
    """
    keyed = prefix_sums(sized(docs, old_shard), "old_shard", ["doc_id", "text_crc32", "size"], "size", "reshard")
    keyed = written(keyed, "reshard-order")
    supply = [0] * n_old
    for r in keyed.groupBy("old_shard").agg(F.sum("size").alias("s")).collect():
        supply[r["old_shard"]] = int(r["s"])
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), n_new))
    blocks = []  # (old shard, first byte, end byte, new shard); what stays comes first
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(n_new), key=lambda j: (j != i, j)):
            if row[j]:
                blocks.append((i, at, at + row[j], j))
                at += row[j]
    middle = F.col("before") + F.floor(F.col("size") / 2)
    block: Column = F.lit(0)
    for k, (i, start, end, _) in enumerate(blocks):
        block = F.when((F.col("old_shard") == i) & (middle >= start) & (middle < end), F.lit(k)).otherwise(block)
    dealt = keyed.withColumn("block", block)
    found = {r["block"]: (r["n"], r["first"]) for r in dealt.groupBy("block").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect()}
    shift, filled = {}, [0] * n_new
    for k, (_, _, _, j) in enumerate(blocks):
        if k in found:
            n, first = found[k]
            shift[k] = filled[j] - first
            filled[j] += n
    shard, slot = F.lit(0), F.lit(0).cast("long")
    for k in shift:
        shard = F.when(F.col("block") == k, F.lit(blocks[k][3])).otherwise(shard)
        slot = F.when(F.col("block") == k, F.col("row") + shift[k]).otherwise(slot)
    return dealt.select("doc_id", "size", "text_crc32", "old_shard", shard.alias("shard"), slot.cast("long").alias("slot"))


def affected(plan: DataFrame) -> DataFrame:
    """The shards whose files change: those that gain or lose rows."""
    moved = plan.filter("shard <> old_shard")
    return moved.select("shard").union(moved.select(F.col("old_shard").alias("shard"))).distinct()


def rewrite(plan: DataFrame, docs: DataFrame, path: str, old_shard: Column | None = None, layout: tuple[str, str] = ("shard", "slot")) -> list[int]:
    """Write the affected shards' documents under ``path`` as shard=<n> folders, each file in slot order; the affected shards.

    ``layout`` names the columns of the files that say shard and slot.  Columns of these names in ``docs`` are taken for the old layout's, and replaced; where they are data, choose other names.

    The texts are dealt once, by old shard and a hash of the row: an old shard feeds few new ones, so a task writes few files, and the
    slots of a shard are spread over its files (they are a column).
    Documents are matched to the plan by doc_id, text CRC, size, ``old_shard`` if given, and occurrence, so repeated rows keep
    their count.  Shards that aren't affected stay as they are under ``path``; an affected one that has no rows left goes.
    """
    changed = [r["shard"] for r in affected(plan).collect()]
    if not changed:
        return []
    emptied = set(changed) - {r["shard"] for r in plan.select("shard").distinct().collect()}  # asked now: the plan may read what is overwritten
    shard_name, slot_name = layout
    columns = [c for c in docs.columns if c not in layout]
    known = ["doc_id", "text_crc32", "size", "old_shard"]
    row = F.struct(*columns).alias("_row")
    rows = sized(docs, F.lit(None) if old_shard is None else old_shard, row).select(*known, F.lit(None).cast("struct<shard:int,slot:bigint>").alias("_place"), "_row")
    old = (F.lit(None) if old_shard is None else F.col("old_shard")).cast("int").alias("old_shard")
    place = F.struct(F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    todo = plan.filter(F.col("shard").isin(changed)).select(*known[:3], old, place, F.lit(None).cast(rows.schema["_row"].dataType))
    # dealt once: both windows are over these two and something more, so the texts aren't shuffled again
    deals = 1 + plan.count() // (FILE_ROWS * max(1, plan.select("old_shard").distinct().count()))
    salted = rows.union(todo).withColumn("_deal", F.pmod(F.xxhash64(*known), F.lit(deals)))
    both = salted.repartition("old_shard", "_deal").withColumn("_todo", F.col("_place").isNotNull())
    copy = F.row_number().over(Window.partitionBy("_deal", *known, "_todo").orderBy("_place", F.xxhash64("_row")))
    at = F.max("_place").over(Window.partitionBy("_deal", *known, "_copy"))
    placed = both.withColumn("_copy", copy).withColumn("_at", at).filter("not _todo and _at is not null")
    out = placed.select(F.col("_at.shard").alias(shard_name), F.col("_at.slot").alias(slot_name), *[F.col("_row")[c].alias(c) for c in columns])
    out.sortWithinPartitions(shard_name, slot_name).write.partitionBy(shard_name).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    jvm, conf = plan.sparkSession.sparkContext._jvm, plan.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for shard in emptied:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{shard_name}={shard}")
        folder.getFileSystem(conf).delete(folder, True)
    return changed


def resharded(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, capacities: list[int] | None = None) -> DataFrame:
    """The digest of the layout after the affected shards were written: their rows as read from the new files, the others' from the plan.

    The files have all columns of ``docs``; the columns of shard and slot get other names where ``docs`` has such ones.
    """
    spark = docs.sparkSession
    plan = written(reshard(docs, old_shard, n_old, n_new, capacities), "reshard-plan")
    path = f"{shared_dir(spark).rstrip('/')}/textloom/shards-{uuid.uuid4().hex}"
    layout = fresh(docs, "shard"), fresh(docs, "slot")
    changed = rewrite(plan, docs, path, old_shard, layout)
    if not changed:
        return digest(plan)
    files = spark.read.schema(T.StructType([*docs.schema.fields, T.StructField(layout[1], T.LongType()), T.StructField(layout[0], T.IntegerType())])).parquet(path)
    return digest(sized(files, old_shard, F.col(layout[0]).alias("shard"), F.col(layout[1]).alias("slot"))).union(digest(plan.filter(~F.col("shard").isin(changed))))


def old_layout() -> Column:
    """The layout to start from: files by source, hashed to ``OLD_SHARDS`` shards; one source can hold a third."""
    return F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(OLD_SHARDS))


def digest(plan: DataFrame) -> DataFrame:
    return plan.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op8_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resharded(docs, old_layout(), OLD_SHARDS, NEW_SHARDS)
