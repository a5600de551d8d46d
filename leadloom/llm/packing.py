"""Filling containers of fixed capacity by multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.plans.lineage import cut

#: Containers that a group of items fills, about. Half a container of each group stays empty on average.
GROUP_CONTAINERS = 96
#: Packs at most; the plan has a branch for each.
MOST_PACKS = 1000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part, 0 to k-1, of each item: largest differencing into k parts.

    Each item begins as a partial partition with all but one part empty. The two partitions with the widest
    spread are merged, the fullest part of one with the emptiest of the other, until one is left.
    """
    n = len(sizes)
    if n == 0 or k <= 1:
        return np.zeros(n, dtype=np.int64)
    left, right = np.zeros(n + 1 + n * 2, dtype=np.int64), np.zeros(n + 1 + n * 2, dtype=np.int64)
    heap, kept = [], {}
    for i, x in enumerate(sizes.tolist()):
        heap.append((-x, i))
        kept[i] = None  # an item alone: made into arrays when it is merged
    heapq.heapify(heap)
    next_node, tick = n + 1, n

    def arrays(key: int) -> tuple[np.ndarray, np.ndarray]:
        got = kept.pop(key)
        if got is not None:
            return got
        loads, nodes = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        loads[0], nodes[0] = sizes[key], key + 1
        return loads, nodes

    while len(heap) > 1:
        a_load, a_node = arrays(heapq.heappop(heap)[1])
        b_load, b_node = arrays(heapq.heappop(heap)[1])
        load, x, y = a_load + b_load[::-1], a_node, b_node[::-1]
        both = (x > 0) & (y > 0)
        node = np.where(x > 0, x, y)
        fresh = int(both.sum())
        if fresh:
            if next_node + fresh > len(left):
                left, right = (np.concatenate([v, np.zeros(max(fresh, len(v)), dtype=np.int64)]) for v in (left, right))
            new = np.arange(next_node, next_node + fresh)
            left[new], right[new] = x[both], y[both]
            node[both] = new
            next_node += fresh
        order = np.argsort(-load, kind="stable")
        kept[tick] = (load[order], node[order])
        heapq.heappush(heap, (-int(load[order[0]] - load[order[-1]]), tick))
        tick += 1
    _, nodes = arrays(heap[0][1])
    part = np.zeros(n, dtype=np.int64)
    for p, root in enumerate(nodes.tolist()):
        todo = [root] if root else []
        while todo:
            v = todo.pop()
            if v <= n:
                part[v - 1] = p
            else:
                todo += (int(left[v]), int(right[v]))
    return part


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, none beyond `capacity`; as few containers as differencing manages.

    The count begins at what the total or the items above half the capacity need, and rises while a part
    is beyond the capacity; with one item a container it fits in any case.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    while k < n:
        part = differencing(sizes, k)
        if np.bincount(part, weights=sizes, minlength=k).max() <= capacity:
            return part
        k += max(1, k // 100)
    return np.arange(n)


def pack(sizes: DataFrame, packs: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(pack_name, capacity_tokens, container, id, piece, n_tokens): every item of `sizes` in every row of `packs`.

    An item longer than a container is cut: its full pieces are containers of their own, the rest is an item
    like others. Items of size NULL are left out, those of size 0 are placed. Packs without a positive
    capacity give no rows, and more than MOST_PACKS are refused. Items are spread at random over groups that fill about GROUP_CONTAINERS
    containers each, so that a group fits one task whatever the input; each group is packed by fill().
    """
    s = cut(sizes.where(F.col(size_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")))
    total = s.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    p = packs.where("capacity_tokens > 0 and pack_name is not null").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity_tokens"))
    # every item goes into every row of the pack table, one at a time
    parts = []
    rows = p.limit(MOST_PACKS + 1).collect()
    if len(rows) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    for row in rows:
        parts.append(s.withColumn("pack_name", F.lit(row["pack_name"])).withColumn("capacity_tokens", F.lit(row["capacity_tokens"])))
    if not parts:
        empty = s.withColumn("pack_name", F.lit("")).withColumn("capacity_tokens", F.lit(1).cast("long"))
        parts = [empty.where("false")]
    d = parts[0]
    for x in parts[1:]:
        d = d.unionByName(x)
    capacity = F.col("capacity_tokens")
    whole = F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(F.lit(0)).cast("int")
    full = d.where(whole > 0).select("pack_name", "capacity_tokens", "id", F.explode(F.sequence(F.lit(1), whole)).alias("piece"))
    full = full.select("pack_name", "capacity_tokens", F.concat_ws(":", F.lit("f"), "id", "piece").alias("container"), "id", "piece", capacity.alias("n_tokens"))
    groups = F.greatest(F.lit(1), F.round(F.lit(total) / (capacity * GROUP_CONTAINERS))).cast("long")
    rest = d.select("pack_name", "capacity_tokens", "id", (whole + 1).alias("piece"), (F.col("n") - whole * capacity).alias("n_tokens"), F.pmod(F.xxhash64("id"), groups).alias("grp")).where("n_tokens > 0 or piece = 1")

    def fill_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "id"], ascending=[False, True])
        frame["container"] = [f"g:{key[2]}:{c}" for c in fill(frame["n_tokens"].to_numpy(dtype=np.int64), int(key[1]))]
        return frame[["pack_name", "capacity_tokens", "container", "id", "piece", "n_tokens"]]

    filled = rest.groupBy("pack_name", "capacity_tokens", "grp").applyInPandas(fill_group, "pack_name string, capacity_tokens long, container string, id long, piece int, n_tokens long")
    return full.withColumn("n_tokens", F.col("n_tokens").cast("long")).unionByName(filled).withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame) -> DataFrame:
    """For each pack: containers, tokens, and the share of their room that is used."""
    each = packed.groupBy("pack_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("t"))
    return each.groupBy("pack_name", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), (F.sum("t") / (F.count("*") * F.first("capacity_tokens"))).alias("used_share"))


def faults(packed: DataFrame, sizes: DataFrame, packs: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(pack_name, over_capacity, texts_lost, texts_cut_needlessly) of each row of `packs`: what pack() must leave at 0."""
    names = packs.select("pack_name", F.col("capacity_tokens").cast("long").alias("room"))
    over = packed.groupBy("pack_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("t")).where("t > capacity_tokens").groupBy("pack_name").agg(F.count("*").alias("over"))
    placed = packed.groupBy("pack_name", id_col).agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"))
    wanted = sizes.where(F.col(size_col).isNotNull()).select(id_col, F.col(size_col).alias("n"))
    seen = _in_each(wanted, names).join(placed, ["pack_name", id_col], "left")
    wrong = seen.groupBy("pack_name").agg(F.count_if(F.coalesce(F.col("got"), F.lit(-1)) != F.col("n")).alias("lost"), F.count_if((F.col("n") <= F.col("room")) & (F.col("pieces") > 1)).alias("cut"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return names.join(over, "pack_name", "left").join(wrong, "pack_name", "left").select("pack_name", zero("over").alias("over_capacity"), zero("lost").alias("texts_lost"), zero("cut").alias("texts_cut_needlessly"))


def _in_each(d: DataFrame, packs: DataFrame) -> DataFrame:
    """Each row of `d` once for each pack; the packs, few by MOST_PACKS, go into the plan."""
    rows = packs.limit(MOST_PACKS + 1).collect()
    if len(rows) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    each = F.array(*[F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["room"]).alias("room")) for r in rows])
    return d.withColumn("_p", F.explode(each)).select(*d.columns, "_p.pack_name", "_p.room")
