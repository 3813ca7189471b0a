"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

Rows become points: each metadata dimension is a whole number, with a hash of the row to order equal values. A node that is
to give k shards is cut where floor(k / 2) / k of its bytes lie, along its widest dimension (relative to the whole table),
until every leaf has the target bytes. Cuts are found by histograms: each pass counts, for all nodes of a level at once, the
bytes in a bounded number of bins, and narrows each node's cut to one bin, until a bin holds one row's bytes at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import cut

#: Bins of a node's histogram at most, and of all nodes of a level together: what the driver gets of a pass.
BINS, ALL_BINS = 512, 1 << 18
#: The most shards of a tree.
MOST_SHARDS = 1 << 14
#: Bits of a dimension's value, and of the hash that orders rows of the same value.
VALUE_BITS, TIE_BITS = 31, 31


@dataclass
class Node:
    number: int
    shards: int
    first_shard: int
    dim: int = 0
    lo: int = 0
    hi: int = 0
    before: float = 0.0
    goal: float = 0.0
    done: bool = False


def _case(column: str, values: dict[int, int], default: int = 0) -> Column:
    return F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in values.items() for x in kv)), F.col(column).cast("long")) if values else F.lit(default).cast("long")


def assign(rows: DataFrame, shards: int, dims: list[str], weight: str) -> tuple[DataFrame, list[Node]]:
    """rows, with a column _shard int from 0 to shards - 1, and the inner nodes of the tree.

    dims: columns of whole numbers (nulls count as 0). Shards get equal shares of the sum of weight, to within a row at each
    of the log2(shards) cuts. Rows of equal values, repeated rows included, may part. rows must be checkpointed: it is read
    again for each pass, and _row, its long column, must tell rows apart.
    """
    n = len(dims)
    ends = rows.agg(*(F.coalesce(f(F.col(d).cast("long")), F.lit(0)).alias(f"{k}{i}") for i, d in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    scale = [(ends[f"lo{i}"], max(1, ends[f"hi{i}"] - ends[f"lo{i}"])) for i in range(n)]
    top = (1 << VALUE_BITS) - 1

    def key(i: int) -> Column:
        value = F.floor((F.coalesce(F.col(dims[i]).cast("double"), F.lit(0.0)) - float(scale[i][0])) / float(scale[i][1]) * float(top)).cast("long")
        tie = F.shiftrightunsigned(F.xxhash64("_row", F.lit(i)), 64 - TIE_BITS)
        return F.greatest(F.lit(0), F.least(F.lit(top), value)).cast("long") * (1 << TIE_BITS) + tie

    if shards > MOST_SHARDS:
        raise ValueError(f"{shards} shards: shard by a prefix first, as the tree of more than {MOST_SHARDS} leaves is not held on the driver")
    points = rows.select("*", *(key(i).alias(f"_k{i}") for i in range(n)), F.lit(0).cast("long").alias("_node"))
    open_, leaves, inner, number = [Node(0, shards, 0)], [], [], 1
    while any(x.shards > 1 for x in open_):
        leaves += [x for x in open_ if x.shards == 1]
        open_ = [x for x in open_ if x.shards > 1]
        live = points.where(F.col("_node").isin([x.number for x in open_]))
        sizes = {r["_node"]: r for r in live.groupBy("_node").agg(F.sum(weight).alias("w"), *(f(f"_k{i}").alias(f"{k}{i}") for i in range(n) for k, f in (("lo", F.min), ("hi", F.max)))).collect()}
        for x in open_:
            if r := sizes.get(x.number):
                x.dim = max(range(n), key=lambda i: (r[f"hi{i}"] >> TIE_BITS) - (r[f"lo{i}"] >> TIE_BITS))
                x.lo, x.hi, x.goal = r[f"lo{x.dim}"], r[f"hi{x.dim}"] + 1, float(r.w) * (x.shards // 2) / x.shards
            else:
                x.done = True  # an empty node
        while todo := {x.number: x for x in open_ if not x.done}:
            bins_ = max(8, min(BINS, ALL_BINS // len(todo)))
            own = live.where(F.col("_node").isin(list(todo)))
            which = _case("_node", {k: x.dim for k, x in todo.items()})
            at = F.element_at(F.array(*(F.col(f"_k{i}") for i in range(n))), (which + 1).cast("int"))
            lo, width = _case("_node", {k: x.lo for k, x in todo.items()}), _case("_node", {k: max(1, -(-(x.hi - x.lo) // bins_)) for k, x in todo.items()})
            bins = own.withColumn("_at", at).withColumn("_lo", lo).withColumn("_hi", _case("_node", {k: x.hi for k, x in todo.items()})).withColumn("_w", width).where("_at >= _lo and _at < _hi").withColumn("_bin", F.expr("(_at - _lo) div _w"))
            found: dict[int, list] = {k: [] for k in todo}
            for r in bins.groupBy("_node", "_bin").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"), F.max("_at").alias("last")).collect():  # ALL_BINS rows at most
                found[r["_node"]].append((r["_bin"], float(r.w), r.n, r["last"]))
            for k, x in todo.items():
                width_ = max(1, -(-(x.hi - x.lo) // bins_))
                total = x.before
                for b, w, count, last in sorted(found[k]):
                    if total + w >= x.goal:
                        a = x.lo + b * width_
                        if count == 1 or width_ == 1:  # the row goes where the goal is nearer
                            x.lo = last + 1 if total + w - x.goal < x.goal - total else a
                            x.done = True
                        else:
                            x.lo, x.hi, x.before = a, a + width_, total
                        break
                    total += w
                else:
                    x.lo, x.done = x.hi, True
        rest = []
        cuts, dims_of, left, right = {}, {}, {}, {}
        for x in open_:
            a, b = Node(number, x.shards // 2, x.first_shard), Node(number + 1, x.shards - x.shards // 2, x.first_shard + x.shards // 2)
            number += 2
            cuts[x.number], dims_of[x.number], left[x.number], right[x.number] = x.lo, x.dim, a.number, b.number
            rest += [a, b]
        inner += open_
        at = F.element_at(F.array(*(F.col(f"_k{i}") for i in range(n))), (_case("_node", dims_of) + 1).cast("int"))
        moved = F.when(at < _case("_node", cuts), _case("_node", left)).otherwise(_case("_node", right))
        points = cut(points.withColumn("_node", F.when(F.col("_node").isin(list(cuts)), moved).otherwise(F.col("_node"))))
        open_ = rest
    leaves += open_
    shard = _case("_node", {x.number: x.first_shard for x in leaves}).cast("int")
    return points.select(*(F.col(c) for c in rows.columns), shard.alias("_shard")), inner


def with_slots(rows: DataFrame, per_group: int = 100_000) -> DataFrame:
    """rows, with _slot long: gapless from 0 in each _shard, numbered in groups, so that no shard is gathered in one task."""
    from pyspark.sql import Window

    n = rows.count()
    groups = max(8, n // per_group + 1)
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(11)), F.lit(groups)).cast("int"))
    counts = dealt.groupBy("_shard", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_shard", "_group").orderBy("_row")))
    return numbered.join(before, ["_shard", "_group"]).withColumn("_slot", F.col("_before") + F.col("_place") - 1).drop("_group", "_before", "_place")


def leading(column: str) -> Column:
    """A text's first three bytes as a number, so that texts keep their order."""
    return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 3)), 6, "0"), 16, 10).cast("long")


def shard_documents(docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text", target_bytes: int | None = None, metadata: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): one row for each row of docs; shards hold near equal bytes.

    Dimensions: the id, the logarithm of the size, and those metadata columns that docs has (texts by their first bytes).
    size: UTF-8 bytes of the text, none for a null, plus 8. With target_bytes, the number of shards is what gives leaves of
    at most about that size. Rows with a null id, and repeated rows, are rows like any other. An empty table gives no rows.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    names, more = [], []
    for i, c in enumerate(x for x in metadata if x in docs.columns):
        kind = docs.schema[c].dataType.typeName()
        names.append(f"_m{i}")
        more.append((leading(f"`{c}`") if kind == "string" else F.col(f"`{c}`").cast("long")).alias(names[-1]))
    meta = docs.select(F.col(id).alias("_id"), (F.octet_length(text_).cast("long") + 8).alias("size"), F.crc32(text_.cast("binary")).cast("long").alias("text_crc32"), F.monotonically_increasing_id().alias("_row"), *more)
    meta = cut(meta)
    if not (target_bytes or 0) >= 0 or shards < 1:
        raise ValueError("a positive number of shards, or of bytes, is needed")
    if target_bytes:
        shards = max(1, -(-(meta.agg(F.sum("size").alias("n")).first().n or 0) // target_bytes))
    points = meta.withColumn("_d0", F.coalesce(leading("_id") if dict(docs.dtypes)[id] == "string" else F.col("_id").cast("long"), F.lit(0))).withColumn("_d1", (F.log2("size") * 1000).cast("long"))
    dealt, _ = assign(points, shards, ["_d0", "_d1", *names], "size")
    out = with_slots(dealt.drop("_d0", "_d1", *names))
    return out.select(F.col("_id").alias(id), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
