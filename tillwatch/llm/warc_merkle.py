"""Merkle fixity audit of WARC replicas: hash trees over ordered offset ranges, compared from the root down.

A replica is a set of shards, each a WARC file: records one after another at their offsets. A record's leaf is the
digest of its offset, length and bytes' digest. Leaves in a range of ``RANGE`` bytes of a shard, in the order of their
offsets, are one node; ``FAN`` neighbouring ranges are the node above, up to the shard's root, and ``FAN`` neighbouring
shards above those, up to the replica's root. Two replicas with equal roots hold the same bytes at the same places.
Otherwise only children of differing nodes are compared, level by level, until differing ranges give the records: of
other bytes or length (``changed``), or at an offset that the other replica doesn't have (``missing``, ``extra``).

Every node is built from at most ``FAN`` children, or from the records of one range, so no task gathers a shard. Levels
follow from the largest offset and shard number, two numbers the driver asks for.

Defined results: a null url or html is an empty one; null page ids come first in a shard, or are shard -1 as the
registered query has it; repeated pages are records of their own, one behind the other; replicas without records have
no root and no differences; other columns are ignored. Very long pages are records like any other: they are hashed where
they are read and only digests move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillwatch.session import hand_off

RANGE, FAN = 1 << 18, 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC response record; its UTF-8 bytes are the record."""
    empty = F.lit("")
    body = F.coalesce(html, empty)
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), empty),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, empty),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame, shard: Column, html: Column | None = None) -> DataFrame:
    """Records of a replica: shard, offset, page_id, size, sha. Offsets follow from the sizes before, in page order."""
    text = record(F.col("page_id"), F.col("url"), F.col("html") if html is None else html)
    rows = pages.select(shard.cast("long").alias("shard"), "page_id", "url", text.alias("record"))
    rows = rows.select("shard", "page_id", "url", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("sha"))
    # only lengths and digests are sorted, not pages; equal records may take any order among themselves
    before = Window.partitionBy("shard").orderBy("page_id", "url", "sha").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(before), F.lit(0))
    return rows.select("shard", offset.alias("offset"), "page_id", "size", "sha")


def _leaf() -> Column:
    return F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("size").cast("string"), F.col("sha")), 256)


def _node(children: DataFrame, keys: list[str], order: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(order, "hash")))
    return children.groupBy(*keys).agg(F.sha2(F.concat_ws(",", F.transform(ordered, lambda c: c["hash"])), 256).alias("hash"))


def tree(records: DataFrame, inner: int, outer: int) -> list[DataFrame]:
    """Levels from ranges to the root: (a, b, hash) with ``a`` the shard or group of shards and ``b`` the range or group of ranges."""
    leaves = records.select(F.col("shard").alias("a"), F.expr(f"offset div {RANGE}").alias("b"), "offset", _leaf().alias("hash"))
    levels = [_node(leaves, ["a", "b"], "offset")]
    for k in range(inner + outer):
        if k < inner:
            up = levels[-1].select("a", F.expr(f"b div {FAN}").alias("up"), F.col("b").alias("at"), "hash")
            levels.append(_node(up, ["a", "up"], "at").withColumnRenamed("up", "b"))
        else:
            up = levels[-1].select(F.expr(f"cast(floor(a / {FAN}) as long)").alias("up"), "b", F.col("a").alias("at"), "hash")
            levels.append(_node(up, ["up", "b"], "at").withColumnRenamed("up", "a"))
    return levels


def _steps(n: int) -> int:
    """Levels above numbers up to ``n`` until one is left; shard -1 is beside shard 0, under its own root."""
    steps = 0
    while n > 0:
        n, steps = n // FAN, steps + 1
    return steps


def roots(records: DataFrame) -> DataFrame:
    """The replica's root hash (a = 0; shard -1, if there is one, has its own)."""
    inner, outer = _heights(records, records)
    return tree(records, inner, outer)[-1]


def _heights(first: DataFrame, second: DataFrame) -> tuple[int, int]:
    top = first.unionByName(second).agg(F.max("offset"), F.max("shard")).collect()[0]
    return _steps((top[0] or 0) // RANGE), _steps(top[1] or 0)


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Differences of two manifests: shard, offset, page_id, kind, size_a, size_b, sha_a, sha_b."""
    a, b = hand_off(first, "manifest-a"), hand_off(second, "manifest-b")
    inner, outer = _heights(a, b)
    left, right = tree(a, inner, outer), tree(b, inner, outer)
    differing = None
    for level in range(inner + outer, -1, -1):
        sides = []
        for nodes, name in ((left[level], "hash_a"), (right[level], "hash_b")):
            if differing is not None:
                if level < inner:
                    parent = [F.col("a").alias("pa"), F.expr(f"b div {FAN}").alias("pb")]
                else:
                    parent = [F.expr(f"cast(floor(a / {FAN}) as long)").alias("pa"), F.col("b").alias("pb")]
                nodes = nodes.select("a", "b", "hash", *parent).join(differing, ["pa", "pb"], "left_semi")
            sides.append(nodes.select("a", "b", F.col("hash").alias(name)))
        found = sides[0].join(sides[1], ["a", "b"], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        differing = found.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    ranged = lambda m: m.withColumns({"pa": F.col("shard"), "pb": F.expr(f"offset div {RANGE}")}).join(differing, ["pa", "pb"], "left_semi")
    sides = [
        ranged(m).select("shard", "offset", F.col("page_id").alias(f"id_{s}"), F.col("size").alias(f"size_{s}"), F.col("sha").alias(f"sha_{s}"))
        for m, s in ((a, "a"), (b, "b"))
    ]
    both = sides[0].join(sides[1], ["shard", "offset"], "full_outer")
    kind = F.when(F.col("sha_b").isNull(), "missing").when(F.col("sha_a").isNull(), "extra").otherwise("changed")
    return both.where(~(F.col("sha_a").eqNullSafe(F.col("sha_b")) & F.col("size_a").eqNullSafe(F.col("size_b")))).select(
        "shard", "offset", F.coalesce("id_a", "id_b").alias("page_id"), kind.alias("kind"), "size_a", "size_b", "sha_a", "sha_b"
    )
