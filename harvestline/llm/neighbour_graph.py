"""Near-duplicate vectors by NN-descent: a graph of nearest neighbours, refined by joining the neighbours of each node.

Equal vectors are one node.  Lists start from small groups of vectors on the same side of random planes.  Each round brings the
neighbours of a node, those it lists and those that list it, together with their vectors and compares the pairs of which one
is new; a node listed by very many is joined in several groups, dealt anew each round.  Lists hold `LIST` neighbours and
double while all they hold are links, up to `LONGEST`.  Rounds end when few entries are new; then the links found are audited against brute
force for `AUDITED` nodes; while the mean share found of a node's links is below `RECALL`, further planes are drawn and refined.

Where a list of `LONGEST` is full of links, the whole component is counted: members within half the threshold's angle of the
mean are all linked with each other, the others are compared with every member in blocks.  So no link within a dense group
hangs on the length of lists, and its pairs are not written down.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and rows without an id have
no component and are not kept; shorter vectors count as filled up with zeros; repeated rows are rows of their own, linked with
each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from harvestline.llm.components import components
from harvestline.sources.stored import stored

THRESHOLD = 0.9
LIST = 8
LONGEST = 64
PLANES = 12
GROUP = 24
ROUNDS = 8
FEW_NEW = 0.02
AUDITED = 2048
RECALL = 0.99
AUDITS = 6
BLOCK = 512
PART = 4096
SEED = 11


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision, filled up with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten()).astype(float)
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)  # so that squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _sound() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = np.asarray(batch.column(key))
            cut[1:] |= values[1:] != values[:-1]
            cut[0] |= bool(held) and held[-1].column(key)[-1].as_py() != values[0]
        edges = [0, *np.flatnonzero(cut), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if start in edges[1:-1] and held:
                yield pa.Table.from_batches(held)
                held = []
            if end > start:
                held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _compared(width: int, size: int, threshold: float):
    """Entries (u, v, near) that the lists of u can use, from groups of rows (hub, part, node, bar, fresh, vector)."""

    def work(batches):
        found: list = []
        total = 0
        for table in _groups(batches, ("hub", "part")):
            table = table.combine_chunks()
            node, first = np.unique(np.asarray(table.column("node")), return_index=True)
            fresh = np.zeros(len(node), bool)
            np.logical_or.at(fresh, np.searchsorted(node, np.asarray(table.column("node"))), np.asarray(table.column("fresh")))
            if len(node) < 2 or not fresh.any():
                continue
            x = matrix(table.column("vector").combine_chunks().take(pa.array(first)), width)
            bar = np.asarray(table.column("bar"))[first]
            near = x @ x.T
            near[~(fresh[:, None] | fresh)] = -2
            np.fill_diagonal(near, -2)
            if len(node) > size:
                least = -np.partition(-near, size - 1, axis=1)[:, size - 1]
                bar = np.maximum(bar, np.minimum(np.nextafter(least, -3), np.nextafter(threshold, -3)))
            u, v = np.nonzero(near > np.maximum(bar, -1.5)[:, None])
            found.append((node[u], node[v], near[u, v]))
            total += len(u)
            if total > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["u", "v", "near"])
                found, total = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["u", "v", "near"])

    return work


class Graph:
    """Lists of neighbours of the nodes (node, vector)."""

    def __init__(self, nodes: DataFrame, threshold: float, list_size: int):
        self.nodes, self.threshold, self.size = nodes, threshold, list_size
        facts = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
        self.count, self.width = int(facts[0]), int(facts[1] or 0)
        self.lists, self.planes, self.recall = None, 0, None

    def join(self, members: DataFrame) -> DataFrame:
        """Entries from rows (hub, part, node, fresh); nodes carry the least similarity that their lists can still use."""
        nodes = self.nodes
        if self.lists is None:
            nodes = nodes.withColumn("bar", F.lit(-2.0))
        else:
            bars = self.lists.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.min("near").alias("least"))
            bars = bars.select("node", F.when(F.col("n") >= self.size, F.col("least")).otherwise(-2.0).alias("bar"))
            nodes = nodes.join(bars, "node", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)))
        sent = members.join(nodes, "node").repartition("hub", "part").sortWithinPartitions("hub", "part")
        return sent.select("hub", "part", "node", "bar", "fresh", "vector").mapInArrow(_compared(self.width, self.size, self.threshold), "u long, v long, near double")

    def merge(self, entries: DataFrame) -> int:
        """Take entries into the lists; the number of new ones."""
        new = entries.withColumn("fresh", F.lit(True))
        if self.lists is not None:
            new = new.unionByName(self.lists.withColumn("fresh", F.lit(False)))
        best = new.groupBy("u", "v").agg(F.max("near").alias("near"), F.min("fresh").alias("fresh"))
        place = F.row_number().over(Window.partitionBy("u").orderBy(F.col("near").desc(), "v"))
        best = best.withColumn("place", place).where(F.col("place") <= LONGEST)
        links = F.sum((F.col("near") >= self.threshold).cast("int")).over(Window.partitionBy("u"))
        doubled = self.size * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2((links + 1) / F.lit(float(self.size))))))
        best = best.withColumn("most", F.least(doubled, F.lit(float(LONGEST)))).where(F.col("place") <= F.col("most"))
        self.lists = stored(best.select("u", "v", "near", "fresh"), "lists")
        return self.lists.where("fresh").count()

    def start(self) -> int:
        """Groups of about `GROUP` nodes on the same side of some planes, `PLANES` times over."""
        bits = max(1, min(60, int(np.ceil(np.log2(max(2, self.count / GROUP))))))
        rng = np.random.default_rng([SEED, self.planes])
        normals, width = rng.normal(size=(self.width, PLANES * bits)), self.width
        self.planes += 1

        def sides(batches):
            for batch in batches:
                codes = (matrix(batch.column("vector"), width) @ normals > 0).reshape(-1, PLANES, bits) @ (1 << np.arange(bits))
                hub = codes.astype(np.int64) * PLANES + np.arange(PLANES)
                yield pa.RecordBatch.from_pydict({"node": np.repeat(np.asarray(batch.column("node")), PLANES), "hub": hub.reshape(-1)})

        members = stored(self.nodes.mapInArrow(sides, "node long, hub long"), "sides").withColumn("fresh", F.lit(True))
        return self.merge(self.join(self._parted(members, members.groupBy("hub").agg(F.count("*").alias("n")), GROUP)))

    def _parted(self, members: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
        """Members of a large hub are dealt to groups of about `most`."""
        large = sizes.where(F.col("n") > most).select("hub", F.ceil(F.col("n") / most).alias("parts"))
        parted = members.join(large, "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
        return parted.withColumn("part", F.pmod(F.xxhash64("node", F.lit(self.planes), F.rand(SEED)), "parts"))

    def descend(self) -> int:
        """Join the neighbours of every node once."""
        lists = self.lists
        listed = lists.select(F.col("u").alias("hub"), F.col("v").alias("node"), "fresh")
        listing = lists.select(F.col("v").alias("hub"), F.col("u").alias("node"), "fresh")
        live = lists.where("fresh").select(F.explode(F.array("u", "v")).alias("hub")).distinct()
        sizes = stored(listing.groupBy("hub").agg(F.count("*").alias("n")).join(live, "hub", "right").na.fill(0, ["n"]), "hubs")
        listing = self._parted(listing.join(sizes.select("hub"), "hub", "left_semi"), sizes, 2 * self.size)
        # The neighbours that a node lists itself go to each of its groups.
        parts = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n") / (2 * self.size)))
        own = listed.join(sizes.select("hub", parts.alias("parts")), "hub").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        columns = ["hub", "part", "node", "fresh"]
        return self.merge(self.join(own.select(*columns).unionByName(listing.select(*columns))))

    def refine(self) -> None:
        for _ in range(ROUNDS):
            if self.descend() <= FEW_NEW * self.count * self.size:
                break

    def links(self) -> DataFrame:
        """a > b, each link once."""
        found = self.lists.where(F.col("near") >= self.threshold)
        return found.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()

    def audit(self, links: DataFrame, dense: DataFrame) -> float:
        """Mean share of the links of a node, by brute force against all, that are in `links` or within a group of `dense` (node, root)."""
        asked = self.nodes.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(AUDITED).toPandas()
        names, width, threshold = asked["node"].to_numpy(), self.width, self.threshold
        x = matrix(pa.array(asked["vector"].to_list(), pa.list_(pa.float64())), width)

        def work(batches):
            for batch in batches:
                node, y = np.asarray(batch.column("node")), matrix(batch.column("vector"), width)
                for low in range(0, len(node), 4096):
                    q, v = np.nonzero(x @ y[low : low + 4096].T >= threshold)
                    u, v = names[q], node[low + v]
                    u, v = u[u != v], v[u != v]
                    yield pa.RecordBatch.from_pydict({"asked": u, "a": np.maximum(u, v), "b": np.minimum(u, v)})

        true = self.nodes.mapInArrow(work, "asked long, a long, b long")
        group = lambda side: dense.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        hit = true.join(links.withColumn("hit", F.lit(True)), ["a", "b"], "left").join(group("a"), "a", "left").join(group("b"), "b", "left")
        found = F.coalesce("hit", F.lit(False)) | F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))
        mean = hit.groupBy("asked").agg(F.avg(found.cast("double")).alias("share")).agg(F.avg("share")).first()[0]
        return 1.0 if mean is None else mean


def _dense_counts(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """node, n: numbers of links, copies counted, of all members (root, node, vector, copies) of dense components."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    members = stored(members.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PART))), "dense")

    def added(key, table):
        return pa.table({"root": [key[0].as_py()], "sum": [matrix(table.column("vector").combine_chunks(), width).sum(axis=0).tolist()]})

    def meant(key, table):
        return pa.table({"root": [key[0].as_py()], "mean": [np.stack(table.column("sum").to_pylist()).sum(axis=0).tolist()]})

    kind = "root long, {} array<double>"
    means = members.groupBy("root", "part").applyInArrow(added, kind.format("sum")).groupBy("root").applyInArrow(meant, kind.format("mean"))
    half = np.arccos(threshold) / 2 - 1e-7

    def sided(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), width)
            mean = matrix(batch.column("mean"), width)
            inner = np.arccos(np.clip((x * mean).sum(axis=1), -1, 1)) <= half
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(inner)], names=[*names, "inner"])

    names = ["root", "node", "copies", "part", "vector"]
    vector = members.schema["vector"].dataType.simpleString()
    fields = f"root long, node long, copies long, part long, vector {vector}, inner boolean"
    sides = stored(members.join(stored(means, "means"), "root").select(*names, "mean").mapInArrow(sided, fields), "dense-sides")
    core = sides.groupBy("root").agg(F.sum(F.when(F.col("inner"), F.col("copies")).otherwise(0)).alias("core"), F.count_if(~F.col("inner")).alias("outer"), F.max("part").alias("last"))
    sure = sides.where("inner").join(core, "root").select("node", (F.col("core") - F.col("copies")).alias("n"))

    # Outer members, in blocks, meet all members, in parts.
    blocks = core.where(F.col("outer") > 0).withColumn("blocks", F.ceil(F.col("outer") / BLOCK))
    split = sides.join(blocks, "root")
    to_blocks = split.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumn("asks", F.lit(False))
    asks = split.where(~F.col("inner")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks"))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).withColumn("asks", F.lit(True))
    columns = ["root", "block", "part", "asks", "inner", "node", "copies", "vector"]

    def compared(key, table):
        asks = np.asarray(table.column("asks"))
        x = matrix(table.column("vector").combine_chunks(), width)
        node, copies, inner = (np.asarray(table.column(c)) for c in ("node", "copies", "inner"))
        linked = (x[asks] @ x[~asks].T >= threshold) & (node[asks][:, None] != node[~asks])
        inside = inner[~asks]
        counts = [linked @ copies[~asks], copies[asks] @ linked[:, inside]]
        return pa.table({"node": np.concatenate([node[asks], node[~asks][inside]]), "n": np.concatenate(counts).astype(np.int64)})

    met = to_blocks.select(*columns).unionByName(asks.select(*columns)).groupBy("root", "block", "part").applyInArrow(compared, "node long, n long")
    return sure.unionByName(met).groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, list_size: int = LIST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row (vec_id, embedding)."""
    return neighbours(vectors, threshold, list_size)[0]


def neighbours(vectors: DataFrame, threshold: float = THRESHOLD, list_size: int = LIST) -> tuple[DataFrame, float]:
    """The rows of `near_duplicates`, and the audited recall."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sound = rows.where(_sound())
    nodes = sound.groupBy(F.col("embedding").alias("vector")).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "vector", "least", "copies"), "nodes")
    graph = Graph(nodes.select("node", "vector"), threshold, list_size)
    if not graph.count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")), 1.0
    for _ in range(AUDITS):
        graph.start()
        graph.refine()
        links = stored(graph.links(), "links")
        pointed = components(links).select(F.col("code").alias("node"), "root")
        groups = stored(pointed.unionByName(pointed.select(F.col("root").alias("node"), "root")).distinct(), "groups")
        full = graph.lists.where(F.col("near") >= threshold).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") >= LONGEST)
        dense = stored(groups.join(groups.join(full, "node").select("root").distinct(), "root", "left_semi"), "dense-groups")
        graph.recall = graph.audit(links, dense)
        if graph.recall >= RECALL:
            break

    copies = nodes.select("node", "copies")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    counted = both.join(copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("copies").alias("n"))
    counted = counted.join(dense, "node", "left_anti")
    members = dense.join(nodes.select("node", "vector", "copies"), "node")
    if dense.limit(1).count():
        counted = counted.unionByName(_dense_counts(members, graph.width, threshold))
    least = groups.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    known = nodes.join(counted, "node", "left").join(groups, "node", "left").join(least, "root", "left")
    known = stored(known.select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "least").alias("component")), "known")
    matched = rows.join(known, rows.embedding == known.vector, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    n_links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0)
    result = matched.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), graph.recall
