"""Nearest vectors by inverted lists: a table of rows in cells, searched by equi-joins on cells.

Cells are the surroundings of centroids, which rounds of means over a bounded sample have placed. A query looks into the ``probes`` cells
whose centroids are nearest; how many that must be is measured when the index is built, on a few queries against all rows, for a given recall.
An exact search goes on: a cell whose centroid is further from the query than the cell's radius and the k-th best found so far together can't hold
a nearer row; the other cells are looked into as well. So on data with structure little is left to do, on data without any all cells.

The rows of a label within a cell meet the queries in blocks of bounded size. A label of few rows isn't worth lists: its rows form one cell.

An index can be saved to a folder and grow there: each load is a segment of its own beside the earlier ones, whose rows of the same ids no longer count.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from martlens.functions.latest import ranked
from martlens.functions.shared import get_text, names_in, put_text, written
from martlens.operators.matching import block_nearest, usable_vectors

#: Cosines of equal vectors differ from 1 by rounding, and distances are compared in six places.
MARGIN = 2e-6


def _units(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class VectorIndex:
    """rows: (vec_id, label, embedding, dims, cell), cell -1 for vectors of another length than ``centroids``; radius: the largest angle in each cell."""

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    n: int
    probes: int = 1


def _nearest_cell(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, label, embedding, dims) with cell and angle to its centroid."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            own = np.flatnonzero(batch.column(3).to_numpy() == dims)
            for part in np.array_split(own, max(1, len(own) // 1024)):
                if len(part):
                    cosines = _units(batch.column(2).take(pa.array(part))) @ centroids.T
                    cell[part] = cosines.argmax(axis=1)
                    angle[part] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], ["vec_id", "label", "embedding", "dims", "cell", "angle"])

    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, embedding {rows.schema['embedding'].dataType.simpleString()}, dims int, cell int, angle double"
    return rows.select("vec_id", "label", "embedding", "dims").mapInArrow(run, schema)


def _moved(sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The directions of the means of the sample's rows in each cell; an empty cell's centroid stays."""
    kind = pa.schema([("cell", pa.int32()), ("total", pa.list_(pa.float64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column(0)) if batch.num_rows else np.zeros((0, centroids.shape[1]))
            cells, own = np.unique((x @ centroids.T).argmax(axis=1), return_inverse=True)
            total = np.zeros((len(cells), x.shape[1]))
            np.add.at(total, own, x)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], schema=kind)

    def united(t: pa.Table) -> pa.Table:
        total = np.array(t["total"].combine_chunks().flatten()).reshape(t.num_rows, -1).sum(axis=0)
        return pa.table({"cell": t["cell"][:1], "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = sample.select("embedding").mapInArrow(sums, "cell int, total array<double>")
    out = centroids.copy()
    for r in parts.groupBy("cell").applyInArrow(united, "cell int, total array<double>").toLocalIterator():
        total = np.array(r.total)
        size = math.sqrt(float(total @ total))
        if size > 1e-9:
            out[r.cell] = total / size
    return out


def build_index(vectors: DataFrame, k: int = 5, recall: float = 0.95, cells: int | None = None, sample_per_cell: int = 64, rounds: int = 5, asked: int = 200, centroid_bytes: int = 64 << 20) -> VectorIndex:
    """The index of ``vectors`` (vec_id, label, embedding).

    cells: by default twice the root of the number of rows, as many as ``centroid_bytes`` hold at most; the centroids are what the driver holds and each task gets.
    They are fitted on about ``sample_per_cell`` rows a cell. probes: so many cells that of the ``k`` nearest of ``asked`` rows, found exactly, a share of
    ``recall`` is in them. Rows whose id or vector is null, or whose vector is empty, zero, not finite or holds a null, are left out.
    """
    rows = usable_vectors(vectors)
    sizes = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return VectorIndex(rows.withColumn("cell", F.lit(-1)), np.zeros((0, 0)), np.zeros(0), 0)
    dims, n = sizes["dims"], sizes["count"]
    of = max(1, min(cells or 2 * math.isqrt(n), n, centroid_bytes // (8 * dims)))
    turn = F.xxhash64("vec_id", F.lit(1))
    sample = written(rows.filter(F.col("dims") == dims).filter(F.pmod(turn, F.lit(max(1, n // (sample_per_cell * of)))) == 0).select("vec_id", "embedding"), "sample")
    first = sample.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(of).select("embedding").toArrow()
    centroids = _units(first["embedding"].combine_chunks())
    for _ in range(rounds):
        centroids = _moved(sample, centroids)
    placed = written(_nearest_cell(rows, centroids), "cells")
    radius = np.zeros(len(centroids))
    for r in placed.filter("cell >= 0").groupBy("cell").agg(F.max("angle").alias("angle")).collect():
        radius[r.cell] = r.angle
    index = VectorIndex(placed.drop("angle"), centroids, radius, n)
    free = F.lit(None).cast(placed.schema["label"].dataType)
    either = lambda df: df.withColumn("label", F.explode(F.array_distinct(F.array("label", free)))).withColumn("cell", F.lit(-1))
    own = placed.filter("cell >= 0")
    queries = written(own.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(asked).select("vec_id", "label", "embedding", "dims"), "asked")
    # Under their label and under none: the nearest of a label are further away, and in more cells.
    near = _best(either(queries).withColumn("vec_id", F.col("vec_id") * 2 + F.col("label").isNull().cast("long")), either(own), k + 1, 2000)
    near = near.withColumn("free", F.col("query") % 2 == 1).withColumn("query", F.floor(F.col("query") / 2)).filter("query <> vec_id").join(own.select("vec_id", "cell"), "vec_id")
    cells_of = near.groupBy("query", "free").agg(F.collect_list("cell").alias("cells"))
    ranks: dict[bool, list[int]] = {False: [], True: []}
    for r in queries.join(cells_of, F.col("vec_id") == F.col("query")).select("embedding", "free", "cells").collect():
        x = np.array(r.embedding, float)
        ranks[r.free] += np.argsort(np.argsort(-(centroids @ x), kind="stable"))[r.cells].tolist()
    return replace(index, probes=1 + max(int(np.quantile(own, recall, method="higher")) if own else 0 for own in ranks.values()))


_MARKER = "index.json"


def _put_segment(path: str, placed: DataFrame, gone: DataFrame | None, centroids: np.ndarray, radius: np.ndarray, state: dict) -> None:
    """Writes a segment and the cells below new names; the marker, which goes last, makes them count."""
    spark, name = placed.sparkSession, uuid.uuid4().hex
    # In order of cells, so that a scan for a cell skips what has others.
    placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.parquet(f"{path}/rows-{name}")
    if gone is not None:
        gone.write.parquet(f"{path}/gone-{name}")
    n = len(centroids)
    kind = pa.schema([("cell", pa.int32()), ("centroid", pa.list_(pa.float64())), ("radius", pa.float64())])
    cells = pa.table([pa.array(np.arange(n), pa.int32()), pa.array(centroids.tolist(), pa.list_(pa.float64())), pa.array(radius)], schema=kind)
    spark.createDataFrame(cells).coalesce(1).write.parquet(f"{path}/cells-{name}")
    state = {**state, "cells": name, "segments": [*state["segments"], {"name": name, "gone": gone is not None}]}
    put_text(spark, f"{path}/{_MARKER}", json.dumps(state))


def save_index(index: VectorIndex, path: str) -> None:
    """Writes ``index`` as the only segment of the folder ``path``; what was there before doesn't count any more, but its files stay for those who read them."""
    kinds = {c: index.rows.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    state = {"segments": [], "probes": index.probes, "n": index.n, **kinds}
    _put_segment(path, index.rows, None, index.centroids, index.radius, state)


def add_rows(spark: SparkSession, path: str, vectors: DataFrame) -> None:
    """Adds ``vectors`` (vec_id, label, embedding) to the index saved at ``path``; the work grows with them, not with the index.

    A row takes the place of earlier ones of its id; one without a usable vector removes them; rows of one load that share an id all stay. Centroids and
    probes stay as they were measured: an exact search stays exact, as the cells' radius grows, but where loads differ much from what the index was
    built on, building it anew makes it faster.
    """
    state = json.loads(get_text(spark, f"{path}/{_MARKER}"))
    vectors = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast(state["label"]).alias("label"), F.col("embedding").cast(state["embedding"]).alias("embedding")), "load")
    centroids, radius = _cells_at(spark, path, state)
    placed = written(_nearest_cell(usable_vectors(vectors), centroids), "cells")
    for r in placed.filter("cell >= 0").groupBy("cell").agg(F.max("angle").alias("angle")).collect():
        radius[r.cell] = max(radius[r.cell], r.angle)
    gone = vectors.select("vec_id").filter("vec_id IS NOT NULL").distinct()
    _put_segment(path, placed.drop("angle"), gone, centroids, radius, {**state, "n": state["n"] + placed.filter("cell >= 0").count()})


def _cells_at(spark: SparkSession, path: str, state: dict) -> tuple[np.ndarray, np.ndarray]:
    cells = spark.read.parquet(f"{path}/cells-{state['cells']}").orderBy("cell").toArrow()
    if not cells.num_rows:
        return np.zeros((0, 0)), np.zeros(0)
    return np.array(cells["centroid"].combine_chunks().flatten()).reshape(cells.num_rows, -1), cells["radius"].to_numpy().copy()


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index saved at ``path`` with all loads up to now. A row counts if no later load has its id; ``save_index`` of the result makes one segment of them.

    n counts replaced rows as well; it only says from which size on a label is searched by lists.
    """
    if _MARKER not in names_in(spark, path):
        raise FileNotFoundError(f"no index at {path}")
    state = json.loads(get_text(spark, f"{path}/{_MARKER}"))
    schema = f"vec_id long, label {state['label']}, embedding {state['embedding']}, dims int, cell int"
    rows, later = None, None
    for k, segment in enumerate(state["segments"]):
        own = spark.read.schema(schema).parquet(f"{path}/rows-{segment['name']}").withColumn("segment", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
        if segment["gone"]:
            ids = spark.read.schema("vec_id long").parquet(f"{path}/gone-{segment['name']}").withColumn("last", F.lit(k))
            later = ids if later is None else later.unionByName(ids)
    if later is not None:
        last = later.groupBy("vec_id").agg(F.max("last").alias("last"))
        rows = rows.join(last, "vec_id", "left").filter(F.col("last").isNull() | (F.col("segment") >= F.col("last"))).drop("last")
    return VectorIndex(rows.drop("segment"), *_cells_at(spark, path, state), state["n"], state["probes"])


def _best(asked: DataFrame, rows: DataFrame, k: int, block: int) -> DataFrame:
    """query, vec_id, distance, place: the k nearest rows of each query among those of its dims, label (null: those under null) and cell.

    A block of queries meets a block of rows in a task, and only its k best of each query leave it.
    """
    keys = ["dims", "label", "cell"]
    counted = asked.select(*keys, F.lit(1).alias("q")).unionAll(rows.select(*keys, F.lit(0).alias("q")))
    blocks = lambda c: F.ceil(F.sum(c) / block).cast("int")
    sizes = counted.groupBy(*keys).agg(blocks("q").alias("nq"), blocks(1 - F.col("q")).alias("nr")).filter("nq > 0 and nr > 0")
    sizes = sizes.select(F.col("dims").alias("d_"), F.col("label").alias("l_"), F.col("cell").alias("c_"), "nq", "nr")

    def dealt(side: DataFrame, own: str, of: str, other: str, to: str) -> DataFrame:
        joined = side.join(sizes, (F.col("dims") == F.col("d_")) & F.col("label").eqNullSafe(F.col("l_")) & (F.col("cell") == F.col("c_")))
        return joined.select(*keys, "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(to) - 1)).alias(other))

    by = [*keys, "qb", "rb"]
    # Each side has columns of its own, as both may come from one table.
    left, right = dealt(asked, "qb", "nq", "rb", "nr"), dealt(rows, "rb", "nr", "qb", "nq")
    left, right = (df.select(*[F.col(c).alias(c) for c in (*by, "vec_id", "embedding")]) for df in (left, right))
    both = left.groupBy(*by).cogroup(right.groupBy(*by))
    best = both.applyInArrow(block_nearest(k), "query long, vec_id long, distance double")
    return best.withColumn("place", ranked(["query"], F.col("distance"), F.col("vec_id"))).filter(F.col("place") <= k)


def _cells_of(queries: DataFrame, index: VectorIndex, rest: bool) -> DataFrame:
    """``queries`` with the cells to look into: the ``probes`` nearest; rest: of the others those that may hold a row at an angle of at most ``reach``."""
    centroids, radius, probes, dims = index.centroids, index.radius, index.probes, index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for part in np.array_split(np.arange(batch.num_rows), max(1, batch.num_rows // 512)):
                if len(part):
                    cosines = _units(batch.column(2).slice(part[0], len(part))) @ centroids.T
                    order = np.argsort(-cosines, axis=1, kind="stable")
                    if not rest:
                        lists += order[:, :probes].tolist()
                    else:
                        reach = batch.column(4).slice(part[0], len(part)).to_numpy()
                        near = np.arccos(np.clip(cosines, -1, 1)) - radius <= reach[:, None]
                        np.put_along_axis(near, order[:, :probes], False, axis=1)
                        lists += [np.flatnonzero(row).tolist() for row in near]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "label", "embedding", "dims", "cells"])

    kinds = queries.schema
    schema = f"vec_id long, label {kinds['label'].dataType.simpleString()}, embedding {kinds['embedding'].dataType.simpleString()}, dims int, cells array<int>"
    columns = ["vec_id", "label", "embedding", "dims", *(["reach"] if rest else [])]
    found = queries.filter(F.col("dims") == dims).select(*columns).mapInArrow(run, schema)
    return found.select("vec_id", "label", "embedding", "dims", F.explode("cells").alias("cell"))


def search(index: VectorIndex, asked: DataFrame, k: int = 5, exact: bool = True, block: int = 2000, lists_from: int | None = None) -> DataFrame:
    """query, vec_id, distance, place: the k nearest rows of the same label for each of ``asked`` (vec_id, label, embedding); those without a label search all rows.

    exact: look into every cell that may hold one of them; else the probed cells only. lists_from: labels of more rows are searched by lists, by
    default those for which that sends a query to fewer tasks than all blocks of the label would; at most a thousand labels are.
    """
    probes = index.probes
    least = max(probes * block if lists_from is None else lists_from, index.n // 1000)
    asked = usable_vectors(asked)
    kind = index.rows.schema["label"].dataType
    rows = index.rows.withColumn("label", F.explode(F.array_distinct(F.array("label", F.lit(None).cast(kind)))))
    large = F.broadcast(rows.groupBy("label").count().filter(F.col("count") > least).select(F.col("label").alias("l_"), F.lit(True).alias("listed")))
    dims = index.centroids.shape[1]

    def told(side: DataFrame) -> DataFrame:
        joined = side.join(large, F.col("label").eqNullSafe(F.col("l_")), "left")
        return joined.withColumn("listed", F.coalesce("listed", F.lit(False)) & (F.col("dims") == dims)).drop("l_")

    rows = told(rows).withColumn("cell", F.when(F.col("listed"), F.col("cell")).otherwise(-1)).drop("listed")
    queries = told(asked)
    whole = queries.filter(~F.col("listed")).drop("listed").withColumn("cell", F.lit(-1))
    by_lists = queries.filter("listed").drop("listed")
    tried = whole.unionByName(_cells_of(by_lists, index, False))
    best = _best(tried, rows, k, block)
    if not exact:
        return best
    best = written(best, "best")
    worst = best.groupBy("query").agg(F.count("*").alias("found"), F.max("distance").alias("distance"))
    reach = F.when(F.col("found") == k, F.acos(F.greatest(1 - F.col("distance") - MARGIN, F.lit(-1.0))) + MARGIN).otherwise(math.pi)
    left = by_lists.join(worst, F.col("vec_id") == F.col("query"), "left").withColumn("reach", F.coalesce(reach, F.lit(math.pi)))
    more = _best(_cells_of(left, index, True), rows, k, block)
    both = best.drop("place").unionByName(more.drop("place"))
    return both.withColumn("place", ranked(["query"], F.col("distance"), F.col("vec_id"))).filter(F.col("place") <= k)


def mutual_links(index: VectorIndex, asked: DataFrame, near: float, k: int = 5, exact: bool = True, block: int = 2000, lists_from: int | None = None) -> DataFrame:
    """a, b (a < b), distance: the pairs of vectors at most ``near`` apart of which one is among the ``k`` nearest of the other."""
    found = search(index, asked, k, exact, block, lists_from).filter(F.col("distance") <= near)
    return found.select(F.least("query", "vec_id").alias("a"), F.greatest("query", "vec_id").alias("b"), "distance").distinct()


def _last_pairs(edges: DataFrame, shops: DataFrame) -> DataFrame:
    """gone, kept: what merging along ``edges`` (a, b, distance, x, y) in order, one after the other in one task, makes of their clusters; ``shops`` are these clusters' (c, shop, low, high, blank)."""
    kinds = {f.name: f.dataType for df in (shops, edges) for f in df.schema}
    none = lambda *names: [F.lit(None).cast(kinds[n]).alias(n) for n in names]
    held = shops.select(F.lit(0).alias("edge"), F.col("c").alias("a"), *none("b"), "shop", "low", "high", "blank", *none("distance", "x", "y"))
    rows = held.unionByName(edges.select(F.lit(1).alias("edge"), "a", "b", *none("shop", "low", "high", "blank"), "distance", "x", "y"))
    ids = to_arrow_type(kinds["a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, own, name = {}, {}, {}

        def top(c):
            while (over := up.get(c, c)) != c:
                up[c] = c = up.get(over, over)
            return c

        def apart(few, many):
            pairs = ((few[s], many[s]) for s in few if s in many)
            return any(b or d or min(lo, low) != max(hi, high) for (lo, hi, b), (low, high, d) in pairs)

        for batch in batches:
            for edge, a, b, shop, low, high, blank, *_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not edge:
                    own.setdefault(a, {})[shop] = (low, high, blank)
                    continue
                few, many = sorted((top(a), top(b)), key=lambda c: len(own.get(c, ())))
                if few == many or apart(own.get(few, {}), own.get(many, {})):
                    continue
                # Shops that both have are of one sku here.
                up[few] = many
                up.setdefault(many, many)
                name[many] = min(name.get(few, few), name.get(many, many))
                own.setdefault(many, {}).update(own.pop(few, {}))
        moved = [(c, name[top(c)]) for c in up if name[top(c)] != c]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in moved], ids) for k in (0, 1)], ["gone", "kept"])

    a = kinds["a"].simpleString()
    return rows.repartition(1).sortWithinPartitions("edge", "distance", "x", "y").mapInArrow(run, f"gone {a}, kept {a}")


def cluster_apart(links: DataFrame, members: DataFrame, few: int = 20_000, held: int = 400_000) -> DataFrame:
    """id, cluster (its smallest id) of every id of ``members`` (id, shop, sku), merged along ``links`` (a, b, distance) in order of distance, then ids.

    Two clusters with listings of a shop stay apart unless all of these have one and the same sku; a listing without a sku is like no other. A link between
    clusters that must stay apart is dropped. In a round every pair of clusters that are each other's nearest is merged; that gives what merging along
    one link after the other gives, whatever the order of the rows: a cluster's nearest stays its nearest until they merge, and what must stay apart always must.

    Only ids with links take part in the rounds. A round finds the pairs, moves their shops and edges, and looks at those edges again whose clusters have grown; who
    went where is followed to its end once, after the last round. Chains of ever longer links would take a round each, so that the last ``few`` edges, whose clusters
    have at most ``held`` shops, are gone along one after the other in one task.
    """
    edges = links.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("distance").alias("distance"))
    edges = written(edges.select("a", "b", "distance", F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias("grown")), "links")
    linked = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sku = F.when(F.col("sku") != "", F.col("sku"))
    shops = members.filter("shop IS NOT NULL").join(linked, "id", "left_semi").groupBy(F.col("id").alias("c"), "shop").agg(F.min(sku).alias("low"), F.max(sku).alias("high"), F.bool_or(sku.isNull()).alias("blank"))
    shops = written(shops, "shops")

    def allowed(edges: DataFrame) -> DataFrame:
        side = lambda k: shops.select(F.col("c").alias(k), "shop", F.col("low").alias(f"low{k}"), F.col("high").alias(f"high{k}"), F.col("blank").alias(f"blank{k}"))
        both = edges.filter("grown").select("a", "b").join(side("a"), "a").join(side("b"), ["b", "shop"])
        apart = both.filter(F.col("blanka") | F.col("blankb") | (F.least("lowa", "lowb") != F.greatest("higha", "highb"))).select("a", "b").distinct()
        return written(edges.join(apart, ["a", "b"], "left_anti"), "links")

    edges, rounds = allowed(edges), []
    # The shortest edge of all is a pair's, so that there are pairs as long as there are edges.
    while left := edges.count():
        if left <= few:
            known = shops.join(edges.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi")
            if known.limit(held + 1).count() <= held:
                rounds.append(written(_last_pairs(edges, known), "merged"))
                break
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("to")), F.struct(F.col("b").alias("c"), F.col("a").alias("to")))).alias("e"), "distance", "x", "y")
        best = ends.select("e.c", "e.to", "distance", "x", "y").groupBy("c").agg(F.min_by("to", F.struct("distance", "x", "y")).alias("to"))
        merged = best.groupBy(F.least("c", "to").alias("kept"), F.greatest("c", "to").alias("gone")).count().filter("count = 2")
        merged = written(merged.select("gone", "kept"), "merged")
        rounds.append(merged)
        # A pair's two ids with its kept one, so that one join both moves an id and tells that its cluster has grown.
        new = merged.select(F.explode(F.array("gone", "kept")).alias("old"), F.col("kept").alias("new"))
        now = lambda df, column: df.join(new, F.col(column) == F.col("old"), "left").withColumn("grown", F.col("grown") | F.col("new").isNotNull()).withColumn(column, F.coalesce("new", column)).drop("old", "new")
        shops = written(now(shops.withColumn("grown", F.lit(False)), "c").groupBy("c", "shop").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("blank").alias("blank")), "shops")
        moved = now(now(edges.withColumn("grown", F.lit(False)), "a"), "b").filter("a <> b")
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", "x", "y", "grown")
        moved = moved.groupBy("a", "b").agg(F.min(F.struct("distance", "x", "y")).alias("k"), F.bool_or("grown").alias("grown"))
        edges = allowed(moved.select("a", "b", "k.*", "grown"))
    ids = members.select("id").distinct()
    if not rounds:
        return ids.withColumn("cluster", F.col("id"))
    tree = written(reduce(DataFrame.unionByName, rounds), "merged")
    # A round's pairs can go on in later rounds only, and each join doubles how far a row sees.
    for _ in range((len(rounds) - 1).bit_length()):
        further = tree.select(F.col("gone").alias("kept"), F.col("kept").alias("last"))
        tree = written(tree.join(further, "kept", "left").select("gone", F.coalesce("last", "kept").alias("kept")), "merged")
    return ids.join(tree, F.col("id") == F.col("gone"), "left").select("id", F.coalesce("kept", "id").alias("cluster"))
