"""Exact metric range join of embeddings (operator 11).

The metric is the angle between two vectors; a link is an angle of at most
``acos(0.93)``.  Vectors of one label and length are compared, others never.

1. Equal vectors become one node with a weight, aggregated before anything is
   compared, so copies cost one row.
2. A label with more nodes than a cell should hold gets pivots from a bounded
   sample, no two of them within a link of each other.  Every node belongs to the
   cell of its nearest pivot.
3. The triangle inequality sets which nodes are needed beyond their own cell: a node
   goes to a later cell only if the cell's ball, and the half space that the two
   pivots leave to the cell, come within a link's reach.
4. Nodes within half a link of their pivot are linked with each other by the same
   inequality.  They are counted, not compared, so a tight group that holds a
   third of all rows costs one row a member.
5. Cells join independently, in pairs of blocks of bounded size.  A task sends for
   each node the weight that it links with and the least node of its piece of a
   component: never pairs.  Components are closed over these pieces.

Where vectors are spread evenly over many dimensions no pivot excludes much, and
the blocks then cover most pairs of a label; the result is the same.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite
component, and vectors with a null label, link with nothing and are their own
component.  Rows of equal id are each returned and count as other vectors to each
other.  A null id is never the smallest of a component, unless all there are null;
such a row isn't kept.  Vectors of different length link with nothing of each other.
An empty table gives an empty table.  Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.components import connected_components
from quarrystone.llm.tables import cut_lineage

COSINE = 0.93
CELL = 2048  # nodes of a cell aimed at
BLOCK_ROWS = 4096
BLOCK_BYTES = 16_000_000  # of a block's numbers in a task
MOST_PIVOTS = 2048  # of all labels; cells beyond that are larger and take more blocks
CANDIDATES = 4  # sampled nodes for each pivot
SAMPLE_BYTES = 32_000_000  # of sampled candidates on the driver
SLACK = 1e-6  # radians or cosine: bounds are widened by more than what rounding can be
DOUBTFUL = 1e-9  # so close to the threshold a cosine is summed exactly
CHUNK = 512

_REST, _CORE, _GUEST = 0, 1, 2
_PLACE = "label string, dim int, cell int, kind int, node string, weight long, angle double"


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the usable vectors of a list column, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        got = values[offsets[:-1][rows][:, None] + np.arange(d)] + 0.0  # no negative zeros
        good = np.isfinite(got).all(axis=1) & (got != 0).any(axis=1)
        yield rows[good], got[good]


def _scaled(m: np.ndarray) -> np.ndarray:
    """In doubles, each row divided by a power of two, so that squares neither overflow nor vanish."""
    m = m.astype(np.float64)
    _, exponent = np.frexp(np.abs(m).max(axis=1, initial=0))
    return np.ldexp(m, -exponent[:, None])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _with_nodes(df: DataFrame, id_col: str, vector_col: str, label_col: str, vectors: bool) -> DataFrame:
    """(id, label, dim, node[, vec]); node is null where a vector can't link."""
    element = dict(df.dtypes)[vector_col].removeprefix("array<").removesuffix(">")
    kind = "<f4" if element == "float" else "<f8"
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            node: list[str | None] = [None] * batch.num_rows
            raw: list[bytes | None] = [None] * batch.num_rows
            dim = [0] * batch.num_rows
            for rows, m in _matrices(batch.column(2)):
                m = np.ascontiguousarray(m, kind)
                for i, one in zip(rows.tolist(), m, strict=True):
                    if labels[i] is not None:
                        own = one.tobytes()
                        dim[i], raw[i] = m.shape[1], own
                        node[i] = hashlib.blake2b(own + labels[i].encode(), digest_size=16, salt=m.shape[1].to_bytes(8, "little")).hexdigest()
            out = {"id": batch.column(0), "label": batch.column(1), "dim": pa.array(dim, pa.int32()), "node": pa.array(node, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"vec": pa.array(raw, pa.binary())} if vectors else {}))

    return src.mapInArrow(run, "id long, label string, dim int, node string" + ", vec binary" * vectors)


def _numbers(raw: list[bytes], dim: int) -> np.ndarray:
    kind = "<f4" if len(raw[0]) == 4 * dim else "<f8"
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim)


class Cells:
    """Pivots of one label and length, and the radius of each of their cells once it is known."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        self.radius = np.full(len(pivots), math.pi)

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        close = np.clip(unit @ self.pivots.T, -1, 1)
        home = close.argmax(axis=1)
        return close, home, np.arccos(close[np.arange(len(unit)), home])

    def guests(self, close: np.ndarray, home: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the later cells in which a node may have a link."""
        reach, chord = math.acos(cosine), math.sqrt(2 - 2 * cosine)
        later = np.arange(len(self.pivots))[None, :] > home[:, None]
        ball = np.arccos(close) <= self.radius[None, :] + reach + SLACK
        half = close[np.arange(len(home)), home][:, None] - close <= chord * self.apart[home] + SLACK
        return np.nonzero(later & ball & half)


def separated(candidates: np.ndarray, k: int, cosine: float) -> np.ndarray:
    """At most ``k`` of the unit vectors, in their order, no two of them as close as a link."""
    taken = np.zeros((0, candidates.shape[1]))
    for one in candidates:
        if len(taken) == k:
            break
        if not len(taken) or (taken @ one).max() < cosine:
            taken = np.vstack([taken, one])
    return taken


def _pivots(nodes: DataFrame, cosine: float, cell: int) -> dict[tuple[str, int], Cells]:
    """Cells of the labels that need more than one; sizes on the driver are bounded by MOST_PIVOTS and SAMPLE_BYTES."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = sizes.orderBy(F.desc("n"), "label", "dim").limit(MOST_PIVOTS // 2).collect()
    if not large:
        return {}
    wanted = {(r["label"], r["dim"]): math.ceil(r["n"] / cell) for r in large}
    most = min(MOST_PIVOTS, SAMPLE_BYTES // (8 * CANDIDATES * max(d for _, d in wanted)))
    share = min(1.0, most / sum(wanted.values()))
    wanted = {key: max(2, int(k * share)) for key, k in wanted.items()}
    rows = [(r["label"], r["dim"], int(min(1.0, CANDIDATES * wanted[r["label"], r["dim"]] / r["n"]) * 2**30)) for r in large]
    part = nodes.sparkSession.createDataFrame(rows, "label string, dim int, part long")
    sample = nodes.join(F.broadcast(part), ["label", "dim"]).where(F.pmod(F.xxhash64("node"), F.lit(2**30)) < F.col("part"))
    by_key: dict[tuple[str, int], list] = {}
    for r in sample.select("label", "dim", "node", "vec").collect():
        by_key.setdefault((r["label"], r["dim"]), []).append((r["node"], bytes(r["vec"])))
    out = {}
    for key, found in by_key.items():
        chosen = separated(_unit(_numbers([v for _, v in sorted(found)], key[1])), wanted[key], cosine)
        if len(chosen) > 1:
            out[key] = Cells(chosen)
    return out


def _places(nodes: DataFrame, cells: dict[tuple[str, int], Cells], cosine: float, guests: bool, vectors: bool) -> DataFrame:
    """The cell of each node and, with ``guests``, the further cells that need it."""
    shared = nodes.sparkSession.sparkContext.broadcast(cells)  # at most MOST_PIVOTS vectors
    half = math.acos(cosine) / 2 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key: dict[tuple[str, int], list[int]] = {}
            for i, at in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                key.setdefault(at, []).append(i)
            raw = batch.column("vec")
            take, cell, kind, angle = [], [], [], []
            for at, rows in key.items():
                own, mine = np.array(rows), shared.value.get(at)
                if mine is None:
                    take.append(own)
                    cell.append(np.zeros(len(own), np.int32))
                    kind.append(np.full(len(own), _REST, np.int32))
                    angle.append(np.full(len(own), math.pi))
                    continue
                close, home, far = mine.nearest(_unit(_numbers([raw[i].as_py() for i in rows], at[1])))
                take.append(own)
                cell.append(home)
                kind.append(np.where(far <= half, _CORE, _REST))
                angle.append(far)
                if guests:
                    row, other = mine.guests(close, home, cosine)
                    take.append(own[row])
                    cell.append(other)
                    kind.append(np.full(len(row), _GUEST))
                    angle.append(np.zeros(len(row)))
            rows_of = pa.array(np.concatenate(take))
            columns = {x: batch.column(x).take(rows_of) for x in ("label", "dim", "node", "weight", *["vec"] * vectors)}
            columns |= {"cell": pa.array(np.concatenate(cell).astype(np.int32)), "kind": pa.array(np.concatenate(kind).astype(np.int32)), "angle": pa.array(np.concatenate(angle))}
            yield pa.RecordBatch.from_pydict({x: columns[x] for x in ("label", "dim", "cell", "kind", "node", "weight", "angle", *["vec"] * vectors)})

    return nodes.mapInArrow(run, _PLACE + ", vec binary" * vectors)


def _linked(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows link; a cosine next to the threshold is summed exactly, so no order of summing decides."""
    close = _unit(left) @ _unit(right).T
    out = close >= cosine
    for i, j in zip(*np.nonzero(np.abs(close - cosine) < DOUBTFUL), strict=True):
        x, y = left[i], right[j]
        out[i, j] = math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))) >= cosine
    return out


def _compare(m: np.ndarray, weight: np.ndarray, kind: np.ndarray, first: np.ndarray, second: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked weight and component (the least row in it) of the rows of a task that compares ``first`` with ``second``."""
    links, root = np.zeros(len(m), np.int64), np.arange(len(m))
    same = first is second
    for at in range(0, len(first), CHUNK):
        rows = first[at : at + CHUNK]
        ok = _linked(m[rows], m[second], cosine)
        if same:  # each pair once, and what the cell knows already isn't asked again
            ok &= rows[:, None] < second[None, :]
            ok &= ~(((kind[rows] == _CORE)[:, None] & (kind[second] == _CORE)[None, :]) | ((kind[rows] == _GUEST)[:, None] & (kind[second] == _GUEST)[None, :]))
        links[rows] += ok @ weight[second]
        links[second] += weight[rows] @ ok
        for i in np.flatnonzero(ok.any(axis=1)):
            joined = np.unique(np.append(root[second[ok[i]]], root[rows[i]]))
            if len(joined) > 1:
                root[np.isin(root, joined[1:])] = joined[0]
    return links, root


def _blocks(n: str, size) -> F.Column:
    return F.ceil(F.coalesce(F.col(n), F.lit(0)) / size).cast("int")


def near_links(nodes: DataFrame, cosine: float = COSINE, cell: int = CELL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, links, root) pieces: linked weight of a node in one task, and a node of the same component there."""
    cells = _pivots(nodes, cosine, cell)
    homes = _places(nodes, cells, cosine, guests=False, vectors=False)
    if cells:
        for r in homes.where(F.col("angle") < math.pi).groupBy("label", "dim", "cell").agg(F.max("angle").alias("radius")).collect():  # a row for each pivot at most
            if (r["label"], r["dim"]) in cells:
                cells[r["label"], r["dim"]].radius[r["cell"]] = r["radius"]
    core = F.col("kind") == _CORE
    places = _places(nodes, cells, cosine, guests=True, vectors=False)
    stats = cut_lineage(
        places.groupBy("label", "dim", "cell").agg(
            *(F.count_if(F.col("kind") == k).alias(x) for k, x in ((_REST, "rest"), (_CORE, "core"), (_GUEST, "guest"))),
            F.sum(F.when(core, F.col("weight"))).alias("core_weight"), F.min(F.when(core, F.col("node"))).alias("core_node"))
    )
    # Cores by the triangle inequality alone.
    known = homes.where(core).join(stats, ["label", "dim", "cell"]).select("node", (F.col("core_weight") - F.col("weight")).alias("links"), F.col("core_node").alias("root"))

    # Everything else by pairs of blocks: rest with all, cores with rest and guests.
    size = F.greatest(F.lit(64), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))) if block_rows == BLOCK_ROWS else F.lit(block_rows)
    placed = _places(nodes, cells, cosine, guests=True, vectors=True).join(stats.drop("core_weight", "core_node"), ["label", "dim", "cell"])
    placed = placed.withColumns({"b_rest": _blocks("rest", size), "b_core": _blocks("core", size), "b_guest": _blocks("guest", size)})
    whole = F.col("rest") + F.col("core") + F.col("guest") <= size
    number = F.when(core, F.col("b_core")).when(F.col("kind") == _GUEST, F.col("b_guest")).otherwise(F.col("b_rest"))
    before = F.when(core, F.col("b_rest")).when(F.col("kind") == _GUEST, F.col("b_rest") + F.col("b_core")).otherwise(0)
    placed = placed.withColumn("block", F.when(whole, 0).otherwise(before + F.pmod(F.xxhash64("node", F.lit("block")), number).cast("int")))
    every = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    rest, inner, outer = F.col("b_rest"), F.col("b_rest") + F.col("b_core"), F.col("b_rest") + F.col("b_core") + F.col("b_guest")
    with_ = F.when(whole, F.array(F.lit(0))).when(core, F.concat(every(F.lit(0), rest), every(inner, outer))).when(F.col("kind") == _GUEST, every(F.lit(0), inner)).otherwise(every(F.lit(0), outer))
    tasks = placed.withColumn("with", F.explode(with_)).withColumns({"t1": F.least("block", "with"), "t2": F.greatest("block", "with"), "whole": whole})
    small = stats.agg(F.sum(F.when(F.col("rest") + F.col("core") + F.col("guest") <= block_rows, F.col("rest") + F.col("core") + F.col("guest"))).alias("n")).first()["n"] or 0
    bucket = F.concat(F.lit("cells "), F.pmod(F.xxhash64("label", "dim", "cell"), F.lit(small // block_rows + 1)))
    tasks = tasks.withColumn("task", F.when(F.col("whole"), bucket).otherwise(F.concat_ws(" ", "dim", "cell", "t1", "t2", "label")))

    def run(table: pa.Table) -> pa.Table:
        keys: dict[tuple, list[int]] = {}
        for i, at in enumerate(zip(*(table.column(x).to_pylist() for x in ("label", "dim", "cell", "t1", "t2")), strict=True)):
            keys.setdefault(at, []).append(i)
        names, raw = table.column("node").to_pylist(), table.column("vec").to_pylist()
        weights, kinds, blocks, alone = (table.column(x).to_numpy() for x in ("weight", "kind", "block", "whole"))
        out: tuple[list, list, list] = ([], [], [])
        for (_, dim, _, t1, t2), at in keys.items():
            at.sort(key=names.__getitem__)
            rows = np.array(at)
            m, every_row = _scaled(_numbers([raw[i] for i in at], dim)), np.arange(len(at))
            if alone[at[0]] or t1 == t2:
                first = second = every_row
            else:
                first, second = every_row[blocks[rows] == t1], every_row[blocks[rows] == t2]
            links, root = _compare(m, weights[rows], kinds[rows], first, second, cosine)
            for i in np.flatnonzero(links):
                out[0].append(names[at[i]])
                out[1].append(int(links[i]))
                out[2].append(names[at[root[i]]])
        return pa.table({"node": pa.array(out[0], pa.string()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.string())})

    tasks = tasks.select("task", "label", "dim", "cell", "t1", "t2", "block", "kind", "whole", "node", "weight", "vec")
    return tasks.groupBy("task").applyInArrow(run, "node string, links long, root string").unionByName(known)


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, cell: int = CELL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row of each vector: (id, n_links, component_id, kept); links are cosines of at least ``cosine`` within a label."""
    found = _with_nodes(df, id_col, vector_col, label_col, vectors=True).where("node is not null")
    nodes = cut_lineage(found.groupBy("label", "dim", "node").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec")))
    pieces = cut_lineage(near_links(nodes, cosine, cell, block_rows))
    links = pieces.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(pieces.select("node", "root").where("node <> root"), "node", "root")
    told = nodes.select("node", "least", "weight").join(links, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = cut_lineage(told)
    first = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(first, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = _with_nodes(df, id_col, vector_col, label_col, vectors=False).join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 11 over all of ``embeddings``."""
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows from all pairs of a label, closed over links.
ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 END),
reach AS (SELECT a AS vec_id, b AS other FROM link UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a),
m AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY vec_id)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(d.vec_id, coalesce(m.m, d.vec_id)) AS component_id, d.vec_id = least(d.vec_id, coalesce(m.m, d.vec_id)) AS kept
FROM embeddings d LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""
