"""Exact n-gram Jaccard join by prefix filtering (operator 4).

A document's set is its distinct word shingles.  Documents with equal sets
share one node, so copies are never compared.  Per node:

1. Shingle frequencies are estimated in a sketch of bounded size; shingles are
   ordered rare-first by the estimate's level, then by hash.  Any order that all
   documents share keeps prefix filtering exact, so estimates cost no result.
2. Two sets as similar as asked share a shingle within their prefixes.  Prefix
   shingles meet in groups of a range of their hash; those of one node only drop out.
   Copies are one entry of a task's message, and nodes of a shingle that the sketch
   puts far above the mean don't need to meet there at all.
3. Pairs come from each list of nodes with the same prefix shingle in rounds:
   first against one leader, then against the next 16, then the next 256, and
   so on until every list is done.  Pairs that earlier rounds have put into one
   component are not needed any more, so a large group of near copies costs about
   one comparison a member, not one for each pair.  Length and positional filters
   apply before a pair is made, and no pair is verified twice.
4. Verification joins the sets to the pairs: a suffix filter on counts by hash
   range first, then the exact intersection.

Defined results: null, empty and wordless texts have an empty set, link with
nothing and are their own component; fewer words than a shingle make one shingle
of the whole sequence; rows with equal text and id are each returned; a row with
a null id is compared like any other but is never the smallest id of a component,
unless all ids there are null; an empty table gives an empty table; other columns
aren't looked at; a very long text is read in one piece, which takes about 60 bytes
of memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarrystone.llm import sketches as S
from quarrystone.llm.components import connected_components
from quarrystone.llm.tables import cut_lineage, two_columns
from quarrystone.llm.textblocks import mix64, scan_words, shingle_sets

SHINGLE = 5
PERCENT = 80
BYTES_PER_SHINGLE = 7  # only to size the sketch and the groups
SLOTS_PER_SHINGLE = 1.0
CAP_BITS = 27  # two bits a slot: at most 32 MB
OWN_CAP_BITS = 27  # three rows of one bit a slot: at most 48 MB
BLOCK_SHINGLES = 600_000
HELD_SHINGLES = 800_000
GROUP_BYTES = 12_000_000
LIST_ROWS = 50_000  # members of a list that one task ranks
LEADERS = 16  # growth of the number of leaders of a list from round to round
BROADCAST_NODES = 200_000  # 200,000 ids of 8 bytes: under 10 MB as a hash table
HISTOGRAM = 64


def _levels(mean: float):
    """Two bits a slot: hit once, so by one document; about the mean load; several times that; far above."""
    steps = np.array([1, max(1, 2 * mean + 4), 16 * (mean + 4)])

    def level(total: np.ndarray) -> bytes:
        v = np.searchsorted(steps, total, side="left").astype(np.uint8).reshape(-1, 4)
        return (v[:, 0] | v[:, 1] << 2 | v[:, 2] << 4 | v[:, 3] << 6).tobytes()

    return level


def _nodes(sets_row: np.ndarray, hashes: np.ndarray, second: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit fingerprint of each row's set, of two independent hashes of each shingle."""
    size = np.bincount(sets_row, minlength=n_rows)
    bounds = np.concatenate(([0], np.cumsum(size)))
    out = []
    for seed, of in ((1, hashes), (2, second)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(of ^ mix64(np.array([seed], np.uint64))), dtype=np.uint64)))
        out.append(mix64(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64)))
    return size, out[0], out[1]


def _group_of(first: np.ndarray, ids: pa.Array, seen: int, groups: int) -> np.ndarray:
    """The group that carries each document's row: by a hash of set and id; rows without an id are dealt one after another."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    own = np.where(known, first ^ ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), np.arange(seen, seen + len(first), dtype=np.uint64))
    return (mix64(own) % np.uint64(groups)).astype(np.int32)


def _name(a: np.ndarray, b: np.ndarray) -> list[str | None]:
    return [f"{x:016x}{y:016x}" for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, cap_bits: int = CAP_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Link documents with ``100 * intersection >= percent * union``; (id, n_shingles, component_id)."""
    return _labelled(*_linked(df, id_col, text_col, shingle, percent, cap_bits, list_rows), id_col)


def _linked(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, percent: int = PERCENT, cap_bits: int = CAP_BITS, list_rows: int = LIST_ROWS) -> tuple[DataFrame, DataFrame]:
    """A row (id, n, node) of each document, and (node, component) of the nodes with a link."""
    spark = df.sparkSession
    src = two_columns(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    size = src.agg(F.sum(F.octet_length(text_col)).alias("bytes")).first()["bytes"] or 0
    shingles = max(1, size // BYTES_PER_SHINGLE)
    width = S.width_for(shingles, SLOTS_PER_SHINGLE, cap_bits)
    blocks = min(width >> 3, 1 << max(4, int(np.ceil(np.log2(shingles / BLOCK_SHINGLES + 1)))))

    doc_groups = max(16, size // GROUP_BYTES)  # for their rows only, dealt by a hash of set and id

    # One pass for sizes, fingerprints and shingle counts.
    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of documents travel with the sketch's messages, in groups of negative numbers.
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.string()), ("block", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])
        sketch = S.PartitionSketch(width, 1, blocks)
        seen = 0

        def drained() -> pa.RecordBatch:
            part = sketch.drain()
            none = [None] * len(part["block"])
            return pa.RecordBatch.from_pydict({"id": none, "n": none, "node": none, **part}, schema)

        for batch in batches:
            for words in scan_words(batch.column(1), lower=True):
                rows, hashes, second = shingle_sets(words, shingle)
                n, a, b = _nodes(rows, hashes, second, words.n_rows)
                none = [None] * words.n_rows
                ids = batch.column(0)[words.first_row : words.first_row + words.n_rows]
                group = -1 - _group_of(a, ids, seen, doc_groups)
                seen += words.n_rows
                node = [x if k else None for x, k in zip(_name(a, b), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"id": ids, "n": n, "node": node, "block": group, "slots": none, "counts": none}, schema)
                sketch.add(hashes)
                if sketch.full(HELD_SHINGLES):
                    yield drained()
        yield drained()

    level = _levels(shingles / width)
    span = width // blocks

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        if block < 0:
            return table.select(["id", "n", "node"]).append_column("block", pa.nulls(len(table), pa.int32())).append_column("packed", pa.nulls(len(table), pa.binary()))
        none = [None]
        packed = level(S.added(table, span))
        return pa.table({"id": pa.array(none, pa.int64()), "n": pa.array(none, pa.int64()), "node": pa.array(none, pa.string()), "block": pa.array([block], pa.int32()), "packed": pa.array([packed], pa.binary())})

    messages = src.mapInArrow(first_pass, "id long, n long, node string, block int, slots binary, counts binary")
    first = cut_lineage(messages.groupBy("block").applyInArrow(merged, "id long, n long, node string, block int, packed binary"))
    docs = first.where("block is null").select("id", "n", "node")
    packed = S.gather(first.where("block is not null").select("block", "packed"), blocks, 1, span // 4)[0]
    shared = spark.sparkContext.broadcast(packed)  # width / 4 bytes, bounded by cap_bits
    del packed

    def level_of(hashes: np.ndarray) -> np.ndarray:
        slots = S.slots_of(hashes, width, 0)
        return (shared.value[(slots >> np.uint64(2)).astype(np.int64)] >> (2 * (slots & np.uint64(3))).astype(np.uint8)) & 3

    groups = max(16, shingles * (102 - percent) // 100 // BLOCK_SHINGLES * 2)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("token", "a", "b", "row"))])

        def drain() -> pa.RecordBatch:
            token, a, b, level = (np.concatenate([x[i] for x in held]) for i in range(4))
            held.clear()
            # A shingle far above the mean is shared for sure, so only its nodes matter: they are dealt by node, not by shingle.
            hot = level == 3
            part = np.where(hot, -1 - (a % np.uint64(groups)).astype(np.int64), ((token >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)).astype(np.int32)
            token[hot] = 0
            order = np.lexsort((b, a, token, part))
            part, token, a, b = (x[order] for x in (part, token, a, b))
            once = np.ones(len(token), bool)  # copies are one node
            once[1:] = (part[1:] != part[:-1]) | (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            part, token, a, b = (x[once] for x in (part, token, a, b))
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            out: dict[str, object] = {"part": part[cuts[:-1]], "token": [], "a": [], "b": [], "row": []}
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                # A node recurs in a message; one number stands for it there.
                nodes, which, row = np.unique(a[i:j], return_index=True, return_inverse=True)
                for x, packed in (("token", S.pack_sorted(token[i:j])), ("a", S.pack(nodes)), ("b", S.pack(b[i:j][which])), ("row", S.pack(row.astype(np.uint32)))):
                    out[x].append(packed)
            return pa.RecordBatch.from_pydict(out, names)

        count = 0
        for batch in batches:
            for words in scan_words(batch.column(1), lower=True):
                rows, hashes, second = shingle_sets(words, shingle)
                n, a, b = _nodes(rows, hashes, second, words.n_rows)
                levels = level_of(hashes)
                order = np.lexsort((hashes, levels, rows))
                rows, hashes, levels = rows[order], hashes[order], levels[order]
                begin = np.concatenate(([0], np.cumsum(n)))[:-1]
                pos = np.arange(len(rows)) - begin[rows]
                # A shingle of one document only takes its place in the prefix, but meets nothing.
                keep = (pos < _prefix_length(n, percent)[rows]) & (levels > 0)
                rows = rows[keep]
                held.append((hashes[keep], a[rows], b[rows], levels[keep]))
                count += len(rows)
                if held and count >= HELD_SHINGLES:
                    yield drain()
                    count = 0
        if count:
            yield drain()

    # Nodes with a prefix shingle that another node has in its prefix too.
    def sharing(key: tuple, table: pa.Table) -> pa.Table:
        parts = []
        for t, a, b, r in zip(*(table.column(x).to_pylist() for x in ("token", "a", "b", "row")), strict=True):
            row = S.unpack(r, "uint32")
            parts.append((S.unpack_sorted(t, "uint64"), S.unpack(a, "uint64")[row], S.unpack(b, "uint64")[row]))
        token, a, b = (np.concatenate([x[i] for x in parts]) for i in range(3))
        if key[0].as_py() >= 0:
            order = np.lexsort((b, a, token))
            token, a, b = (x[order] for x in (token, a, b))
            once = np.ones(len(token), bool)
            once[1:] = (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            token, a, b = (x[once] for x in (token, a, b))
            same = np.zeros(len(token) + 1, bool)
            same[1:-1] = token[1:] == token[:-1]
            many = same[1:] | same[:-1]
            a, b = a[many], b[many]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.table({"node": pa.array(_name(a[once], b[once]), pa.string())})

    messages = src.mapInArrow(prefixes, "part int, token binary, a binary, b binary, row binary")
    involved = cut_lineage(messages.groupBy("part").applyInArrow(sharing, "node string"))
    sets = _sets_of(src, docs, involved.distinct(), shingle)
    lists = _lists(sets, level_of, percent, list_rows)
    shared.destroy()
    return docs, _link_rounds(spark, lists, sets, percent)


def _sets_of(src: DataFrame, docs: DataFrame, involved: DataFrame, shingle: int) -> DataFrame:
    """The shingle sets of the nodes that may link, computed again from one document of each."""
    chosen = cut_lineage(docs.where("id is not null").join(involved, "node").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct())
    id_col, text_col = src.columns
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_NODES else chosen
    texts = src.join(side, src[id_col] == side["id"], "left_semi")
    if docs.where("id is null and node is not null").limit(1).count():
        texts = texts.unionByName(src.where(F.col(id_col).isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in scan_words(batch.column(1), lower=True):
                rows, hashes, second = shingle_sets(words, shingle)
                n, a, b = _nodes(rows, hashes, second, words.n_rows)
                raw, bounds = hashes.tobytes(), np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_pydict({"node": _name(a, b), "shingles": [raw[8 * i : 8 * j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]})

    found = texts.mapInArrow(run, "node string, shingles binary")
    if docs.groupBy("id").count().where("count > 1").limit(1).count():  # repeated ids may bring a set twice, or one that nobody asked for
        found = found.join(involved, "node", "left_semi").groupBy("node").agg(F.min("shingles").alias("shingles"))
    return cut_lineage(found)


def _lists(sets: DataFrame, level_of: Callable[[np.ndarray], np.ndarray], percent: int, list_rows: int) -> DataFrame:
    """Lists of nodes by prefix shingle, without shingles that no other of these nodes has.

    Only nodes that share a prefix shingle at all can link, so a sketch of their sets
    alone says which shingles can be in common: ``most`` of a node's.  Without the
    others prefixes are shorter, and a pair needs a shingle in common within the first
    ``most - overlap + 1`` of both.  Wrongly kept shingles only make this weaker.
    Members of a list are in one order that all lists share, those that can overlap
    most first: they make the best leaders.  A list of over ``list_rows`` members is
    ranked in cuts of about that size, and the members of equal rank in their cuts
    follow each other; any order will do, so no task ever sorts a whole long list.
    """
    total = (sets.agg(F.sum(F.octet_length("shingles")).alias("b")).first()["b"] or 0) // 8
    width, depth = S.width_for(total, 4.0, OWN_CAP_BITS), 3
    blocks = min(width >> 3, 1 << max(3, int(np.ceil(np.log2(total / BLOCK_SHINGLES + 1)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = S.PartitionSketch(width, depth, blocks)
        for batch in batches:
            for one in batch.column(0):
                sketch.add(np.frombuffer(one.as_py(), np.uint64))
                if sketch.full(HELD_SHINGLES):
                    yield pa.RecordBatch.from_pydict(sketch.drain(), sketch.SCHEMA)
        yield pa.RecordBatch.from_pydict(sketch.drain(), sketch.SCHEMA)

    partials = sets.select("shingles").mapInArrow(count, "block int, slots binary, counts binary")
    shared = sets.sparkSession.sparkContext.broadcast(S.gather(S.merge(partials, width, blocks, S.at_least_two), blocks, depth, width // blocks // 8))
    schema = pa.schema([("token", pa.int64()), ("node", pa.string()), ("n", pa.int32()), ("pos", pa.int32()), ("most", pa.int32())])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, names, size, most_ = [], [], [], []
            for node, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(one.as_py(), np.uint64)
                common = own[S.repeated(shared.value, width, own)]
                length = len(common) - (len(own) * percent + 99) // 100 + 1
                if length > 0:
                    order = np.lexsort((common, level_of(common)))[:length]
                    tokens.append(common[order].view(np.int64))
                    names.append(node)
                    size.append(len(own))
                    most_.append(len(common))
            count_ = [len(t) for t in tokens]
            if tokens:
                pos = np.concatenate([np.arange(k) for k in count_])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), count_))), *(pa.array(np.asarray(x, np.int32)) for x in (np.repeat(size, count_), pos, np.repeat(most_, count_)))], schema=schema)

    rows = cut_lineage(sets.select("node", "shingles").mapInArrow(prefix, "token long, node string, n int, pos int, most int"))
    shared.destroy()
    sizes = rows.groupBy("token").agg(F.count("*").alias("members")).where(F.col("members") > list_rows)
    long = cut_lineage(sizes.select("token", "members", F.ceil(F.col("members") / list_rows).cast("int").alias("cuts")))
    dealt = rows.join(long, "token", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    dealt = dealt.withColumn("cut", F.pmod(F.xxhash64("node", F.lit("cut")), F.col("cuts")).cast("int"))
    by_cut = Window.partitionBy("token", "cut")
    order = by_cut.orderBy(F.col("n") - F.col("most"), F.xxhash64("node"), "node")
    ranked = dealt.withColumn("rank", (F.row_number().over(order) - 1) * F.col("cuts") + F.col("cut"))
    # For long lists a bound of the ranks is enough: rounds end when no list holds two components.
    ranked = ranked.withColumn("size", F.when(F.col("cuts") > 1, F.col("members") * F.col("cuts")).otherwise(F.count("*").over(by_cut)))
    return cut_lineage(ranked.where("size > 1").select("token", "node", "n", "pos", "most", "rank", "size"))


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            left, right = (batch.column(i) for i in (2, 3))
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_py(), np.uint64) for c in (left, right))
                total = len(x) + len(y)
                if total < 256 or _suffix_bound(x, y) * (100 + percent) >= percent * total:
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    ok[i] = 100 * common >= percent * (total - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "linked"])

    return verify


def _suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """An intersection can't exceed what the two have in common by hash range."""
    shift = np.uint64(58)
    return int(np.minimum(np.bincount((x >> shift).astype(np.int64), minlength=HISTOGRAM), np.bincount((y >> shift).astype(np.int64), minlength=HISTOGRAM)).sum())


def _link_rounds(spark: SparkSession, lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Node to component, for nodes with a link."""
    components: DataFrame | None = None
    links: DataFrame | None = None
    tested: DataFrame | None = None
    lo, hi = 0, 1
    while True:
        rows = lists.where(F.col("size") > lo + 1)
        if components is None:
            rows = rows.withColumn("component", F.col("node"))
        else:  # only lists that still hold two components go on
            rows = rows.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
            split = rows.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token")
            rows = cut_lineage(rows.join(split, "token", "left_semi"))
            lists = rows.drop("component")
        if not rows.limit(1).count():
            break
        lead = rows.where(F.col("rank").between(lo, hi - 1)).select("token", *(F.col(c).alias(f"l_{c}") for c in ("node", "n", "pos", "most", "rank", "component")))
        total = F.col("l_n") + F.col("n")
        needed = F.ceil(total * percent / (100 + percent) - 1e-9)
        # From the first shingle in common on, both must have enough that can be in common.
        follows = F.least(F.col("most") - F.col("pos"), F.col("l_most") - F.col("l_pos"))
        close = (F.col("rank") > F.col("l_rank")) & (F.col("component") != F.col("l_component")) & (F.least("n", "l_n") * 100 >= F.greatest("n", "l_n") * percent) & (follows >= needed)
        pairs = rows.join(lead, "token").where(close).select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        with_both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b").select("a", "b", "left", "right")
        verdicts = cut_lineage(with_both.mapInArrow(_verifier(percent), "a string, b string, linked boolean"))
        unlinked = verdicts.where("not linked").select("a", "b")
        tested = unlinked if tested is None else tested.unionByName(unlinked)
        found = verdicts.where("linked").select("a", "b")
        if found.limit(1).count():
            # What is known already stands as one edge from each node to its component.
            links = found if components is None else found.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b")))
            components = connected_components(links)
        lo, hi = hi, hi + (hi - lo) * LEADERS
    return components if components is not None else spark.createDataFrame([], "node string, component string")


def _named(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The smallest id and the component of each node."""
    by_node = docs.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    return by_node.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _labelled(docs: DataFrame, components: DataFrame, id_col: str) -> DataFrame:
    """The smallest id of each document's component."""
    named = _named(docs, components)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.join(least, "component").select("node", "component_id")
    out = docs.join(label, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_nodes(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``df`` and each row's node, null where the text has no words."""

    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node: list[str | None] = []
            for words in scan_words(batch.column(at).fill_null(""), lower=True):
                rows, hashes, second = shingle_sets(words, shingle)
                n, a, b = _nodes(rows, hashes, second, words.n_rows)
                node += [x if k else None for x, k in zip(_name(a, b), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.string())], [*batch.schema.names, "__node"])

    schema = StructType([*(StructField(f.name, f.dataType, f.nullable) for f in df.schema.fields), StructField("__node", StringType())])
    return df.mapInArrow(run, schema)


def keep_one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``df``, the least by id and text; all columns as they were.

    A null id comes after all others.  Rows without words are components of their own.
    """
    docs, components = _linked(df, id_col, text_col, **options)
    named = cut_lineage(_named(docs, components))
    least = named.groupBy("component").agg(F.min("least").alias("id"))
    keep = least.select("id").where("id is not null").unionByName(docs.where("node is null and id is not null").select("id")).distinct()
    repeated = docs.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    some_repeated = repeated.limit(1).count() > 0
    if some_repeated:
        keep = keep.join(repeated, "id", "left_anti")
    kept = df.join(keep, df[id_col] == keep["id"], "left_semi")
    # An id says which row is meant only if no other has it; for the others the node does.
    others = df.where(F.col(id_col).isNull())
    if some_repeated:
        others = others.unionByName(df.join(repeated, df[id_col] == repeated["id"], "left_semi"))
    elif not docs.where("id is null").limit(1).count():
        return kept
    own = cut_lineage(_with_nodes(others.withColumn(text_col, F.col(text_col).cast("string")), text_col, options.get("shingle", SHINGLE)))
    wordless = own.where("__node is null").select(*df.columns)
    best = own.join(named.select(F.col("node").alias("__node"), F.col("component").alias("__component")), "__node").join(least.select(F.col("component").alias("__component"), F.col("id").alias("__least")), "__component")
    best = best.where(F.col(id_col).cast("long").eqNullSafe(F.col("__least")))
    chosen = best.groupBy("__component").agg(F.min_by(F.struct(*(F.col(c) for c in df.columns)), text_col).alias("__row"))
    return kept.unionByName(wordless).unionByName(chosen.select("__row.*"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 4 over all of ``documents``."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows from all pairs that share a shingle, closed over links.
ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS MATERIALIZED (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
common AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (SELECT * FROM s SEMI JOIN rare USING (g)) a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) m USING (doc_id)
"""
