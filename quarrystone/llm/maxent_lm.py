"""Language-model scoring with a hashed maximum-entropy model (operator 6).

P(word | history) = P(class | history) * P(subclass | class, history) * P(word | subclass).
A word's class comes from its last two bytes, its subclass from its hash.  The first
two factors are softmaxes over 16 outcomes whose weights are looked up by hashed
features of the history: the previous word, the word before it (a skip) and the pair of
both, for the class also the previous word's class; within a class the class is part
of every feature.  The last factor is the subclass's own smoothed unigram, the
maximum-entropy solution that has only a bias: the vocabulary is open, so words
have no weights of their own.

Counts: every partition sends the distinct words of each chunk of documents by range
of word hash; a group per range adds up the training counts and answers each chunk
with the counts of the words it has, so no vocabulary is broadcast or collected.

Training: in each round the tasks start from the shared weights, run minibatch
gradient steps over their own training documents, and send what changed by blocks of
rows.  Changes are added up in two steps, first by block and part of the tasks, then
by block, and each row's sum is divided by the gradients that touched this row, so a
row that one task alone has seen keeps all it learned, however many tasks there are.
Every training document is used in exactly one round.  Since each task takes its own
minibatches, weights depend a little on how the input is split into tasks.

The weight table has about ``ROWS_PER_ROOT`` rows for the square root of the corpus's
tokens, as the number of different histories grows less than the text does, up to
2 ** ``cap_bits``: that is the bound of what every task gets and of what the driver
holds.  Tasks read at least ``TABLES_PER_TASK`` times the table's size, so messages stay
below the input.  Scoring gathers rows of the weights in numpy batches.

Defined results: null and empty texts are one token, the end; rows are independent,
so repeated rows count as often as they stand; a null id is in training; with no
training documents every word is unknown and all classes are equally likely; an empty
table gives an empty table; columns beside id and text aren't looked at; a very long
text is scored in one piece, which takes about 400 bytes of memory for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import sketches as S
from quarrystone.llm.tables import cut_lineage
from quarrystone.llm.textblocks import Words, mix64, scan_words

CLASSES = 16
SUBCLASSES = 16  # of each class; both are the width of a row of weights
LEAVES = CLASSES * SUBCLASSES
BYTES_PER_TOKEN = 6  # only to size the table
ROWS_PER_ROOT = 16
LEAST_BITS, CAP_BITS = 14, 22  # 2 ** 22 rows are 256 MB
TABLES_PER_TASK = 2
BLOCK_ROWS = 4096  # rows of weights in one message
ROUNDS = 2
BATCH = 8192
RATE = 0.15
GROUP_BYTES = 16_000_000
HELD_ENTRIES = 1_500_000
BLOCK_BYTES = 8_000_000  # text bytes behind one range of word hashes

_ONES = np.ones((CLASSES, 1), np.float32)
_U = np.uint64
_END = _U(0x0E9D_0E9D_0E9D_0E9D)
_BEGIN = _U(0xBE61_4BE6_14BE_614B)


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, classes and counts by row of the words and one end a row."""
    last = words.data[words.end - 1].astype(np.int64)
    second = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
    classes = (1 + (last * 31 + second * 7) % (CLASSES - 1)).astype(np.uint8)
    return np.insert(words.hash, words.row_end, _END), np.insert(classes, words.row_end, 0), words.counts + 1


def _subclasses(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> _U(40)) % _U(SUBCLASSES)).astype(np.uint8)


def _features(hashes: np.ndarray, classes: np.ndarray, counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for every token: hashed features of its history, four for its class and three within it."""
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    one, two, of = np.empty_like(hashes), np.empty_like(hashes), np.empty_like(classes)
    one[1:], of[1:] = hashes[:-1], classes[:-1]
    one[begin], of[begin] = _BEGIN, CLASSES
    two[1:] = one[:-1]
    two[begin] = _BEGIN
    own = [one + _U(1), two + _U(2), one * _U(3) + mix64(two), of.astype(np.uint64) + _U(4)]
    mask = _U(rows - 1)
    salt = (classes.astype(np.uint64) + _U(1)) * _U(0x9E37_79B9_7F4A_7C15)
    within = [own[0] ^ salt, own[1] ^ salt, own[2] ^ salt]
    return tuple(np.stack([(mix64(x) & mask).astype(np.int32) for x in some], axis=1) for some in (own, within))


def _log_softmax(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    logits = weights.take(features[:, 0], axis=0)
    for k in range(1, features.shape[1]):
        logits += weights.take(features[:, k], axis=0)
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits) @ _ONES)
    return logits


class Trainer:
    """Minibatch gradient steps with a rate that falls with each row's own gradients."""

    def __init__(self, weights: np.ndarray) -> None:
        self.start = weights
        self.weights = weights.copy()
        self.touched = np.zeros(len(weights), np.int64)
        self.tokens = 0

    def learn(self, features: np.ndarray, outcomes: np.ndarray) -> None:
        for a in range(0, len(outcomes), BATCH):
            f, c = features[a : a + BATCH], outcomes[a : a + BATCH]
            gradient = np.exp(_log_softmax(self.weights, f))
            gradient[np.arange(len(c)), c] -= 1.0
            # Row and token in one number: a plain sort brings the gradients of a row together.
            keys = (f.astype(np.int64) * BATCH + np.arange(len(c))[:, None]).ravel()
            keys.sort()
            rows = keys // BATCH
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            step = np.add.reduceat(gradient.take(keys % BATCH, axis=0), first, axis=0)
            rows, n = rows[first], np.diff(np.append(first, len(rows)))
            seen = self.touched[rows] + n
            self.touched[rows] = seen
            self.weights[rows] = self.weights.take(rows, axis=0) - step * (RATE / np.sqrt(1.0 + seen)).astype(np.float32)[:, None]
            self.tokens += len(c)

    def messages(self, pid: int) -> pa.RecordBatch:
        """What changed and how often, by blocks of rows."""
        blocks = len(self.weights) // BLOCK_ROWS
        change, touched = (np.split(x, blocks) for x in (self.weights - self.start, self.touched))
        used = [i for i in range(blocks) if touched[i].any()]
        return pa.RecordBatch.from_pydict({"block": pa.array(used, pa.int32()), "pid": pa.array([pid] * len(used), pa.int32()), "touches": pa.array([S.pack(touched[i]) for i in used], pa.binary()), "change": pa.array([S.pack(change[i].ravel().astype(np.float16)) for i in used], pa.binary())})


def table_rows(tokens: int, cap_bits: int = CAP_BITS) -> int:
    """Rows of the weight table for a corpus of so many tokens."""
    return 1 << min(cap_bits, max(LEAST_BITS, int(np.ceil(np.log2(ROWS_PER_ROOT * np.sqrt(max(1, tokens)))))))


def _added(table: pa.Table, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of each row of a block, and the sum of the changes, each times its gradients."""
    total, change = np.zeros((BLOCK_ROWS, 1), np.int64), np.zeros((BLOCK_ROWS, CLASSES), np.float64)
    table = table.sort_by("pid")  # sums in one order, whatever arrived first
    for touches, packed in zip(table.column("touches").to_pylist(), table.column("change").to_pylist(), strict=True):
        n = S.unpack(touches, "int64").reshape(BLOCK_ROWS, 1)
        own = S.unpack(packed, dtype).astype(np.float64).reshape(BLOCK_ROWS, CLASSES)
        change += n * own
        total += n
    return total, change / np.maximum(total, 1)


def train(src: DataFrame, rounds: int = ROUNDS, rows: int = 1 << LEAST_BITS, tasks: int | None = None) -> np.ndarray:
    """Weights from the training documents of (g, id, held_out, body), in at most so many tasks."""
    spark = src.sparkSession
    weights = np.zeros((rows, CLASSES), np.float32)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(weights)  # rows * CLASSES numbers, bounded by cap_bits

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value)
            for batch in batches:
                for words in scan_words(batch.column(0), lower=True):
                    hashes, classes, counts = _tokens(words)
                    for features, outcomes in zip(_features(hashes, classes, counts, rows), (classes, _subclasses(hashes)), strict=True):
                        trainer.learn(features, outcomes)
            if trainer.tokens:
                yield trainer.messages(TaskContext.get().partitionId())

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total, mean = _added(table, "float16")
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "pid": pa.array([key[1].as_py()], pa.int32()), "touches": pa.array([S.pack(total.ravel())], pa.binary()), "change": pa.array([S.pack(mean.ravel().astype(np.float32))], pa.binary())})

        def average(key: tuple, table: pa.Table) -> pa.Table:
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "mean": pa.array([_added(table, "float32")[1].astype(np.float32).tobytes()], pa.binary())})

        part = src.where(~F.col("held_out") & (F.pmod(F.xxhash64("id", F.lit("round")), F.lit(rounds)) == r)).select("body")
        if tasks:
            part = part.coalesce(tasks)
        parts = max(1, int(np.sqrt(tasks or part.rdd.getNumPartitions())))
        sent = part.mapInArrow(run, "block int, pid int, touches binary, change binary")
        some = sent.withColumn("some", F.col("pid") % parts).groupBy("block", "some").applyInArrow(add, "block int, pid int, touches binary, change binary")
        means = some.groupBy("block").applyInArrow(average, "block int, mean binary").collect()  # the table, once
        weights = weights.copy()
        for block, mean in means:
            weights[block * BLOCK_ROWS : (block + 1) * BLOCK_ROWS] += np.frombuffer(mean, np.float32).reshape(BLOCK_ROWS, CLASSES)
    return weights


def _prepared(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = df.agg(F.sum(F.octet_length(body)).alias("bytes")).first()["bytes"] or 0
    chunks = int(max(8, size // GROUP_BYTES))
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))
    # Repeated ids and null ids must not make one chunk large, so the text takes part.
    src = df.select(F.pmod(F.xxhash64(F.col(id_col), F.substr(body, F.lit(1), F.lit(64))), F.lit(chunks)).cast("int").alias("g"), F.col(id_col).alias("id"), held_out.alias("held_out"), body.alias("body"))
    return src, chunks, size


def _chunk_counts(src: DataFrame, size: int) -> DataFrame:
    """Answers to chunks (g, hashes, counts), and with g = -1 the totals of each range (counts: words and distinct words by subclass)."""
    blocks = np.uint64(max(8, size // BLOCK_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        entries = 0

        def distinct() -> tuple:
            g, h, c, n = (np.concatenate([x[i] for x in held]) for i in range(4))
            order = np.lexsort((g, h))
            g, h, c, n = g[order], h[order], c[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
            return g[first], h[first], c[first], np.add.reduceat(n, first).astype(np.uint32)

        def drain() -> pa.RecordBatch:
            g, h, c, n = distinct()
            held.clear()
            block = ((h >> _U(32)) % blocks).astype(np.int32)
            order = np.argsort(block, kind="stable")
            block, g, h, c, n = block[order], g[order], h[order], c[order], n[order]
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            span = list(zip(cuts[:-1], cuts[1:], strict=True))
            return pa.RecordBatch.from_pydict({"block": block[cuts[:-1]], "h": [S.pack_sorted(h[a:b]) for a, b in span], **{k: [S.pack(v[a:b]) for a, b in span] for k, v in (("g", g), ("c", c), ("n", n))}})

        for batch in batches:
            g_of, held_out = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for words in scan_words(batch.column(2), lower=True):
                hashes, classes, counts = _tokens(words)
                rows = words.first_row + np.repeat(np.arange(words.n_rows), counts)
                held.append((g_of[rows].astype(np.int32), hashes, classes, (~held_out[rows]).astype(np.uint32)))
                entries += len(hashes)
                if entries > 2 * HELD_ENTRIES:
                    held[:] = [distinct()]
                    entries = len(held[0][0])
                    if entries > HELD_ENTRIES:
                        yield drain()
                        entries = 0
        if held:
            yield drain()

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        parts = [(S.unpack_sorted(h, "uint64"), S.unpack(g, "int32"), S.unpack(c, "uint8"), S.unpack(n, "uint32")) for h, g, c, n in zip(*(table.column(x).to_pylist() for x in ("h", "g", "c", "n")), strict=True)]
        h, g, c, n = (np.concatenate([x[i] for x in parts]) for i in range(4))
        order = np.lexsort((g, h))
        h, g, c, n = h[order], g[order], c[order], n[order].astype(np.int64)
        word = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total = np.add.reduceat(n, word)
        known = total > 0
        leaf = c[word].astype(np.int64) * SUBCLASSES + _subclasses(h[word])
        by_leaf = np.bincount(leaf, weights=total, minlength=LEAVES), np.bincount(leaf[known], minlength=LEAVES)
        every = np.repeat(total, np.diff(np.append(word, len(h))))
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
        h, g, every = h[first], g[first], every[first]
        order = np.argsort(g, kind="stable")
        h, g, every = h[order], g[order], every[order]
        cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        span = list(zip(cuts[:-1], cuts[1:], strict=True))
        out_g = [-1, *g[cuts[:-1]].tolist()]
        return pa.table({"g": pa.array(out_g, pa.int32()), "hashes": pa.array([b"", *(S.pack_sorted(h[a:b]) for a, b in span)], pa.binary()), "counts": pa.array([np.concatenate(by_leaf).astype(np.int64).tobytes(), *(S.pack(every[a:b].astype(np.uint64)) for a, b in span)], pa.binary())})

    asked = src.select("g", "held_out", "body").mapInArrow(ask, "block int, h binary, g binary, c binary, n binary")
    return cut_lineage(asked.groupBy("block").applyInArrow(answer, "g int, hashes binary, counts binary"))


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, cap_bits: int = CAP_BITS) -> DataFrame:
    """Train on the documents that aren't held out and score all of them."""
    spark = df.sparkSession
    src, _, size = _prepared(df, id_col, text_col)
    answers = _chunk_counts(src, size)
    totals = np.zeros(2 * LEAVES, np.int64)
    for (one,) in answers.where("g = -1").select("counts").toLocalIterator():  # 2 * LEAVES numbers a range of word hashes
        totals += np.frombuffer(one, np.int64)
    in_leaf, distinct = totals[:LEAVES], totals[LEAVES:]
    n_train, vocabulary = int(in_leaf.sum()), int(distinct.sum())
    rows = table_rows(size // BYTES_PER_TOKEN, cap_bits)
    shared = spark.sparkContext.broadcast(train(src, rounds, rows, max(1, size // (TABLES_PER_TASK * 4 * CLASSES * rows))))

    def score(texts: pa.Table, replies: pa.Table) -> pa.Table:
        weights = shared.value
        h = np.concatenate([np.zeros(0, np.uint64), *(S.unpack_sorted(x, "uint64") for x in replies.column("hashes").to_pylist())])
        c = np.concatenate([np.zeros(0, np.uint64), *(S.unpack(x, "uint64") for x in replies.column("counts").to_pylist())])
        order = np.argsort(h)
        h, c = h[order], c[order]
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for words in scan_words(texts.column("body"), lower=True):
            hashes, classes, counts = _tokens(words)
            subs = _subclasses(hashes)
            found = c[np.searchsorted(h, hashes)].astype(np.float64)
            base = np.log10((found + 0.5) / (n_train + 0.5 * (vocabulary + 1)))
            leaf = classes.astype(np.int64) * SUBCLASSES + subs
            own = np.log10((found + 0.5) / (in_leaf[leaf] + 0.5 * (distinct[leaf] + 1)))
            for features, outcomes in zip(_features(hashes, classes, counts, rows), (classes, subs), strict=True):
                for a in range(0, len(hashes), BATCH):
                    part = outcomes[a : a + BATCH]
                    own[a : a + BATCH] += _log_softmax(weights, features[a : a + BATCH])[np.arange(len(part)), part] / np.log(10.0)
            begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
            for column, values in zip(columns, (counts, np.add.reduceat((found > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(own, begin)), strict=True):
                column.append(values)
        n, known, base, score_ = (np.concatenate(x) if x else np.zeros(0) for x in columns)
        return pa.table({"id": texts.column("id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n_train] * len(n), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(np.round(score_, 6), pa.float64())})

    id_type = dict(src.dtypes)["id"]
    out = src.groupBy("g").cogroup(answers.where("g >= 0").groupBy("g")).applyInArrow(score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 6 over all of ``documents``."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The base columns by brute force.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), ' end') AS w, held FROM documents JOIN held USING (doc_id)),
t AS (SELECT doc_id, held, unnest(w) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held GROUP BY x),
s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held) AS held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, any_value(s.n)::BIGINT AS train_tokens, sum(log10((coalesce(c.c, 0) + 0.5) / (s.n + 0.5 * (s.v + 1)))) AS base_score
FROM t LEFT JOIN c USING (x), s GROUP BY doc_id
"""
