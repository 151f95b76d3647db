"""The filter audit against plain loops over the orders, and the matrix against counters of words."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np

from quarrystone.llm import filter_audit as M
from quarrystone.llm.sketches import unpack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made():
    rng = random.Random(4)
    texts = [None, "", " ", "\x0b\x0c", "Ää b c\u0085d e", " lead", "trail \n", "A B C", "a" * 60_000, "x\x1cy\x1fz x\x1cy", "#", "a|b", "word " * 400, "\n".join(f"w{i}" for i in range(5000))]
    for _ in range(120):
        words = [rng.choice(["tok", "Other", "möre", "x%", f"n{rng.randrange(200)}", f"v{rng.random()}"]) for _ in range(rng.choice([3, 150, 199, 200, 201, 320]))]
        texts.append(rng.choice([" ", "\n", "\t ", "\r\n"]).join(words))
    rows = [(i, t, rng.choice(["a", "b", "", None])) for i, t in enumerate(texts)]
    rows += [(500 + i, rng.choice(texts), rng.choice(["a", "c"])) for i in range(60)]
    return rows + [(3, "repeated id", "a"), (3, "repeated id", "a"), (None, "tok", "b"), (None, "tok", "b"), (700, "tok", "b")]


LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 560, 2)] + [(1, None, 1), (None, 1, 1), (4, 0, 0), (4, 1, 0), (600, 1, 1)]


def brute(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i), strict=True) if bad}
        fails.append((part or "", f, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, name in enumerate(order):
                gone = [x for x in left if name in x[1]]
                shapley[part, name] += len(gone)
                left = [x for x in left if name not in x[1]]
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(name in x[1] and bool(x[1] & set(order[:k])) for x in own), sum(x[1] == {name} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_against_loops(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, fails int").repartition(3)
    labels = spark.createDataFrame([(*r, "p") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    assert sorted(tuple(r) for r in M.audit(M.failures(docs), labels).collect()) == brute(rows, LABELS)


def test_small_batches_and_many_groups(spark):
    """One row a batch, so a shard for each document, and equal codes for equal words all the same."""
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        shards = M.term_matrix(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(shards) == len(rows)
    word_of, entries = defaultdict(set), 0
    by_id = defaultdict(list)
    for s in shards:
        indptr, codes, counts = (unpack(bytes(s[x]), k) for x, k in (("indptr", "int64"), ("indices", "int64"), ("counts", "int32")))
        assert len(np.unique(codes)) == len(codes) == indptr[-1]
        by_id[s["ids"][0]].append(sorted(zip(codes.tolist(), counts.tolist(), strict=True)))
    texts = {i: t for i, t, _ in rows if i is not None and i != 3}
    seen = defaultdict(set)
    for i, t in texts.items():
        count = Counter(WORD.findall(t or ""))
        assert sorted(count.values()) == sorted(c for _, c in by_id[i][0])
        for w in count:
            seen[w].add(i)
    for i, t in texts.items():  # a document's codes are in just the documents that have its words
        for code, _ in by_id[i][0]:
            word_of[code].add(i)
            entries += 1
    assert entries and Counter(map(frozenset, word_of.values())) == Counter(map(frozenset, seen.values()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert M.audit(M.failures(docs), labels).collect() == []
    one = M.audit(M.failures(spark.createDataFrame([(1, "a", None)], docs.schema)), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and {r["good_lost"] for r in one} == {0}
