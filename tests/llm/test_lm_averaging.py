import numpy as np

from quarrystone.llm import maxent_lm

SCHEMA = "id long, held_out boolean, body string"


def _weights(spark, rows, partitions):
    return maxent_lm.train(spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), SCHEMA), rounds=1, tasks=partitions)


def test_a_row_of_one_task_keeps_what_it_learned(spark):
    rare = [(1, False, "odd pair of words here " * 40)]
    others = [(i, False, f"plain{i} text{i} again " * 40) for i in range(2, 9)]
    alone, without, amid = (_weights(spark, x, len(x)) for x in (rare, others, rare + others))
    only = np.any(alone != 0, axis=1) & np.all(without == 0, axis=1)
    assert only.sum() >= 8 and np.abs(alone[only]).max() > 0.1
    assert np.allclose(amid[only], alone[only], atol=2e-3)


def test_the_table_grows_with_the_corpus():
    sizes = [maxent_lm.table_rows(n) for n in (0, 10**7, 10**8, 10**10, 10**14)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[1] < sizes[2] < sizes[3] and sizes[-1] == 1 << maxent_lm.CAP_BITS


def test_held_out_texts_against_unigrams_and_bigrams(spark):
    """Score a token: the model is better than the base; bigrams that remember whole words are better still on a corpus with many copies."""
    import math
    import zlib
    from collections import Counter

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = [(i, [w for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).split() if w] + ["</s>"]) for i, t in docs]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    one, two, before = Counter(), Counter(), Counter()
    for i, w in rows:
        if i not in held:
            one.update(w)
            pairs = list(zip(["<s>", *w[:-1]], w))
            two.update(pairs)
            before.update(a for a, _ in pairs)
    n, v = sum(one.values()), len(one)
    unigram = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    tokens = base = bigram = 0.0
    for i, w in rows:
        if i in held:
            tokens += len(w)
            base += sum(math.log10(unigram(x)) for x in w)
            bigram += sum(math.log10((two[a, x] + 20 * unigram(x)) / (before[a] + 20)) for a, x in zip(["<s>", *w[:-1]], w))
    got = maxent_lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "n_tokens": "sum"}).first()
    model = got["sum(score)"] / got["sum(n_tokens)"]
    print(f"held out, log10 a token: base {base / tokens:.4f}, bigrams {bigram / tokens:.4f}, model {model:.4f}")
    assert model > base / tokens
