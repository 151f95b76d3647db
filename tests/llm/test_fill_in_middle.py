"""Fill-in-middle against a plain function of each text, and exact round trips."""

import hashlib
import re

import pytest

from quarrystone.llm import fill_in_middle as M


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), out, text


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "täxt mit ümläut\nпривет\n你好\n🙂 x", "x<P>y\nz", "<S>\n", "ends <\n<M\nP>\n>S<\n", "a\r\nb\x0bc\n", "<P\n>\n<", "S>\n<S\nM>",
    "\n".join(f"line {i} " + "word " * (i % 40) for i in range(9000)), "one unbroken line " * 20_000, "ü" * 70_000 + "\n" + "b" * 40_000,
]


def rows():
    out = [(i, t) for i, t in enumerate(TEXTS * 6)]
    return out + [(5, "same id, other text\nx\ny"), (4, TEXTS[4]), (4, TEXTS[4]), (None, "no id\nat all\n"), (None, "no id\nat all\n"), (None, None), (14, TEXTS[14])]


@pytest.mark.parametrize("rates", [M.Rates(), M.Rates(40, 90)])
def test_against_a_plain_function(spark, rates):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows()], "doc_id long, text string, n long, key string").repartition(5)
    got = M.fill_in_middle(df, rates=rates, keep_text=True).collect()
    want = [plain(*r, rates.transformed, rates.suffix_first) for r in rows()]
    told = lambda r: (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["output_sha256"], r["restored_sha256"])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(told, got), key=str) == sorted(((*w[:6], sha(w[5]), sha(w[6])) for w in want), key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(sha(M.restore_text(r["output"], r["form"])) == r["restored_sha256"] for r in got)


def test_pieces_are_bounded_and_exchanged_once(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    pieces = M.output_pieces(df)
    import zstandard

    longest = max(len(zstandard.ZstdDecompressor().decompress(bytes(r["data"]))) for r in pieces.select("data").collect())
    assert longest <= M.PIECE_BYTES + 3
    plan = M.fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


def test_empty_table(spark):
    none = M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert none.collect() == [] and none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
