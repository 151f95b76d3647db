import numpy as np

from quarrystone.llm import licenses

MIT = licenses.TEMPLATES["MIT"].split()


def _found(spark, text):
    rows = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return [(r["license"], r["coverage"], text[r["start"] : r["end"]]) for r in rows]


def test_many_words_added_at_one_place(spark):
    text = " ".join([*MIT[:50], *(f"extra{i}" for i in range(20)), *MIT[50:]])
    assert [(n, c) for n, c, _ in _found(spark, text)] == [("MIT", 1.0)]


def test_many_words_missing_at_one_place(spark):
    text = " ".join([*MIT[:45], *MIT[57:]])
    found = _found(spark, text)
    assert [n for n, _, _ in found] == ["MIT"] and 0.8 < found[0][1] < 1


def test_a_marker_on_every_line(spark):
    text = "\n".join("dnl REM " + " ".join(MIT[i : i + 8]) for i in range(0, len(MIT), 8))
    assert [(n, c) for n, c, _ in _found(spark, text)] == [("MIT", 1.0)]


def test_copies_on_successive_lines(spark):
    for n in (1, 2, 3, 40):
        for between in ("\n", "\nand "):
            text = between.join(["Released under the MIT License."] * n)
            assert _found(spark, text) == [("MIT line", 1.0, "Released under the MIT License")] * n


def test_whole_notices_one_after_another(spark):
    text = "\n".join([" ".join(MIT), " ".join(MIT[:60] + MIT[70:]), " ".join(MIT)])
    assert [n for n, _, _ in _found(spark, text)] == ["MIT"] * 3


def _brute(text, want):
    """The best score of a local alignment that begins at each word, by the plain recurrence; a match is 2, all else -1."""
    best = {}
    for begin in range(len(text)):
        top = (0, 0, begin)
        for skip in range(len(want)):  # the alignment opens with a match at (begin, skip)
            if text[begin] != want[skip]:
                continue
            score = [[None] * (len(want) - skip + 1) for _ in range(len(text) - begin + 1)]
            score[1][1] = (2, 1)
            top = max(top, (2, 1, begin + 1))
            for i in range(1, len(text) - begin + 1):
                for j in range(1, len(want) - skip + 1):
                    if (i, j) == (1, 1):
                        continue
                    same = text[begin + i - 1] == want[skip + j - 1]
                    options = [(x[0] + d, x[1] + m) for x, d, m in ((score[i - 1][j - 1], 2 if same else -1, int(same)), (score[i - 1][j], -1, 0), (score[i][j - 1], -1, 0)) if x and x[0] > 0]
                    score[i][j] = max(options) if options else None
                    if score[i][j] and same and score[i][j][0] > top[0]:
                        top = (score[i][j][0], score[i][j][1], begin + i)
        best[begin] = top
    return best


def test_best_alignments_against_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(150):
        want = rng.integers(0, 6, rng.integers(3, 9))
        text = rng.integers(0, 6, rng.integers(3, 16))
        brute = _brute(text.tolist(), want.tolist())
        found = licenses._best_alignments(text.astype(np.uint64), want.astype(np.uint64), [(-len(want), len(text))])
        assert max(x[0] for x in found) == max(x[0] for x in brute.values()) if found else not any(x[0] for x in brute.values())
        for score, matched, begin, end in found:
            assert 0 < score <= brute[begin][0] and matched <= len(want) and begin < end


def test_whole_texts(spark):
    for name in ("MIT text", "BSD-3-Clause text", "ISC text", "Zlib text", "Unlicense text"):
        found = _found(spark, "intro words\n" + licenses.TEMPLATES[name] + "\nand more")
        assert (name, 1.0) in [(n, c) for n, c, _ in found], name


def test_bands_against_all_diagonals():
    """Notices with words changed, added in one place or taken away, between words of their own kind."""
    rng = np.random.default_rng(5)
    n_found = n_wide = 0
    for _ in range(300):
        size = int(rng.integers(8, 60))
        want = rng.integers(0, 40, size).astype(np.uint64)
        parts = [rng.integers(0, 50, rng.integers(0, 40)).astype(np.uint64)]
        for _ in range(int(rng.integers(1, 4))):
            copy = want.copy()
            copy[rng.random(size) < rng.choice([0, 0.1])] = 99
            cut = int(rng.integers(0, size))
            added = rng.integers(0, 60, rng.choice([0, 3, size // 2, size])).astype(np.uint64)
            parts += [copy[:cut], added, copy[cut + int(rng.choice([0, size // 8])) :], rng.integers(0, 50, rng.integers(0, 40)).astype(np.uint64)]
        text = np.concatenate(parts)
        runs = {tuple(want[i : i + 3].tolist()): i for i in range(size - 2)}
        hits = [(w, w - runs[key]) for w in range(len(text) - 2) if (key := tuple(text[w : w + 3].tolist())) in runs]
        whole = licenses.align(text, want, hits, band=2 * size)
        assert licenses.align(text, want, hits, band=1) == licenses.align(text, want, hits) == whole
        n_found += len(whole)
        n_wide += sum(end - begin > 1.4 * size for _, begin, end in whole)
    assert n_found > 300 and n_wide > 20


def test_bands_do_not_touch():
    assert licenses._bands(np.array([30, 5, 6, 30, 10]), 2) == [(3, 12), (28, 32)]
    assert licenses._bands(np.array([0, 5]), 2) == [(-2, 2), (3, 7)] and licenses._bands(np.array([0, 4]), 2) == [(-2, 6)]
