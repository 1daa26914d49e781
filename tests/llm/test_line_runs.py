import random
import re

from lettermill.llm import line_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def got(spark, rows, min_words):
    df = spark.createDataFrame([(d, t, 1, "z", 0) for d, t in rows], "doc_id bigint, text string, i int, row string, gone int")
    return sorted(map(tuple, line_runs.without_runs(df, min_words=min_words).collect()), key=repr)


def brute_maximal(rows, min_words):
    """At every place the longest run that stood earlier, deleted as a whole if it has enough words."""
    docs = {}
    for d, t in rows:
        docs.setdefault((d, t or ""), (t or "").split("\n"))
    places = [(key, i) for key in sorted(docs) for i in range(len(docs[key]))]
    at = {}
    gone = {key: set() for key in docs}
    for key, i in places:
        lines, longest = docs[key], 0
        for other, j in at.setdefault(lines[i], []):
            n = 0
            while i + n < len(lines) and j + n < len(docs[other]) and lines[i + n] == docs[other][j + n]:
                n += 1
            longest = max(longest, n)
        at[lines[i]].append((key, i))
        if longest and sum(len(WORD.findall(x)) for x in lines[i : i + longest]) >= min_words:
            gone[key].update(range(i, i + longest))
    out = []
    for d, t in rows:
        lines, cut = docs[(d, t or "")], gone[(d, t or "")]
        kept = "\n".join(x for i, x in enumerate(lines) if i not in cut)
        out.append((d, len(lines), len(cut), sum(len(WORD.findall(lines[i])) for i in cut), kept))
    return sorted(out, key=repr)


def test_maximal_runs(spark):
    def passage(name, *sizes):
        return [" ".join(f"{name}{i}_{j}" for j in range(n)) for i, n in enumerate(sizes)]

    # A run of 36 words with windows of 24, and runs whose ends have few words.
    runs = [passage("a", 12, 12, 12), passage("b", 45, 3, 2), passage("c", 40, 1, 1, 1, 5, 5, 5), passage("e", 2, 3, 45), passage("f", 8, 8, 8)]
    rows = [(i, "\n".join([f"own {i}", *run, f"end {i}"])) for i, run in enumerate(runs * 2)]
    assert [n for _, _, n, _, _ in sorted(got(spark, rows, 25))] == [0] * 5 + [3, 3, 7, 3, 0]


def test_maximal_runs_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "one line"), (4, "one line"), (4, "one line"), (4, "other\none line")]
    rows += [(i, "\n".join(rng.choice(["a b", "c", "d e f", "", " ", "g h"]) for _ in range(rng.randrange(1, 25)))) for i in range(10, 40)]
    passage = [f"line {i} of a passage" for i in range(11)]
    for i in range(50, 56):
        own = [f"own {i} {j}" for j in range(6)]
        rows.append((i, "\n".join(own[:3] + passage[i - 50 :] + own[3:])))
    rows += [(60, "\n".join(passage * 3)), (61, "x " * 30_000 + "\n" + "y"), (62, "x " * 30_000 + "\n" + "z")]
    rows += [(70, "head\n" + "\n" * 300 + "tail of it"), (71, "head\n" + "\n" * 300 + "tail of it")]
    for least in (0, 1, 4, 25):
        assert got(spark, rows, least) == brute_maximal(rows, least)


def test_rows_without_id_come_last(spark):
    rows = [(None, "same words here\nmine"), (7, "same words here\nyours")]
    result = {d: (n, text) for d, _, n, _, text in got(spark, rows, 3)}
    assert result == {7: (0, "same words here\nyours"), None: (1, "mine")}


def test_empty_table(spark):
    assert got(spark, [], 5) == []
