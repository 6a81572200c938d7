"""Runs of lines that count from three lines or from a number of words on."""

import collections
import random

from tremorframe.llm import line_runs
from test_dedup import table

STRIP = "".join(chr(c) for c in (0x20, *range(9, 14)))


def words_brute(rows, run_lines, run_words):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(STRIP)]
        gone = set()
        for k in range(len(full)):
            for n in range(1, min(run_lines, len(full) - k) + 1):
                window = tuple(lines[full[j]].strip(STRIP) for j in range(k, k + n))
                if n < run_lines and sum(len(x.split()) for x in window) < run_words:
                    continue
                if window in seen:
                    gone |= set(range(k, k + n))
                seen.add(window)
        dead = {full[k] for k in gone}
        out[doc] = (len(full), len(dead), sum(k - 1 not in gone for k in gone), "\n".join(x for i, x in enumerate(lines) if i not in dead))
    return out


def removed(spark, rows, **options):
    got = line_runs.remove_repeated_runs(table(spark, rows), **options).collect()
    return {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.text) for r in got}


def test_a_long_line_is_a_run_of_its_own(spark):
    long = " ".join(f"w{i}" for i in range(50))
    short = " ".join(f"w{i}" for i in range(49))
    halves = " ".join(f"a{i}" for i in range(30)) + "\n" + " ".join(f"b{i}" for i in range(20))
    rows = [(1, f"x\n{long}\ny"), (2, f"p\n{long}\nq"), (3, long), (4, short), (5, short), (6, f"{halves}\nr"), (7, f"s\n\n{halves}")]
    got = removed(spark, rows, run_words=50)
    assert got == words_brute(rows, 3, 50)
    assert [got[i][1] for i in range(1, 8)] == [0, 1, 1, 0, 0, 0, 2] and got[2][3] == "p\nq"
    assert not any(r[1] for r in removed(spark, rows).values())


def test_runs_by_lines_or_words_equal_brute_force(spark):
    rng = random.Random(5)
    pool = ["a", "b", "c d", "e f g", "h i j k", "", "  l m", "n\to p q r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    for run_words in (1, 4, 6):
        assert removed(spark, rows, run_words=run_words) == words_brute(rows, 3, run_words)


def test_edge_rows_with_words(spark):
    rows = [(1, None), (None, "a b"), (2, "a b"), (2, "a b"), (3, "a b"), (4, "")]
    got = collections.Counter((r.doc_id, r.n_removed, r.text) for r in line_runs.remove_repeated_runs(table(spark, rows), run_words=2).collect())
    assert got == collections.Counter({(1, 0, None): 1, (None, 1, ""): 1, (2, 0, "a b"): 2, (3, 1, ""): 1, (4, 0, ""): 1})
    assert line_runs.remove_repeated_runs(table(spark, rows).limit(0), run_words=2).count() == 0
