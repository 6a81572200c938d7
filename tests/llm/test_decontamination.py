"""Benchmark decontamination against brute force."""

import collections
import hashlib
import random
import re

import pytest

from tremorframe.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id long, text string, id string, row long, places int, items int, class string"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, window=10):
    wanted = collections.defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[k:k + n])].add("" if i is None else str(i))
    sizes = {len(w) for w in wanted}
    out = collections.Counter()
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (held := wanted.get(tuple(w[k:k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= held
        out[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


def run(spark, tmp_path, docs, items):
    spark.createDataFrame([(i, t, "x", 1, 2, 3, "c") for i, t in docs], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, 5, "d") for i, t in items], "item_id long, text string, words int, digest string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return collections.Counter(map(tuple, dc.op11_decontamination(spark, str(tmp_path)).collect()))


def texts(rng, vocabulary, n, longest):
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("short", [False, True])
def test_equals_brute_force(spark, tmp_path, short):
    rng = random.Random(short)
    common = [f"w{i}" for i in range(60)] + ["Été", "日本", "A1b", "x-y", "don't"]
    passages = [" ".join(rng.choice(common) for _ in range(rng.randint(10, 30))) for _ in range(8)]
    items = [(i % 12 if i % 7 else None, rng.choice(passages) + " " + t) for i, t in enumerate(texts(rng, common, 20, 8))]
    items += [(50, passages[0]), (51, passages[0]), (52, None), (53, "--- ..."), (53, "")]
    if short:
        items += [(60, "w1 w2 w3"), (61, "W5"), (62, "w7 w8 w9 w7 w8 w9 w7"), (63, "w3 w3")]
    docs = [(i, a + rng.choice(["\n", " -- ", "."]) + rng.choice(passages).upper() + " " + b) for i, (a, b) in
            enumerate(zip(texts(rng, common, 150, 40), texts(rng, common, 150, 40)))]
    docs += [(1000 + i, t) for i, t in enumerate(texts(rng, ["w1", "w2", "w3"], 30, 60))]
    long = " ".join(f"v{i % 977}" for i in range(30_000))
    docs += [(2000, None), (2001, ""), (2002, " .,"), (None, passages[1]), (None, passages[1]), (2003, passages[2]), (2003, passages[2]),
             (2004, long), (2005, long + " " + passages[0] + " " + long), (2006, "ß" * 70_000)]
    assert run(spark, tmp_path, docs, items) == brute(docs, items)


def test_empty_tables(spark, tmp_path):
    assert not run(spark, tmp_path / "a", [], [(1, "a b c")])
    assert run(spark, tmp_path / "b", [(1, "a b c")], []) == brute([(1, "a b c")], [])


def test_words_in_pieces_have_the_same_hashes(monkeypatch):
    import pyarrow as pa

    column = pa.array(["some words of a text " * 20, None, "x" * 300 + " y", "a b"]).slice(0, 4)
    whole = dc.Words(column).hashes()
    monkeypatch.setattr(dc, "SLICE_BYTES", 50)
    assert (dc.Words(column).hashes() == whole).all()
    assert list(dc._slices(column))[0] == (0, 1)


def test_windows_select_the_same_gram_wherever_they_stand():
    import numpy as np
    import pyarrow as pa

    passage = " ".join(f"p{i}" for i in range(14))
    picks = []
    for text in (passage, "a b c " + passage + " d e"):
        w = dc.Words(pa.array([text]))
        start, fingerprint, place = dc._windows(w, w.hashes(), 10, 5)
        at = 0 if text == passage else 3
        picks.append([(int(fingerprint[s]), int(place[s])) for s in range(at, at + 5)])
    assert picks[0] == picks[1] and len({p for p, _ in picks[0]}) < 5
    assert np.all(np.diff(start) == 1)


def test_spans_and_names_of_items(spark):
    docs = spark.createDataFrame([("d", "u v a b c d e f g h i j k w x a b c d e f g h i j")], "id string, text string")
    items = spark.createDataFrame([("q2", "a b c d e f g h i j k"), ("q10", "b c d e f g h i j k l")], "id string, text string")
    row = dc.shared_spans(docs, items).first()
    assert [tuple(s) for s in row.spans] == [(2, 13), (15, 25)] and row["items"] == ["q10", "q2"]
