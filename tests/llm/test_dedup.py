"""Exact dedup, repeated substrings, repeated line runs and near duplicates against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tremorframe.llm import exact_dedup, line_runs, near_dedup, suffix_dedup
from tremorframe.llm.components import connected_components
from tremorframe.llm.rolling import RangeHash, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, block int, component string"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, None, "s", None, "k", "d", 1, "c") for i, t in rows], SCHEMA)


def edge_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f"), (5, "a  b\nc d e f"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"),
            (7, long), (8, long), (9, "ß" * 700), (10, None), (None, None), (11, "x")]


# --- exact ---


def exact_brute(rows):
    norm = [BLANK.sub("", t or "") for _, t in rows]
    best = {}
    for (i, t), n in zip(rows, norm):
        rank = (-len(t or ""), i is None, i or 0)
        if n not in best or rank < best[n][0]:
            best[n] = (rank, i)
    size = collections.Counter(norm)
    return collections.Counter((i, best[n][1], size[n], i == best[n][1], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm))


def test_exact_equals_brute_force(spark):
    rng = random.Random(2)
    rows = edge_rows() + [(100 + i, rng.choice(["a b", "ab", "a\nb ", "c", "c ", "  c", "dé"]) * rng.randint(1, 2)) for i in range(200)]
    got = exact_dedup.exact_dedup(table(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == exact_brute(rows)


def test_exact_keeps_one_row_with_its_columns(spark):
    docs = table(spark, edge_rows())
    kept = exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))
    assert kept.columns == docs.columns
    texts = [BLANK.sub("", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({BLANK.sub("", t or "") for _, t in edge_rows()})


def test_index_remembers_batches(spark, tmp_path):
    index = exact_dedup.open_index(spark, path=f"file://{tmp_path}/index", buckets=4)
    first = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(table(spark, [(5, "a b"), (6, "ab"), (7, "c")]), index).collect()}
    assert first == {5: 5, 6: 5, 7: 7}
    second = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(table(spark, [(1, "a  b"), (2, "d")]), index).collect()}
    assert second == {1: (5, False), 2: (2, True)}  # what the index holds stays, however long the new text is
    again = exact_dedup.open_index(spark, path=f"file://{tmp_path}/index", buckets=4)
    assert spark.table(again).count() == 3
    plan = table(spark, [(1, "a")]).select(exact_dedup.text_digest().alias("digest")).join(
        spark.table(again).hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # the bucketed side is not shuffled


# --- substrings ---


def repeats_brute(texts, weights, m):
    seen = collections.Counter()
    for t, w in zip(texts, weights):
        for i in range(len(t) - m + 1):
            seen[t[i:i + m]] += w
    return [[i for i in range(len(t) - m + 1) if seen[t[i:i + m]] > 1] for t in texts]


def test_interval_expansion_equals_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        m, letters = rng.choice([3, 5, 9, 20]), rng.choice([b"ab", b"abc", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(60))
        texts = set()
        for _ in range(rng.randint(1, 8)):
            t = bytes(rng.choice(letters) for _ in range(rng.randint(m, 50)))
            if rng.random() < 0.5:
                a = rng.randint(0, 40)
                t = t[:10] + base[a:a + rng.randint(m, 40)] + t[10:]
            texts.add(t)
        texts = sorted(texts)
        weights = [rng.choice([1, 1, 2]) for _ in texts]
        assert [list(x) for x in suffix_dedup.repeated_in_block(texts, weights, m)] == repeats_brute(texts, weights, m)


def removal_brute(rows, m):
    seen = collections.Counter()
    raws = [(t or "").encode() for _, t in rows]
    for r in raws:
        for i in range(len(r) - m + 1):
            seen[r[i:i + m]] += 1
    out = collections.Counter()
    for (doc, _), r in zip(rows, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - m + 1):
            if seen[r[i:i + m]] > 1:
                gone[i:i + m] = True
        spans = int(np.sum(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        out[doc, len(r), int(gone.sum()), spans, bytes(np.frombuffer(r, np.uint8)[~gone])] += 1
    return out


@pytest.mark.parametrize("crowded", [2, 3_000])
def test_removal_equals_brute_force(spark, monkeypatch, crowded):
    """With crowded keys the stretches are dealt out down to single strings; the result is the same."""
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4_000)
    rng = random.Random(crowded)
    passage = "".join(rng.choice("abcdefé ") for _ in range(90))
    rows = [(1, None), (2, ""), (3, passage), (3, passage), (None, passage), (4, "ab" * 200), (5, "x" * 39), (6, "x" * 40), (7, "x" * 41)]
    for i in range(40):
        a, b = rng.randint(0, 30), rng.randint(50, 90)
        rows.append((10 + i, "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) + passage[a:b] + "".join(rng.choice("abc") for _ in range(30))))
    got = suffix_dedup.remove_repeats(table(spark, rows), min_bytes=40, gram=12, grains=(10, 3, 1))
    found = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert found == removal_brute(rows, 40)


def test_removal_of_edge_rows(spark):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(table(spark, edge_rows())).collect()}
    assert got[1, 0].n_removed == got[2, 0].n_spans == 0
    n = len(edge_rows()[8][1])
    assert got[7, n].n_removed == n and got[8, n].n_spans == 1 and bytes(got[7, n].kept) == b""
    assert got[9, 1400].n_removed == 1400  # it repeats itself
    assert suffix_dedup.remove_repeats(table(spark, edge_rows()).limit(0)).count() == 0


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    raw = bytes(random.Random(1).choice(b"ab") for _ in range(3_000))
    whole = {key for key, *_ in suffix_dedup.stretches(raw, 50, 10)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    pieces = list(suffix_dedup.stretches(raw, 50, 10))
    assert {key for key, *_ in pieces} == whole
    assert sorted(s for _, lo, n, _ in pieces for s in range(lo, lo + n)) == list(range(3_000 - 49))


# --- runs of lines ---


def runs_brute(rows, run_lines):
    strip = "".join(chr(c) for c in (0x20, *range(9, 14)))
    docs = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        docs[doc] = (lines, [i for i, x in enumerate(lines) if x.strip(strip)])
    seen, gone = {}, collections.defaultdict(set)
    for doc in sorted(docs):
        lines, full = docs[doc]
        for k in range(len(full) - run_lines + 1):
            w = tuple(lines[full[j]].strip(strip) for j in range(k, k + run_lines))
            if w in seen:
                gone[doc] |= set(range(k, k + run_lines))
            else:
                seen[w] = 1
    out = {}
    for doc, (lines, full) in docs.items():
        dead = {full[k] for k in gone[doc]}
        out[doc] = (len(full), len(dead), "\n".join(x for i, x in enumerate(lines) if i not in dead))
    return out


def test_runs_of_lines_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(1, ""), (2, "a\nb\nc"), (3, "a\nb\nc\na\nb\nc\nd"), (4, "a \n\n b\nc\n"), (5, "x\nx\nx\nx\nx")]
    for i in range(60):
        rows.append((10 + i, "\n".join(rng.choice(["a", "b", "c", "d", "", " e"]) for _ in range(rng.randint(1, 15)))))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_runs.remove_repeated_runs(table(spark, rows)).collect()}
    assert got == runs_brute(rows, 3)


@pytest.mark.parametrize(("run_lines", "gram_lines"), [(5, 2), (4, 1), (3, 3)])
def test_matches_break_off_at_differing_neighbours(spark, run_lines, gram_lines):
    """One gram stands in many places whose neighbours agree with the first holder, with each other, or with nothing."""
    rng = random.Random(run_lines)
    middle = ["m", "n"]
    sides = [["a", "b", "c"], ["a", "b", "x"], ["y", "b", "c"], ["p", "q", "r"]]
    rows = [(i, "\n".join([*rng.choice(sides), *middle, *rng.choice(sides), rng.choice("uvw")])) for i in range(70)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text)
           for r in line_runs.remove_repeated_runs(table(spark, rows), run_lines, gram_lines).collect()}
    assert got == runs_brute(rows, run_lines)


def test_an_equal_fingerprint_of_another_gram_is_no_match(spark):
    """With every hash of a gram the same, all places meet one holder; the comparison of lines decides."""
    found = [(i, i, 7, 0, 0, 3, b"".join(hashlib.md5(x).digest() for x in lines)) for i, lines in enumerate(
        [[b"a", b"b", b"c"], [b"d", b"e", b"f"], [b"a", b"b", b"g"], [b"d", b"e", b"f"], [b"a", b"b", b"c"]])]
    table_of = spark.createDataFrame(found, "doc_id long, text_hash long, fingerprint long, position int, first int, lines int, hashes binary")
    got = {(r.doc_id, r.lo, r.hi) for r in line_runs.later_runs(table_of).collect()}
    assert got == {(3, 0, 0), (4, 0, 0)}


def test_runs_of_lines_edge_rows(spark):
    rows = [(1, None), (None, "a\nb\nc"), (2, "a\nb\nc"), (2, "a\nb\nc"), (3, "a\nb\nc"), (None, "a\nb\nc\nd")]
    got = collections.Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_runs.remove_repeated_runs(table(spark, rows)).collect())
    assert got == collections.Counter({(1, 0, 0, None): 1, (None, 3, 3, ""): 1, (2, 3, 0, "a\nb\nc"): 2, (3, 3, 3, ""): 1, (None, 4, 3, "d"): 1})
    assert line_runs.remove_repeated_runs(table(spark, rows).limit(0)).count() == 0


def test_winnowing_selects_in_both_copies():
    rng = random.Random(9)
    lines = [hashlib.md5(bytes([rng.randrange(250)])).digest() for _ in range(200)]
    lines[150:160] = lines[20:30]
    found = line_runs.winnow(lines, 5, 2)
    assert sorted(s for _, _, a, b in found for s in range(a, b + 1)) == list(range(196))
    one = {(fp, at - 20) for fp, at, a, b in found if b >= 20 and a <= 25 and 20 <= at < 29}
    two = {(fp, at - 150) for fp, at, a, b in found if b >= 150 and a <= 155 and 150 <= at < 159}
    assert one & two and all(any(s >= a and s <= b for fp, at, a, b in found if (fp, at - 150) in one) for s in range(150, 156))


# --- near duplicates ---


def shingles(text):
    words = [w for w in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def groups_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def copies(seed, n, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w.upper() if rng.random() < 0.1 else w for w in words)


@pytest.mark.parametrize("block", [8, 256])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    """Groups in which many pairs lie close to the threshold, more members than a block holds."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = [t for s in range(4) for t in copies(s, 40, 2 + 2 * s)] + ["a b c", "A  b\nc", "a b", "", None, "a b c d e", "a b c d e f"]
    rng = random.Random(block)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == groups_brute(rows)


def test_near_duplicates_edge_rows(spark):
    rows = near_dedup.near_duplicates(table(spark, edge_rows())).collect()
    assert len(rows) == len(edge_rows())
    got = {(r.doc_id, r.n_shingles): r for r in rows}
    assert got[5, 2].component_id == 4 and not got[6, 2].kept and got[8, 977].component_id == 7
    assert got[1, 0].kept and not got[2, 0].links and got[None, 2].component_id is None and got[None, 2].kept
    docs = table(spark, edge_rows())
    assert near_dedup.keep_one(docs, near_dedup.near_duplicates(docs)).columns == docs.columns
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.RandomState(3)
    for similarity in (0.6, 0.75, 0.9):
        n = 800
        common = int(round(n * 2 * similarity / (1 + similarity)))
        errors = []
        for _ in range(40):
            pool = rng.randint(0, 1 << 62, 2 * n - common, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - common:])
            s = near_dedup.odd_sketches(near_dedup.min_samples([a, b]))
            bits = int(np.unpackbits(s[0] ^ s[1]).sum())
            errors.append(bits <= near_dedup.most_differing(similarity))
        assert 0.25 < np.mean(errors) < 0.8  # the bits scatter around those of the true similarity
    assert near_dedup.most_differing(1.0) == 0 and near_dedup.most_differing(0.59) > near_dedup.most_differing(0.75)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_range_hashes():
    raw = b"abcabcab" * 5
    h = RangeHash(np.frombuffer(raw, np.uint8))
    a, b = np.array([0, 3, 1, 0]), np.array([4, 7, 5, 5])
    v = h.of(a, b)
    assert v[0] == v[1] != v[2] and v[3] != v[0]
    words = word_hashes(b" ab\tcd ab\x0b\x1cab ", piece=3)
    assert len(words) == 4 and words[0] == words[2] != words[3]


def test_repeats_of_a_block_by_tripled_prefixes():
    """Random texts with long copies: starts of strings that occur elsewhere, against a plain count."""
    from collections import Counter

    import numpy as np

    from tremorframe.llm.suffix_dedup import repeated_in_block

    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 100, 300, dtype=np.uint8))
    texts = [base[int(a):int(a) + int(n)] + bytes(rng.integers(97, 99, 20, dtype=np.uint8)) for a, n in zip(rng.integers(0, 150, 40), rng.integers(5, 150, 40))]
    texts = list(dict.fromkeys(texts)) + [b"a" * 200]
    for width in (20, 63, 64, 90):
        starts = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
        want = [[i for i in range(len(t) - width + 1) if starts[t[i:i + width]] > 1] for t in texts]
        assert [f.tolist() for f in repeated_in_block(texts, [1] * len(texts), width)] == want
