"""Quality rules, pseudonyms, the line classifier, url rules, tokens and mixtures."""

import collections
import datetime
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorframe.llm import bpe, line_crf, mixing, pseudonyms, quality_rules, url_filter
from tremorframe.llm.queries import ORACLES, QUERIES
from test_dedup import edge_rows, table

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- rules ---


def stats_brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i:i + 3])].append(i)
    covered = {i + d for at in grams.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_brute_force(spark):
    rng = random.Random(6)
    rows = edge_rows() + [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "é#", "|", "\t", "d "]) for _ in range(rng.randint(0, 80)))) for i in range(80)]
    got = quality_rules.text_statistics(table(spark, rows)).collect()
    found = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == collections.Counter((i, *stats_brute(t)) for i, t in rows)


def test_rules_learn_planted_thresholds_natively(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.25
        words = [f"w{rng.randrange(10**6)}" + ("$$$" if bad and i % 2 and rng.random() < 0.6 else "") for _ in range(80)]
        text = " ".join(words).upper() if bad and i % 2 == 0 else " ".join(words)
        rows.append((i, text))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    frame = spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(table(spark, rows), frame)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    bad = {i for i, t in rows if "$" in t or t.isupper()}
    assert {r.doc_id for r in got.collect() if not r.kept} == bad


def test_rules_on_edge_rows(spark):
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    got = quality_rules.quality_rules(table(spark, edge_rows()), labels).collect()
    assert len(got) == len(edge_rows()) and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(table(spark, edge_rows()), nothing).collect())
    assert quality_rules.quality_rules(table(spark, edge_rows()).limit(0), labels).count() == 0


# --- pseudonyms ---

KEY = b"test"


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000])
def test_permutation_of_a_small_domain(size):
    image = [pseudonyms.permute_below(i, size, KEY, "t") for i in range(size)]
    assert sorted(image) == list(range(size))
    assert [pseudonyms.permute_below(v, size, KEY, "t", back=True) for v in image] == list(range(size))


def test_permutation_of_mixed_symbols():
    radices = [2, 3, 4]
    words = list(itertools.product(*map(range, radices)))
    image = [tuple(pseudonyms.permute_symbols(list(w), radices, KEY, "t")) for w in words]
    assert sorted(image) == sorted(words) and image != words


TEXT = ("on 3.1.2020 or 2020-01-03, 12/31/1999; 4785380592391139 4785-3805-9239-1139 +1 (743) 555-3824, 743-555-3824 at 152.143.123.131, "
        "hein.19@mail5.example.com### 123-45-6789 DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 +49 30 1234567")


def test_values_keep_their_format_and_link():
    there, back = pseudonyms.Pseudonymiser(KEY), pseudonyms.Pseudonymiser(KEY, back=True)
    new, counts = there(TEXT)
    assert counts == [1, 2, 1, 3, 1, 2, 3] and back(new)[0] == TEXT
    assert re.sub("[0-9]", "9", re.sub(r"\d+\.\d+\.\d+\.\d+", "ip", new)).split()[:5] == ["on", "9.9.9999", "or", "9999-99-99,", "99/99/9999;"]
    for old, kind in (("4785380592391139", "card"), ("123-45-6789", "ssn"), ("hein.19@", "mail"), ("152.143.123.131", "ip"), ("555-3824", "phone")):
        assert old not in new, kind
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", new)
    assert len({c.replace("-", "") for c in cards}) == 1 and pseudonyms.luhn_sum(cards[0]) % 10 == 0
    phones = re.findall(r"(?:\+1 \()?(\d{3})\)?[ \-](\d{3}-\d{4})", new)
    assert phones[0] == phones[1]
    assert there("1234567890123456 30.2.2020 999.1.1.1 000-12-3456 v1.2.3.4.5")[1] == [0] * 7
    odd = there("+1 (017) 555-7713")[0]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", odd) and odd != "+1 (017) 555-7713" and back(odd)[0] == "+1 (017) 555-7713"
    twins = there("4785380592391139 4785380592391139")[0].split()
    assert twins[0] == twins[1] != "4785380592391139"
    assert pseudonyms.Pseudonymiser(b"other")(TEXT)[0] != new


def test_dates_stay_days_of_the_calendar():
    seen = set()
    for i in range(400):
        d = datetime.date(1990, 1, 1) + datetime.timedelta(days=i)
        new = pseudonyms.date(d.isoformat(), KEY)
        seen.add(datetime.date.fromisoformat(new))
        assert pseudonyms.date(f"{d.day:02d}.{d.month:02d}.{d.year}", KEY) == datetime.date.fromisoformat(new).strftime("%d.%m.%Y")
        assert pseudonyms.date(new, KEY, back=True) == d.isoformat()
    assert len(seen) == 400


def test_pseudonyms_of_edge_rows(spark):
    rows = [*edge_rows(), (20, TEXT), (21, "see " + TEXT)]
    got = pseudonyms.pseudonymise(table(spark, rows), KEY)
    by = collections.Counter((r.doc_id, r.text) for r in got.collect())
    work = pseudonyms.Pseudonymiser(KEY)
    assert by == collections.Counter((i, None if t is None else work(t)[0]) for i, t in rows)
    assert pseudonyms.pseudonymise(table(spark, rows).limit(0), KEY).count() == 0
    restored = pseudonyms.pseudonymise(got, KEY, back=True).filter("doc_id = 20").first()
    assert restored.text == TEXT


# --- line classifier ---


def test_forward_backward_equals_enumeration():
    rng = np.random.RandomState(1)
    sizes = np.array([3, 1, 5])
    emit, move = rng.randn(9, 2), rng.randn(2, 2)
    post, moves = line_crf._marginals(emit, move, sizes)
    want_moves, at = np.zeros((2, 2)), 0
    for n in sizes:
        total, marg, mv = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(emit[at + i, s] for i, s in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += w
            for i, s in enumerate(y):
                marg[i, s] += w
            for a, b in zip(y, y[1:]):
                mv[a, b] += w
        assert np.allclose(post[at:at + n], marg / total)
        want_moves += mv / total
        at += n
    assert np.allclose(moves, want_moves)


def test_scores_weigh_lines_by_length():
    assert np.allclose(line_crf._text_scores(np.array([1.0, 0.0, 0.5]), np.array([30, 10, 0]), np.array([2, 1])), [0.75, 0.5])


@needs_tables
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    shuffled = docs.withColumn("lang", F.lit("zz")).withColumn("quality", F.lit(0))  # never read
    got = line_crf.score(shuffled, line_crf.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.93
    good, bad = [[r.score for r in got if r.quality == q] for q in (1, 0)]
    assert np.mean([a > b for a in good for b in bad]) >= 0.97


def test_classifier_on_edge_rows(spark):
    docs = table(spark, edge_rows())
    labels = spark.createDataFrame([(4, 1), (7, 0), (7, 0), (None, 1), (9, None), (5, 1), (8, 0)], "doc_id long, quality int")
    model = line_crf.train(docs, labels)
    got = line_crf.score(docs, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    same = {r.doc_id: r.score for r in got if r.doc_id in (1, 2, 10)}
    assert len(set(same.values())) == 1
    assert line_crf.score(docs.limit(0), model).count() == 0
    assert line_crf.keep_good(docs, model).columns == docs.columns
    base = line_crf.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in line_crf.score(docs, base).collect()} == {0.5}


# --- urls ---


def test_hosts_and_paths(spark):
    urls = ["HTTP://WwW.Example.NET:80/en/a?x#y", "https://a.b", "https://a.b?q/en/", "no scheme/x", None, "x://a#/p", "a://b://c/d", "://h/p"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == [("www.example.net:80", "/en/a"), ("a.b", ""), ("a.b", ""), ("", ""), ("", ""), ("a", ""), ("b:", "//c/d"), ("h", "/p")]


def page(target, kind="canonical"):
    if kind == "canonical":
        return f"<html><head><link href='{target}' rel=\"canonical\"></head>"
    return f'<meta http-equiv="refresh" content="0; url={target}">'


def test_decisions_reach_aliases(spark):
    pages = spark.createDataFrame([
        (1, "http://a.org/1", page("http://b.org/x")), (2, "http://b.org/x#top", page("//spam.net/z", "refresh")), (3, "http://c.org/", None),
        (4, "http://d.org/q/1", page("2")), (5, "http://d.org/q/2", page("http://bad.net/")), (6, "http://d.org/fr/9", page("/q/2")),
        (7, "http://e.org/", ""), (8, "http://good.example.net/en/a", ""), (9, None, page("http://spam.net/z")), (10, "nothing", None),
        (11, "http://e.com/", ""), (11, "http://e.com/", ""),
    ], "page_id long, url string, html string").withColumn("rule", F.lit("x")).withColumn("component", F.lit(1))
    redirects = spark.createDataFrame([("http://e.com/", "http://f.com/"), ("http://f.com/", "http://t.net/"), (None, "x")], "from_url string, to_url string")
    got = collections.defaultdict(list)
    for r in url_filter.judge_pages(pages, redirects=redirects).collect():
        got[r.page_id].append((r.rule, r.verdict))
    assert got == {
        1: [(None, "block")], 2: [(None, "block")], 3: [(None, "allow")],
        4: [(None, "allow")], 5: [(None, "allow")], 6: [("org/fr/", "allow")],  # an explicit allow in the group beats its block
        7: [(None, "allow")], 8: [("example.net/en/", "allow")], 9: [(None, "allow")], 10: [(None, "allow")],
        11: [(None, "block")] * 2}
    assert url_filter.judge_pages(pages.limit(0)).count() == 0


@needs_tables
def test_rules_of_the_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    want = {}
    for r in rows:
        m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        hits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(hits, default=(0, None, None))
        want[r.page_id] = (host, path, best[1], best[2] or "allow")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op7_url_filter"](spark, SF).collect()} == want


# --- tokens ---


@pytest.fixture(scope="module")
def reference_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    rank_file, pattern = bpe.public_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Vocabulary(rank_file).ranks, special_tokens={})


def test_ids_equal_those_of_the_tokenizer(reference_tokenizer, monkeypatch):
    rng = random.Random(1)
    letters = "aab bc\n\t\x1c\x1f\x85 'stTHE re éßñ 中文字 123٣ ʰ \U0001F600 !?*#​ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3001, "ab" * 1500, "", None, " " * 300, "aaaa aaaaa", "<|endoftext|>"]
    for block, long in ((400_000, 2_000_000), (50, 10)):
        monkeypatch.setattr(bpe, "BLOCK_PIECES", block)
        monkeypatch.setattr(bpe, "LONG_TEXT", long)
        monkeypatch.setattr(bpe, "REMEMBERED", 1000)
        encoder = bpe.Encoder(*bpe.public_vocabulary())
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [reference_tokenizer.encode_ordinary(t or "") for t in texts]


def test_merges_that_enable_lower_ranks():
    """A pair that appears late but ranks first is applied before the rest of the present rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bb", b"aa", b"abab"]
    vocab_file = b"\n".join(__import__("base64").b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    vocab = bpe.Vocabulary(vocab_file)

    def slow(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        if word in vocab.ranks:
            return [vocab.ranks[word]]
        while True:
            best = min(((vocab.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [vocab.ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(2)
    words = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.replay_merges(words, vocab)] == [slow(w) for w in words]


def test_tokens_of_edge_rows(spark):
    rank_file, pattern = bpe.public_vocabulary()
    got = bpe.decode(bpe.encode(table(spark, edge_rows()), rank_file, pattern), rank_file)
    assert collections.Counter((r.doc_id, bytes(r.decoded).decode()) for r in got.collect()) == collections.Counter((i, t or "") for i, t in edge_rows())
    assert all(len(r.ids) == 4 * r.n_tokens for r in got.collect())
    assert bpe.encode(table(spark, edge_rows()).limit(0), rank_file, pattern).count() == 0


# --- mixtures ---


def test_rates_reach_the_targets(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "a" if i % 4 else "b") for i in range(400)] + [(999, None, None)], "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixing.source_rates(docs, {"a": 1.0, "b": 1.0}).collect()}
    assert rates == {"a": round(2000 / 3000, 9), "b": 2.0, None: 0.0}
    power = {r.source: r.rate for r in mixing.source_rates(docs, exponent=1.0).collect()}
    assert power["a"] == power["b"] == 1.0


@pytest.mark.parametrize("rate", [0.4, 5.0, 90.0])
@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_counts_follow_poisson(spark, monkeypatch, rate, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    rates = spark.createDataFrame([("s", rate)], "source string, rate double")
    n = np.array([r._copies for r in mixing.poisson_counts(docs, rates).collect()])
    assert len(n) == 4000 and abs(n.mean() - rate) < 5 * math.sqrt(rate / 4000) and abs(n.var() - rate) < 0.15 * rate + 0.05


def test_mixture_of_edge_rows(spark):
    docs = table(spark, edge_rows())
    a, b = [mixing.mix(docs, {"s": 1.0}, size_factor=3.0) for _ in range(2)]
    rows = collections.Counter(map(tuple, a.collect()))
    assert rows == collections.Counter(map(tuple, b.collect())) and a.columns == [*docs.columns, "_copy", "_order"]
    per = collections.Counter(r.doc_id for r in a.collect())
    assert per[6] % 2 == 0  # repeated rows are drawn alike
    assert mixing.mix(docs.limit(0)).count() == 0
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_rows_are_dealt_out_at_random(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    order = [r.doc_id for r in mixing.mix(docs, {"s": 1.0}).collect()]
    rank = np.argsort(np.argsort(order, kind="stable"))
    assert abs(np.corrcoef(np.arange(len(rank)), rank)[0, 1]) < 0.1


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    from compare import compare, connect

    assert not compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])[0]


def test_bpe_ranges_merge_like_one_rank_after_the_other():
    rng = random.Random(7)
    vocab = bpe.Vocabulary(bpe.public_vocabulary()[0])
    pieces = ["aa", "b", "ab", "Zzz", "0", "é", "日本", " the", "ing", "\n", "-", "=="]
    words = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)] + [b"a" * k for k in range(1, 60)]
    side_by_side, in_order = (bpe._laid_out(*replay(words, vocab)) for replay in (bpe._replay_ranges, bpe._replay_ranks))
    assert side_by_side == in_order
    assert "pairs" not in vars(bpe.Decoder(vocab.ranks)) and all(vocab.pairs[k] == r for k, r in zip(
        list(vocab.pairs)[:50], vocab.merged(np.array(list(vocab.pairs)[:50])), strict=True))
