"""The pipeline against a brute-force version, and its stages on edge rows."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from test_dedup import BLANK, copies, edge_rows, groups_brute, table
from tremorframe.llm import bpe, line_crf, mixing

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=1):
    rng = random.Random(seed)
    rows = list(edge_rows())
    for i, text in enumerate(t for s in range(3) for t in copies(s, 12, 4)):
        rows.append((100 + i, text))
    for i in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 60))]
        lines = [" ".join(words[k:k + 8]) for k in range(0, len(words), 8)]
        rows.append((200 + i, "\n".join(x.upper() + " $$$" if i % 4 == 0 else x for x in lines)))
    rows += [(500, rows[-1][1] + " "), (501, rows[-2][1])]
    labels = [(200 + i, int(i % 4 != 0), 0) for i in range(100)] + [(None, 1, 0), (150, None, 0), (100, 1, 0)]
    return rows, labels


def uniform(*parts):
    key = ":".join("null" if p is None else str(p) for p in parts)
    return (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def copies_drawn(doc, rate):
    parts = max(1, math.ceil(rate / mixing.PART_RATE))
    mean = rate / parts
    term = total = math.exp(-mean)
    cdf = [term]
    for k in range(1, mixing.TABLE + 1):
        term = term * mean / k
        total += term
        cdf.append(total)
    cdf.append(1.0)
    return sum(sum(c < uniform(mixing.SEED, doc, part) for c in cdf) for part in range(parts))


def brute(spark, rows, labels):
    docs = table(spark, rows)
    model = line_crf.train(docs, spark.createDataFrame(labels, LABELS))
    rows = [r for r, s in zip(rows, line_crf.score_texts([t for _, t in rows], model)) if s >= line_crf.THRESHOLD]
    best = {}
    for doc, text in rows:
        norm, rank = BLANK.sub("", text or ""), (-len(text or ""), doc is None, doc or 0)
        if norm not in best or rank < best[norm][0]:
            best[norm] = (rank, doc, text)
    rows = [(doc, text) for _, doc, text in best.values()]
    groups = groups_brute([(d, t) for d, t in rows if d is not None])
    rows = [(d, t) for d, t in rows if d is None or groups[d][2]]
    chars = sum(len(t or "") for _, t in rows)
    rate = round(chars**0.5 * (chars / chars**0.5) / chars, 9)  # the tables have one source
    encoder = bpe.Encoder(*bpe.public_vocabulary())
    out = collections.Counter()
    for (doc, text), ids in zip(rows, encoder.encode([t for _, t in rows])):
        n = copies_drawn(doc, rate)
        if n:
            out[doc, len(ids) // 4, ids, hashlib.sha256((text or "").encode()).hexdigest()] += n
    return out


def written(spark, tmp_path, rows, labels):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = corpus()
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows, labels))
    assert collections.Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got.collect()) == brute(spark, rows, labels)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, labels = corpus()
    folder = written(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.7, 31.0, 100.0])
def test_drawn_copies(spark, rate):
    docs = spark.createDataFrame([(i, "s") for i in range(200)] + [(None, "s")], "doc_id long, source string")
    got = {r.doc_id: r._copies for r in mixing.poisson_counts(docs, spark.createDataFrame([("s", rate)], "source string, rate double")).collect()}
    assert got == {d: copies_drawn(d, rate) for d in [*range(200), None]}
    assert rate == 0 or abs(np.mean(list(got.values())) - rate) < 6 * math.sqrt(rate / 200)
