"""Near-duplicate groups by MinHash bands and odd sketches.

A text's set are its five-word shingles. Sets are reduced to classes of equal sets; each class has a MinHash sample
whose bands give candidates, and odd sketches: the sample, and the set itself, folded into bitmaps by parity. The bits in
which two sample sketches differ estimate the similarity, most precisely where it is high; the bits in which two set
sketches differ are never more than the elements that differ, so too many of them rule a link out. What passes both is
confirmed on the full sets.

Buckets are not turned into pairs. Every member is compared with the bucket's smallest member; the confirmed
links are contracted to components; only members of buckets that still hold several components are compared
further, across components, block by block on their sketches. Of the pairs that pass, one round first confirms a
spanning forest, most similar pairs first, and contracts again; the last round confirms every pair that is still open. A
group of copies of any size thus costs about one confirmation per member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import read_table, stash, travels
from tremorframe.llm.components import connected_components
from tremorframe.llm.rolling import mixed, word_hashes
from tremorframe.session import durable

travels(__name__)

WORDS = 5
#: 250 samples: a pair at similarity 0.75 misses all 50 bands of 5 with a chance of 1.4e-6.
BANDS, ROWS_PER_BAND = 50, 5
SAMPLES = BANDS * ROWS_PER_BAND
SKETCH_BITS = 512
#: Percent of similarity that links.
LINK_PERCENT = 75
#: A pair at the threshold is estimated with a standard deviation of about 0.032; the sketch rejects below five of them.
SKETCH_FLOOR = 0.59
SET_BITS = 1024
#: Rounds across components: a spanning forest of the pairs that pass, or all of them. The last must be all.
ROUNDS = ("forest", "all")
#: Members of a block; rows of buckets that a task holds at a time.
BLOCK, TASK_ROWS = 256, 20_000
#: Bytes of texts that a task turns into sets together.
CHUNK = 1 << 20

_RANDOM = np.random.RandomState(8)
_XOR = _RANDOM.randint(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_TIMES = (_RANDOM.randint(0, 1 << 31, SAMPLES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_FOLD = _RANDOM.randint(0, 1 << 62, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; with fewer words the whole sequence is one shingle."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # of bytes, lower() changes A-Z only
    if not len(words):
        return words
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    h = np.full(n, _FOLD[WORDS] * np.uint64(width), np.uint64)
    for j in range(width):
        h += words[j:j + n] * _FOLD[j]
    return np.unique(mixed(h))


def min_samples(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash sample of every set, which must not be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, work = np.empty((len(sets), SAMPLES), np.uint32), np.empty_like(flat)
    for k in range(SAMPLES):
        np.bitwise_xor(flat, _XOR[k], out=work)
        np.multiply(work, _TIMES[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(samples), BANDS)).copy()
    grouped = samples.reshape(len(samples), BANDS, ROWS_PER_BAND).astype(np.uint64)
    for j in range(ROWS_PER_BAND):
        h = mixed(h + grouped[:, :, j])
    return h.view(np.int64)


def _parity(place: np.ndarray, owner: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bitmap per owner: bit b is the parity of its elements that fall on b."""
    odd = (np.bincount(owner * bits + place.astype(np.int64), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The MinHash samples folded into SKETCH_BITS bits."""
    place = mixed(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) >> np.uint64(55)
    return _parity(place.ravel(), np.repeat(np.arange(len(samples)), SAMPLES), len(samples), SKETCH_BITS)


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sets folded into SET_BITS bits."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return _parity(np.concatenate(sets) % np.uint64(SET_BITS), owner, len(sets), SET_BITS)


def most_differing(similarity: float) -> int:
    """Differing bits of two sketches whose estimate is ``similarity``."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(4 * SAMPLES / SKETCH_BITS * (similarity - 1))))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_id, sketch, bands``; the last three are null for an empty set.

    ``sketch`` is the sample's bitmap followed by the set's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                sets = [shingle_set(t) for t in texts[a:b]]
                full = [i for i, s in enumerate(sets) if len(s)]
                ids: list = [None] * len(sets)
                sketches: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if full:
                    samples = min_samples([sets[i] for i in full])
                    both = np.concatenate([odd_sketches(samples), set_sketches([sets[i] for i in full])], axis=1)
                    for i, sketch, keys in zip(full, both, band_keys(samples), strict=True):
                        ids[i], sketches[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), sketch.tobytes(), keys
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_id", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_id binary, sketch binary, bands array<long>")


def _words(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), (SKETCH_BITS + SET_BITS) // 64)


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the pair passes, how close it is to failing) for words and sizes that broadcast against each other.

    A link allows at most (|A| + |B|) (100 - L) / (100 + L) differing elements, of which the set sketch shows no more;
    and the smaller set must be large enough.
    """
    differ = np.bitwise_count(a ^ b)
    cut = SKETCH_BITS // 64
    sample, whole = differ[..., :cut].sum(axis=-1, dtype=np.int64), differ[..., cut:].sum(axis=-1, dtype=np.int64)
    most = (size_a + size_b) * (100 - LINK_PERCENT) // (100 + LINK_PERCENT)
    ok = (sample <= most_differing(SKETCH_FLOOR)) & (whole <= most) & (100 * np.minimum(size_a, size_b) >= LINK_PERCENT * np.maximum(size_a, size_b))
    return ok, np.maximum(sample / most_differing(SKETCH_FLOOR), whole / np.maximum(most, 1))


def _passing(pairs: DataFrame) -> DataFrame:
    """``a, b`` of the rows ``a, b, size_a, size_b, sketch_a, sketch_b`` that pass the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [_words(batch.column(i).to_pylist()) for i in (4, 5)]
            ok, _ = may_link(*sides, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield batch.select([0, 1]).filter(pa.array(ok))

    return pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets link. ``b`` meets its text first: a hub among the ``a`` is a skewed join that can be split."""
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None  # the rows of a hub come one after the other
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, ta) != last:
                    last, last_set = (a, ta), shingle_set(ta)
                other = shingle_set(tb)
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                keep.append(100 * common >= LINK_PERCENT * (len(last_set) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _forest(order: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Of pairs of components, in the given order, those that join what is not yet joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for k in order.tolist():
        x, y = find(int(left[k])), find(int(right[k]))
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def _across(rows: DataFrame, parts: int, how: str) -> DataFrame:
    """Pairs of one bucket in different components that pass the sketches: all, or a forest of each two blocks.

    ``rows``: ``key, cls, component, n_shingles, sketch, block, blocks``. A bucket of more than BLOCK members is dealt out as
    pairs of blocks, so a task compares BLOCK members with BLOCK others, however large the bucket is.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "component", "n_shingles", "sketch") \
        .withColumn("part", F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "i", "j", "cls"], kind="stable")
        ids = rows[["key", "i", "j"]].to_numpy()
        cls, component, sizes = [rows[c].to_numpy() for c in ("cls", "component", "n_shingles")]
        own = rows["block"].to_numpy() == rows["i"].to_numpy()
        words = _words(rows["sketch"].tolist())
        cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(rows)]]).tolist()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if component[a:b].min() == component[a:b].max():
                continue
            here = np.arange(a, b)
            if ids[a, 1] == ids[a, 2]:
                ok, far = may_link(words[here][:, None], words[here][None], sizes[here][:, None], sizes[here][None])
                ok &= here[:, None] < here[None]
                left, right = here, here
            else:
                left, right = here[own[here]], here[~own[here]]
                ok, far = may_link(words[left][:, None], words[right][None], sizes[left][:, None], sizes[right][None])
            ok &= component[left][:, None] != component[right][None]
            x, y = np.nonzero(ok)
            if how == "forest" and len(x):
                kept = _forest(np.argsort(far[x, y], kind="stable"), component[left[x]], component[right[y]])
                x, y = x[kept], y[kept]
            found.append((cls[left[x]], cls[right[y]]))
        both = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]
        return pd.DataFrame({"a": np.minimum(*both), "b": np.maximum(*both)})

    return dealt.groupBy("part").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, links``.

    Texts link when their sets of five-word shingles (A-Z lower-cased, words split at white space) have a
    similarity of 0.75 or more. ``component_id`` is the smallest id that links reach, ``kept`` whether it is the row's
    own, ``links`` whether the row is linked with another at all. Null and empty texts have no set and link with
    nothing; so do rows with a null id, whose component is null and which are kept. Rows of one id are one document: their
    links join. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = stash(signatures(docs), "near-signatures")
    named = rows.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("cls"))
    member = rows.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    reps = stash(named.join(classes, "set_id").filter("doc_id = cls").select("cls", "n_shingles", "sketch", "bands"), "near-classes")
    narrow = reps.select("cls", "n_shingles", "sketch")
    bands = reps.select("cls", F.explode("bands").alias("key")).distinct()
    shared = durable(bands.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("last")).filter("a < last").select("key", "a"))
    buckets = stash(bands.join(shared, "key"), "near-buckets")  # key, cls, a: buckets with two classes or more
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = stash(texts.join(buckets.select(F.col("cls").alias("doc_id")).distinct(), "doc_id", "left_semi"), "near-texts")

    sides = [narrow.select(F.col("cls").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    star = buckets.filter("cls <> a").select("a", F.col("cls").alias("b")).distinct().join(sides[1], "b").join(sides[0], "a")
    links = durable(confirm(durable(_passing(star)), texts))
    groups = durable(connected_components(links))

    for how in ROUNDS:
        labelled = buckets.select("key", "cls").join(groups.withColumnRenamed("node", "cls"), "cls", "left") \
            .select("key", "cls", F.coalesce("component", "cls").alias("component"))
        # fixed-width aggregates that combine on the map side
        open_keys = durable(labelled.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"))
                            .filter("c0 < c1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n"))
        dealt = open_keys.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
        if not dealt:
            break
        open_rows = labelled.join(open_keys.drop("n"), "key").join(narrow, "cls") \
            .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        pairs = durable(_across(open_rows, -(-dealt // TASK_ROWS), how))
        if pairs.isEmpty():
            break
        more = durable(confirm(pairs, texts))
        if not more.isEmpty():
            links = links.union(more)
            groups = durable(connected_components(links))

    linked = groups.withColumnRenamed("node", "cls")
    joined = member.join(linked, "cls", "left").withColumn("component_id", F.coalesce("component", "cls", "doc_id"))
    twins = named.groupBy("set_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("set_id").alias("twin"))
    return joined.join(twins, F.col("set_id") == F.col("twin"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        (F.col("component").isNotNull() | F.col("twin").isNotNull()).alias("links"))


def keep_one(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; rows with a null id stay."""
    gone = decided.filter("NOT kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone_id"), "left_anti")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), edges AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept, d.doc_id IN (SELECT a FROM edges) AS links
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
