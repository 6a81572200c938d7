"""Benchmark decontamination by winnowing: least word grams of sliding windows, joined and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import read_table, stash, travels
from tremorframe.llm.rolling import RangeHash, mixed

travels(__name__)

#: A shared span counts from WINDOW words on. Of each window's grams of GRAM words the least hash is its fingerprint.
WINDOW, GRAM = 10, 5
#: Bits of the sieve that a task holds, however many items there are (4 MB).
SIEVE_BITS = 25
SLICE_BYTES = 4 << 20

#: Word bytes in lower case, 0 for the others: ASCII digits and letters, and every byte of a longer character.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_MIX = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))  # an odd factor for each place of a gram

_PLACE = "array<struct<at: int, words: int, fingerprint: long, place: int, digest: binary>>"
_KEYS = ["fingerprint", "place", "digest"]


class Words:
    """Words of consecutive texts: ``first[i]`` is the number of the first word of text i."""

    def __init__(self, texts: pa.Array):
        raw = texts.cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
        held = raw.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data = _FOLD[data]
        inside = self.data > 0
        head, tail = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
        head[1:-1] = ~inside[:-1]
        head[offsets] = True  # words end with their text
        tail[:-2] = ~inside[1:]
        tail[offsets[1:] - 1] = True
        self.starts = np.flatnonzero(inside & head[:-1])
        self.ends = np.flatnonzero(inside & tail[:-1]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """One hash a word, made in pieces so that a very long text needs no more memory than others."""
        found = np.zeros(len(self.starts), np.uint64)
        at = 0
        while at < len(found):
            low = self.starts[at]
            to = max(int(np.searchsorted(self.ends, low + SLICE_BYTES)), at + 1)
            found[at:to] = RangeHash(self.data[low:self.ends[to - 1]]).of(self.starts[at:to] - low, self.ends[at:to] - low)
            at = to
        return found

    def packed(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one zero byte after each, and where each starts and ends."""
        sizes = self.ends - self.starts
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        out = np.zeros(int((sizes + 1).sum()), np.uint8)
        letters = np.flatnonzero(self.data)
        out[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = self.data[letters]
        return out.tobytes(), starts, starts + sizes


def _windows(words: Words, hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, fingerprint, place`` of all windows of ``size`` words inside a text; of equal grams the first is selected."""
    gram = min(gram, size)
    n = len(hashes) - size + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams += hashes[k:k + len(grams)] * _MIX[k]
    grams = mixed(grams)
    least, place = grams[:n].copy(), np.zeros(n, np.int32)
    for k in range(1, size - gram + 1):
        lower = grams[k:k + n] < least
        least[lower] = grams[k:k + n][lower]
        place[lower] = k
    start = np.flatnonzero(words.text[:n] == words.text[size - 1:size - 1 + n])
    return start, least[start].view(np.int64), place[start]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES together; a longer text is a run of its own."""
    total = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(total):
        done = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, done + SLICE_BYTES, "right")), at + 1)
        yield at, to
        at = to


def _places(texts: pa.Array, window: int, gram: int, sizes: list[int] | None, sieve: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """Word counts and the array column of places. Without ``sizes`` the texts are items: a short one is one window."""
    from hashlib import blake2b

    words = Words(texts)
    counts, hashes = np.diff(words.first), words.hashes()
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for size in sorted(set(np.minimum(counts, window)) - {0}) if sizes is None else sizes:
        start, fingerprint, place = _windows(words, hashes, int(size), gram)
        if sizes is None:
            keep = np.minimum(counts, window)[words.text[start]] == size
        else:
            bit = fingerprint & ((1 << SIEVE_BITS) - 1)
            keep = (sieve[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
        for column, values in zip(parts, (start, np.full(len(start), size), fingerprint, place), strict=True):
            column.append(values[keep])
    start, size, fingerprint, place = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
    order = np.argsort(start, kind="stable")
    start, size, fingerprint, place = (p[order].astype(np.int64) for p in (start, size, fingerprint, place))
    digests: list[bytes] = []
    if len(start):
        packed, begins, ends = words.packed()
        digests = [blake2b(packed[a:b], digest_size=16).digest()
                   for a, b in zip(begins[start].tolist(), ends[start + size - 1].tolist(), strict=True)]
    inner = pa.StructArray.from_arrays(
        [pa.array((start - words.first[words.text[start]]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(fingerprint),
         pa.array(place.astype(np.int32)), pa.array(digests, pa.binary())], ["at", "words", "fingerprint", "place", "digest"])
    cuts = np.searchsorted(start, words.first).astype(np.int32)
    return counts, pa.ListArray.from_arrays(pa.array(cuts), inner)


def fingerprinted(rows: DataFrame, window: int, gram: int, sizes: list[int] | None = None, sieve=None) -> DataFrame:
    """``id, n_words, places`` of ``id, text`` rows. For items (no ``sizes``) all windows; for documents the windows of these
    sizes whose fingerprint passes the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sieve is None else sieve.value
        for batch in batches:
            for at, to in _slices(batch.column(1)):
                part = batch.slice(at, to - at)
                counts, places = _places(part.column(1), window, gram, sizes, bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), places], ["id", "n_words", "places"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, places {_PLACE}")


def _sieve(windows: DataFrame) -> np.ndarray:
    """Bitmap of the fingerprints: its size is fixed, so the driver and the tasks hold no more of it for more items."""
    bit = F.col("fingerprint").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1)) + 1
    chunks = windows.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros((1 << SIEVE_BITS) // 8, np.uint8)
    for r in chunks:  # chunk 1 holds the bits of the first values
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["chunk"] - 1) * len(bits):r["chunk"] * len(bits)] = bits
    return out


def _merged(rows: DataFrame) -> DataFrame:
    """``row, spans, classes``: overlapping and touching windows become one span of words (end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for found in batch.column(1).to_pylist():
                out: list[list[int]] = []
                for low, high in sorted((x["at"], x["at"] + x["words"]) for x in found):
                    if out and low <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], high)
                    else:
                        out.append([low, high])
                spans.append([{"start": a, "end": b} for a, b in out])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), batch.column(2)], ["row", "spans", "classes"])

    return rows.mapInArrow(run, "row long, spans array<struct<start: int, end: int>>, classes array<string>")


def shared_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id, n_words, spans, items`` per row of ``docs``; both tables are ``id, text`` rows.

    Words are runs of digits, ASCII letters in lower case and characters beyond ASCII. ``spans`` are the word ranges
    covered by ``window`` consecutive words of an item (all words of a shorter one), ``items`` the sorted ids (as strings)
    of the items with such a window in the text.

    The least gram of every window is its fingerprint, so two copies of a window have the same one at the same place: every
    shared span is found. Documents keep the windows whose fingerprint passes a sieve of fixed size; these are joined with
    the items by fingerprint and extended on both sides to the whole window, compared by a digest of its words. A join of
    documents with all items that hold a fingerprint would make pairs of them; here an item window is one row,
    however many items share it, and stands for its set of items. The lists of items are made once for each combination of
    sets, not for each document. The side of the items is broadcast only while Spark finds its file small; else the join is
    a sort-merge join whose hot keys adaptive execution splits.

    Null and empty texts have no words and no spans; an item without words has no window. A null item id counts as one item
    with an empty name. Very long texts are read in pieces; repeated rows are judged alike, each in its own row; of equal grams
    in a window the first is its fingerprint. Empty tables give an empty result, or no spans. Other columns are ignored.
    """
    named = items.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    held = stash(fingerprinted(named, window, gram).select("id", F.explode("places").alias("p")).select("id", "p.*").drop("at").distinct(),
                 "item-windows")
    sizes = sorted(r["words"] for r in held.select("words").distinct().collect())  # no more than ``window`` values
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(held))
    texts = docs.select("id", F.col("text").cast("string").alias("text"))
    found = fingerprinted(texts, window, gram, sizes, sieve)
    rows = stash(found.withColumn("row", F.monotonically_increasing_id()), "document-windows")

    # A window's set of items, named by its size and two hashes that do not depend on an order.
    sets = held.groupBy(*_KEYS, "words").agg(F.concat_ws(
        "-", F.count("*"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.lit("item"), "id"))).alias("class"))
    sets = stash(sets, "item-sets")
    hits = rows.filter(F.size("places") > 0).select("row", F.explode("places").alias("p")).select("row", "p.at", *[f"p.{k}" for k in _KEYS]) \
        .join(sets, _KEYS).groupBy("row").agg(
            F.collect_list(F.struct("at", "words")).alias("found"), F.sort_array(F.collect_set("class")).alias("classes"))
    merged = stash(_merged(hits).withColumn("combination", F.sha2(F.array_join("classes", ","), 256)), "document-spans")
    first = sets.groupBy("class").agg(F.min("digest").alias("digest"))
    members = first.join(held.select("digest", "id"), "digest").select("class", "id").distinct()
    lists = merged.select("combination", F.explode("classes").alias("class")).distinct().join(members, "class") \
        .groupBy("combination").agg(F.sort_array(F.collect_set("id")).alias("items"))
    out = merged.join(lists, "combination").select("row", "spans", "items")
    none = F.array().cast("array<struct<start: int, end: int>>"), F.array().cast("array<string>")
    return rows.select("row", "id", "n_words").join(out, "row", "left").select(
        "id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark: words hit, and a digest of the items that occur."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return shared_spans(docs, items).select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_FOLDED = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP11_SQL = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, {_FOLDED} AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_FOLDED} AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), hits AS (
  SELECT r, i, p.n, item_id FROM places p JOIN item_windows v ON p.n = v.n AND p.win = v.win
), hit_words AS (
  SELECT r, count(DISTINCT i + d) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS d FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
