"""Removal of repeated substrings with a Burrows-Wheeler transform per block of the corpus.

The corpus is cut into blocks by content, so that all occurrences of one long substring meet in one block: every
start of a 400-byte string is keyed by the least hash of the 64-byte grams inside the string. The key depends on the
string alone, and neighbouring starts mostly share it, so a block is made of stretches of text, each with all the starts
of one key in a row. Keys whose gram occurs once cannot hold a repeat and leave at once; equal stretches are merged and weighted.

A block is transformed, and threshold-bounded interval expansion finds the repeats: from the interval of the empty
string, breadth first, each interval is extended backwards by every symbol; the right border of a new interval of
length l has a common prefix of l - 1 with its neighbour. Prefixes thus come in increasing order, each border
is set once, and expansion stops at the minimum length: what is unset then is a repeat of that length or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import read_table, stash, text_of, travels
from tremorframe.llm.rolling import RangeHash
from tremorframe.session import durable

travels(__name__)

MIN_BYTES, GRAM = 400, 64
#: Bytes of a block's stretches; a key with more stretches than CROWDED is dealt out more finely.
BLOCK_BYTES, CROWDED = 2 << 20, 3_000
#: Starts per stretch at each finer dealing; at 1 a key is one string.
GRAINS = (48, 6, 1)
#: A stretch is cut after so many starts, a long text is read in pieces of so many.
STRETCH, PIECE = 1_024, 4 << 20
ROWS = 1_000


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def stretches(raw: bytes, min_bytes: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """``(key, first start, starts, grams)`` of a text: starts in a row with one key, and how often its gram occurs there.

    With one gram, the starts have different distances from it and so different strings; with more, a stretch may
    repeat itself.
    """
    width = min_bytes - gram + 1
    for at in range(0, max(len(raw) - min_bytes + 1, 0), PIECE):
        data = np.frombuffer(raw[at:at + PIECE + min_bytes - 1], np.uint8)
        grams = RangeHash(data).of_width(gram)
        least = window_min(grams, width)
        cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]]).tolist()
        grams, keys = grams.view(np.int64), least.view(np.int64)[cuts[:-1]].tolist()
        for key, a, b in zip(keys, cuts[:-1], cuts[1:], strict=True):
            times = int(np.count_nonzero(grams[a:b + width - 1] == key))
            for s in range(a, b, STRETCH):
                yield key, at + s, min(STRETCH, b - s), times


def _digest(raw: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(raw, digest_size=16).digest()


def _identified(docs: DataFrame) -> DataFrame:
    """``doc_id, unit, text``; unit stands for the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.substring(F.sha2(text_of(), 256), 1, 32)).alias("unit"),
                       text_of().alias("text"))


def _find_stretches(docs: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """``doc_id, unit, key, lo, starts, grams, stretch`` of all texts; stretch is a digest of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, keys, los, counts, times, digests = [], [], [], [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    for key, lo, n, grams in stretches(raw, min_bytes, gram):
                        rows.append(i)
                        keys.append(key)
                        los.append(lo)
                        counts.append(n)
                        times.append(grams)
                        digests.append(_digest(raw[lo:lo + n + min_bytes - 1]))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(keys, pa.int64()), pa.array(los, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(times, pa.int64()), pa.array(digests, pa.binary())],
                    ["doc_id", "unit", "key", "lo", "starts", "grams", "stretch"])

    return _identified(docs).mapInArrow(run, "doc_id long, unit binary, key long, lo long, starts long, grams long, stretch binary")


# --- one block -------------------------------------------------------------------------------------------------


def _sorted_suffixes(symbols: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` symbols or more, by prefix tripling (doubling where a key has no room for three ranks).

    ``left``: symbols up to the end of the stretch. Suffixes that have reached their end are not sorted further: what
    follows never takes part in a comparison that counts.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, symbols.dtype)]).astype(np.int64)
    first = np.zeros(n, np.int64)
    for j in range(7):  # seven symbols of nine bits
        first = (first << 9) | padded[j:n + j]
    order = np.argsort(first)
    first = first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    del first
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots, h = np.arange(n), 7
    while h < length:
        group = rank[order[slots]]
        # alone in its group, or past its end
        single = np.concatenate([group[1:] != group[:-1], [True]]) & np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        keep = ~single & (left[order[slots]] >= h)
        slots, group = slots[keep], group[keep]
        if not len(slots):
            break
        rows = order[slots]
        # numbered anew, groups are few enough to leave room for two ranks
        key = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
        fold = 3 if (int(key[-1]) + 1) * (n + 1) ** 2 < 1 << 63 else 2
        for step in range(1, fold):
            ahead = rows + step * h
            key = key * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, rows = key[by], rows[by]
        order[slots] = rows
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[rows] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= fold
    return order


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + sizes[i] - 1, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def expand_intervals(bwt: np.ndarray, length: int) -> np.ndarray:
    """``unset[i]``: rows i - 1 and i of the sorted suffixes share ``length`` symbols or more (rows that reach an end apart).

    Symbol 0 ends a stretch and is never extended by. Extending an interval by c leads to the rows LF[first c] ..
    LF[last c]; the first and last occurrence inside are those whose previous and next equal symbol lie outside.
    """
    n = len(bwt)
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int32)
    lf[by] = np.arange(n, dtype=np.int32)
    same = bwt[by[1:]] == bwt[by[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    del by, same
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = hi - lo
        at = _runs(lo, sizes)
        goes = bwt[at] != 0
        first = goes & (before[at] < np.repeat(lo, sizes))
        last = goes & (after[at] >= np.repeat(hi, sizes))
        # intervals of strings of one length are apart: both ends sort into the same order
        lo, hi = np.sort(lf[at[first]]).astype(np.int64), np.sort(lf[at[last]]).astype(np.int64) + 1
        fresh = unset[hi]
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        unset[hi] = False
    return unset


def repeated_in_block(texts: list[bytes], weights: list[int], min_bytes: int) -> list[np.ndarray]:
    """For every stretch the starts of strings of ``min_bytes`` that start anywhere else too; a stretch of weight w occurs w times."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[ends] = 0
    n = len(symbols)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    left = ends[owner] - np.arange(n)
    order = _sorted_suffixes(symbols, left, min_bytes)
    unset = expand_intervals(symbols[order - 1], min_bytes)  # order - 1 of the first suffix is the last end
    full = left[order] >= min_bytes
    pair = unset[1:n] & full[1:] & full[:-1]
    repeat = np.zeros(n, bool)
    repeat[1:] |= pair
    repeat[:-1] |= pair
    marked = np.zeros(n, bool)
    marked[order[repeat]] = True
    marked |= (np.array(weights)[owner] > 1) & (left >= min_bytes)
    begins = ends - sizes
    return [np.flatnonzero(marked[b:e]) for b, e in zip(begins, ends, strict=True)]


def _ranges(starts: np.ndarray) -> list[int]:
    """start, count, start, count .. of consecutive starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    firsts = starts[np.concatenate([[0], cut])]
    counts = np.diff(np.concatenate([[0], cut, [len(starts)]]))
    return np.column_stack([firsts, counts]).ravel().tolist()


# --- all blocks ------------------------------------------------------------------------------------------------


def _solve_blocks(rows: DataFrame, total_bytes: int, min_bytes: int) -> DataFrame:
    """``key, stretch, ranges`` for ``key, stretch, n, bytes``: keys are dealt to blocks of about BLOCK_BYTES."""
    blocks = max(1, -(-int(total_bytes) // BLOCK_BYTES))

    def transform(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["key", "stretch"])
        found = repeated_in_block(group["bytes"].tolist(), group["n"].tolist(), min_bytes)
        return pd.DataFrame({"key": group["key"].to_numpy(), "stretch": group["stretch"].to_numpy(), "ranges": [_ranges(f) for f in found]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(transform, "key long, stretch binary, ranges array<long>").filter("size(ranges) > 0")


def _finer(rows: DataFrame, grain: int, min_bytes: int, gram: int) -> DataFrame:
    """Stretches of at most ``grain`` starts, keyed by what all their strings have in common.

    A start's distance from its gram belongs to the string, so distances in steps of ``grain`` align the stretches of
    different texts; the common part is min_bytes - grain + 1 bytes long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for gram_key, key, stretch, n, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                holders = np.flatnonzero(RangeHash(np.frombuffer(raw, np.uint8)).of_width(gram).view(np.int64) == gram_key)
                p = np.arange(len(raw) - min_bytes + 1)
                anchor = holders[np.searchsorted(holders, p)]
                step = (anchor - p) // grain
                cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(step) != 0)) + 1
                bounds = np.concatenate([[0], cut, [len(p)]]).tolist()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    nearest = int(anchor[a]) - int(step[a]) * grain  # the last start of the step, here or not
                    common = raw[nearest:nearest - grain + 1 + min_bytes]
                    piece = raw[a:b + min_bytes - 1]
                    fine = int.from_bytes(_digest(b"%d|" % int(step[a]) + common)[:8], "little", signed=True)
                    for column, value in zip(out, (gram_key, key, stretch, a, fine, _digest(piece), n, piece), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                             ["gram_key", "key", "stretch", "at", "fine_key", "fine_stretch", "n", "bytes"])

    return rows.select("gram_key", "key", "stretch", "n", "bytes").mapInArrow(
        run, "gram_key long, key long, stretch binary, at long, fine_key long, fine_stretch binary, n long, bytes binary")


def _solve(rows: DataFrame, sizes: DataFrame, grains: tuple[int, ...], min_bytes: int, gram: int) -> DataFrame:
    """``key, stretch, ranges`` of the stretches that hold repeats.

    ``rows``: ``gram_key, key, stretch, n, bytes``; ``sizes``: ``key, stretches, total`` of the same keys. A crowded key has
    its stretches split at the next grain; parts whose key occurs once leave, equal parts are merged.
    """
    crowded = durable(sizes.filter(F.col("stretches") > CROWDED).select("key"))
    if not grains or crowded.isEmpty():
        return _solve_blocks(rows, sizes.agg(F.sum("total")).first()[0] or 0, min_bytes)
    rows = stash(rows, "suffix-stretches")
    plain = sizes.join(crowded, "key", "left_anti")
    done = _solve_blocks(rows.join(crowded, "key", "left_anti"), plain.agg(F.sum("total")).first()[0] or 0, min_bytes)
    parts = stash(_finer(rows.join(crowded, "key", "left_semi"), grains[0], min_bytes, gram), "suffix-parts")
    merged = parts.groupBy("fine_key", "fine_stretch").agg(F.sum("n").alias("n"), F.max(F.octet_length("bytes")).alias("size"))
    fine_sizes = durable(merged.groupBy("fine_key").agg(F.sum("n").alias("n"), F.count("*").alias("stretches"), F.sum("size").alias("total"))
                         .filter("n > 1").select(F.col("fine_key").alias("key"), "stretches", "total"))
    kept = merged.join(fine_sizes.select(F.col("key").alias("fine_key")), "fine_key").select("fine_key", "fine_stretch", F.col("n").alias("weight"))
    fine_rows = parts.dropDuplicates(["fine_key", "fine_stretch"]).join(kept, ["fine_key", "fine_stretch"]).select(
        "gram_key", F.col("fine_key").alias("key"), F.col("fine_stretch").alias("stretch"), F.col("weight").alias("n"), "bytes")
    fine = _solve(fine_rows, fine_sizes, grains[1:], min_bytes, gram)
    back = parts.select("key", "stretch", "at", "fine_key", "fine_stretch").join(
        fine.select(F.col("key").alias("fine_key"), F.col("stretch").alias("fine_stretch"), "ranges"), ["fine_key", "fine_stretch"])
    shifted = F.transform("ranges", lambda x, i: F.when(i % 2 == 0, x + F.col("at")).otherwise(x))
    return done.union(back.groupBy("key", "stretch").agg(F.flatten(F.collect_list(shifted)).alias("ranges")))


def repeated_ranges(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, grains: tuple[int, ...] = GRAINS) -> DataFrame:
    """``doc_id, unit, ranges``: per text the runs (start, count, start, count ..) of starts of repeated strings."""
    found = stash(_find_stretches(docs, min_bytes, gram), "suffix-found")
    # fixed-width counts that combine on the map side; what is left is text that may repeat
    twice = found.groupBy("key").agg(F.sum("grams").alias("n")).filter("n > 1").select("key")
    found = stash(found.join(twice, "key", "left_semi"), "suffix-candidates")
    merged = stash(found.groupBy("key", "stretch").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "unit", "lo", "starts")).alias("place")), "suffix-merged")
    size = F.col("place.starts") + (min_bytes - 1)
    sizes = durable(merged.groupBy("key").agg(F.count("*").alias("stretches"), F.sum(size).alias("total")))
    wanted = merged.groupBy(F.col("place.doc_id").alias("w_id"), F.col("place.unit").alias("w_unit")).agg(F.collect_list(
        F.struct("key", "stretch", "n", "place.lo", "place.starts")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[], [], [], []]
                for text, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for w in asked:
                        for column, value in zip(out, (w["key"], w["stretch"], w["n"], raw[w["lo"]:w["lo"] + w["starts"] + min_bytes - 1]), strict=True):
                            column.append(value)
                key = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays([key, key, pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                                                 ["gram_key", "key", "stretch", "n", "bytes"])

    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("unit") == F.col("w_unit"))
    rows = _identified(docs).join(wanted, same).select("text", "wanted")         .mapInArrow(cut, "gram_key long, key long, stretch binary, n long, bytes binary")
    solved = stash(_solve(rows, sizes, grains, min_bytes, gram), "suffix-solved")
    back = found.select("doc_id", "unit", "key", "stretch", "lo").join(solved, ["key", "stretch"])
    shifted = F.transform("ranges", lambda x, i: F.when(i % 2 == 0, x + F.col("lo")).otherwise(x))
    return back.groupBy("doc_id", "unit").agg(F.flatten(F.collect_list(shifted)).alias("ranges"))


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, grains: tuple[int, ...] = GRAINS) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept, spans``.

    Texts are UTF-8 bytes. Every byte covered by a string of ``min_bytes`` bytes that also starts anywhere else (same text
    included) is removed; strings overlap freely, never cross texts, and are judged on the input. ``kept`` (binary) is
    the rest, ``spans`` the removed runs as (start, end). Null and empty texts have 0 bytes. Repeated rows are copies of
    each other, whatever their id; null ids are allowed. Extra columns are ignored; an empty table gives an
    empty result.
    """
    ranges = repeated_ranges(docs, min_bytes, gram, grains).select(F.col("doc_id").alias("r_id"), F.col("unit").alias("r_unit"), "ranges")
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("unit") == F.col("r_unit"))
    rows = _identified(docs).join(ranges, same, "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: list[list] = [[], [], [], [], []]
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    spans: list[list[int]] = []
                    for start, count in sorted(zip(found[::2], found[1::2], strict=True)) if found else ():
                        end = start + count - 1 + min_bytes
                        if spans and start <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], end)
                        else:
                            spans.append([start, end])
                    edges = [0, *(x for span in spans for x in span), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    for column, value in zip(out, (len(raw), len(raw) - len(kept), len(spans), kept, spans), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.list_(pa.int64())))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what is left of each text, the rest itself (null where a character was cut apart), and whether something went."""
    done = remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                       F.try_validate_utf8(F.col("kept").cast("string")).alias("text"), (F.col("n_removed") > 0).alias("changed"))


OP1_SQL = f"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * MIN_BYTES})) AS w
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {MIN_BYTES - 1})) AS i FROM docs WHERE len(h) >= {2 * MIN_BYTES})
), repeated AS (
  SELECT doc_id, i FROM starts WHERE w IN (SELECT w FROM starts GROUP BY w HAVING count(*) > 1)
), numbered AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MIN_BYTES} THEN 0 ELSE 1 END AS fresh FROM repeated)
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + {MIN_BYTES} AS b FROM numbered GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM spans
  UNION ALL
  SELECT d.doc_id, coalesce(max(s.b), 0), any_value(len(h) // 2) FROM docs d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id
), kept AS (
  SELECT doc_id, coalesce(string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p), '') AS k FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256,
       TRY(decode(unhex(k))) AS text, n_removed IS NOT NULL AS changed
FROM docs d JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id)
"""
