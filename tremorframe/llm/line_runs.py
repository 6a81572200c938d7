"""Removal of repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import SPACE, read_table, stash, travels

travels(__name__)

#: A run is repeated from this many lines on; grams of so many lines are fingerprints.
RUN_LINES, GRAM_LINES = 3, 2
#: With words counted too, fewer lines are a run from this many words on, so that one long line is a run of its own.
RUN_WORDS = 50
_STRIP = "".join(chr(c) for c in (0x20, *range(0x09, 0x0E)))
_WORD = re.compile(f"[^{SPACE}]+")
ROWS = 2_000


def _windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    out = values[:len(values) - width + 1].copy()
    for k in range(1, width):
        np.minimum(out, values[k:len(values) - width + 1 + k], out=out)
    return out


def winnow(line_hashes: list[bytes], run_lines: int, gram_lines: int) -> list[tuple[int, int, int, int]]:
    """``(fingerprint, position, first, last)``: of each window of run_lines lines the least gram is selected.

    A selected gram (leftmost of equal ones) stands for the windows that start at first .. last. Any run of
    run_lines lines that occurs twice selects the same gram at the same place in both copies.
    """
    import xxhash

    n = len(line_hashes)
    if n < run_lines:
        return []
    grams = np.array([xxhash.xxh3_64_intdigest(b"".join(line_hashes[i:i + gram_lines])) for i in range(n - gram_lines + 1)], np.uint64)
    width = run_lines - gram_lines + 1
    least = _windows_min(grams, width)
    found: list[tuple[int, int, int, int]] = []
    for start, value in enumerate(least):
        at = start + int(np.argmax(grams[start:start + width] == value))
        if found and found[-1][1] == at:
            found[-1] = (*found[-1][:3], start)
        else:
            found.append((int(value.astype(np.int64)), at, start, start))
    return found


def wordy(words: list[int], run_lines: int, run_words: int) -> Iterator[tuple[int, int]]:
    """``(start, lines)`` of the windows of fewer than run_lines lines that have run_words words at least."""
    for start in range(len(words)):
        total = 0
        for n, count in enumerate(words[start:start + run_lines - 1], 1):
            total += count
            if total >= run_words:
                yield start, n


def fingerprints(docs: DataFrame, run_lines: int = RUN_LINES, gram_lines: int = GRAM_LINES, run_words: int | None = None) -> DataFrame:
    """``doc_id, text_hash, fingerprint, position, first, lines, hashes``: a row per selected gram; hashes has 16 bytes per
    line of the stretch that its windows of ``lines`` lines cover, from line ``first`` on. Lines are counted without blank
    ones. With ``run_words`` each shorter window of so many words is a row too: it holds one gram of its own size, which
    is selected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: list[list] = [[], [], [], [], [], [], []]
                for doc, text_hash, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    full = [x for line in (text or "").split("\n") if (x := line.strip(_STRIP))]
                    hashes = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in full]
                    found = [(fp, at, first, run_lines, b"".join(hashes[first:last + run_lines]))
                             for fp, at, first, last in winnow(hashes, run_lines, gram_lines)]
                    if run_words is not None:
                        for start, n in wordy([len(_WORD.findall(x)) for x in full], run_lines, run_words):
                            gram = b"".join(hashes[start:start + n])
                            found.append((int(np.uint64(xxhash.xxh3_64_intdigest(gram)).astype(np.int64)), start, start, n, gram))
                    for row in found:
                        for column, value in zip(out, (doc, text_hash, *row), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                    ["doc_id", "text_hash", "fingerprint", "position", "first", "lines", "hashes"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_hash long, fingerprint long, position int, first int, lines int, hashes binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def dealt(rows: DataFrame, counts: DataFrame, keys: list[str], tie: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys``, which gets the further key ``salt``; ``counts`` has a row a key, of ``n`` rows.

    Keys of more than one in 4 P of the counted rows (P: shuffle partitions) are fewer than 4 P, whatever the table's
    size: these few are broadcast to mark their rows, and each is dealt out over P salts by a hash of ``tie``.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = (counts.agg(F.sum("n")).first()[0] or 0) // (4 * parts)
    hot = counts.filter(F.col("n") > limit).select(*keys, F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*tie), F.lit(parts))).otherwise(0)
    salts = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return (rows.join(F.broadcast(hot), keys, "left").withColumn("salt", salt.cast("int")).drop("hot"),
            counts.withColumn("salt", F.explode(salts)).drop("n").hint("merge"))


def _line(hashes: str, at: Column, count: Column | int = 1) -> Column:
    """The hashes of ``count`` lines from line ``at`` of a stretch on."""
    return F.substring(F.col(hashes), (at * 16 + 1).cast("int"), F.lit(count * 16) if isinstance(count, int) else (count * 16).cast("int"))


def extended(met: DataFrame, gram_lines: int, run_lines: int) -> DataFrame:
    """``met`` with ``lo, hi``: the starts of its windows that also stand at the holder; null where none does.

    ``met`` has ``position, first, lines, hashes`` of a place and ``h_position, h_first, h_hashes`` of the holder of its
    fingerprint. The gram itself is compared, then the match is extended line by line to the left and to the right, as
    far as the windows reach for which the fingerprint stands. (What lies beyond has fingerprints of its own.)
    """
    size, h_size = (F.octet_length(F.col(c)) / 16 for c in ("hashes", "h_hashes"))
    own, other = F.col("position") - F.col("first"), F.col("h_position") - F.col("h_first")
    gram = F.least(F.lit(gram_lines), F.col("lines"))
    gram = F.when(F.col("lines") < run_lines, F.col("lines")).otherwise(gram)  # a shorter window is its own gram

    def reach(same) -> Column:
        steps = F.lit(run_lines - gram_lines)
        for i in range(run_lines - gram_lines, 0, -1):
            steps = F.when(~same(i), F.lit(i - 1)).otherwise(steps)
        return steps

    left = reach(lambda i: (own >= i) & (other >= i) & (_line("hashes", own - i) == _line("h_hashes", other - i)))
    right = reach(lambda i: (own + gram + i <= size) & (other + gram + i <= h_size)
                  & (_line("hashes", own + gram + (i - 1)) == _line("h_hashes", other + gram + (i - 1))))
    lo, hi = F.col("position") - F.col("left"), F.col("position") + gram + F.col("right") - F.col("lines")
    holds = (_line("hashes", own, gram) == _line("h_hashes", other, gram)) & (lo <= hi)
    return met.withColumns({"left": left, "right": right}).withColumns(
        {"lo": F.when(holds, lo).cast("int"), "hi": F.when(holds, hi).cast("int")}).drop("left", "right")


def later_runs(found: DataFrame, run_lines: int = RUN_LINES, gram_lines: int = GRAM_LINES) -> DataFrame:
    """``doc_id, text_hash, lo, hi, lines``: windows of so many lines that start at lo .. hi and also occur at an earlier place.

    A place is (doc_id, line); null ids come last. Fingerprints that occur once leave first. Each position of the others
    is joined with the first holder of its fingerprint, a ``min`` that combines on the map side, and the match is
    extended both ways. Windows at which it breaks off differ from all the holder's, so their first copy is among such
    windows too: for these the key is the whole window, again joined with its first holder. So no pairs are made, and
    the result is exact whatever the first holder looks like. Hot fingerprints and windows are dealt out over salts.
    """
    keys, place = ["fingerprint", "lines"], ["doc_id", "text_hash", "position"]
    often = stash(found.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), "line-fingerprints")
    rows, counts = dealt(found, often, keys, place)
    places = stash(rows.join(counts, [*keys, "salt"], "left_semi").drop("salt"), "line-places")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), *place)
    holders = stash(places.groupBy(*keys).agg(F.min(F.struct(order.alias("place"), "first", "hashes")).alias("h"), F.count("*").alias("n"))
                    .select(*keys, "n", F.col("h.place").alias("h_place"), F.col("h.place.position").alias("h_position"),
                            F.col("h.first").alias("h_first"), F.col("h.hashes").alias("h_hashes")), "line-holders")
    rows, counts = dealt(places, holders, keys, place)
    met = extended(rows.join(counts, [*keys, "salt"]).filter(order > F.col("h_place")), gram_lines, run_lines)
    last = F.col("first") + (F.octet_length("hashes") / 16).cast("int") - F.col("lines")
    whole = F.coalesce((F.col("lo") == F.col("first")) & (F.col("hi") == last), F.lit(False))
    met = stash(met.select("doc_id", "text_hash", "first", "lines", "lo", "hi", F.when(~whole, F.col("hashes")).alias("hashes")), "line-matches")

    starts = met.filter("hashes IS NOT NULL").withColumn("start", F.explode(F.sequence(F.col("first"), last))) \
        .filter("lo IS NULL OR start < lo OR start > hi")
    windows = starts.select("doc_id", "text_hash", "start", "lines", F.unhex(F.md5(
        _line("hashes", F.col("start") - F.col("first"), F.col("lines")))).alias("window"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "start")
    firsts = stash(windows.groupBy("window").agg(F.min(order).alias("holder"), F.count("*").alias("n")).filter("n > 1"), "line-windows")
    rows, counts = dealt(windows, firsts, ["window"], ["doc_id", "text_hash", "start"])
    rest = rows.join(counts, ["window", "salt"]).filter(order > F.col("holder"))
    return met.filter("lo IS NOT NULL").select("doc_id", "text_hash", "lo", "hi", "lines").unionByName(
        rest.select("doc_id", "text_hash", F.col("start").alias("lo"), F.col("start").alias("hi"), "lines"))


def remove_repeated_runs(docs: DataFrame, run_lines: int = RUN_LINES, gram_lines: int = GRAM_LINES,
                         run_words: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, n_runs, text``.

    Lines are compared without white space at their ends; blank lines count in no run and stay, a trailing newline
    too. A line goes if it lies in a window of ``run_lines`` lines that also occurs earlier (smaller id, or further up
    in the same text), so runs are removed to their full length and the first copy stays; windows are judged on the
    input. With ``run_words`` fewer lines in a row are a window too if they have so many words together: a repeated
    paragraph on one or two lines goes as well. Ties of null ids are ordered by a hash of the text. Repeated rows (same
    id, same text) are one place: all keep the same lines. A null text stays null with 0 lines, an empty one stays empty.
    A very long text is read whole, by one task: it takes 16 bytes a line there. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    later = later_runs(fingerprints(docs, run_lines, gram_lines, run_words), run_lines, gram_lines)
    starts = later.groupBy(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash")).agg(
        F.collect_set(F.struct("lo", "hi", "lines")).alias("starts"))
    rows = _keyed(docs).join(starts, F.col("doc_id").eqNullSafe(F.col("l_id")) & F.col("text_hash").eqNullSafe(F.col("l_hash")), "left") \
        .select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: list[list] = [[], [], [], []]
                for text, starts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    full = [i for i, line in enumerate(lines) if line.strip(_STRIP)]
                    gone = {k for s in starts or () for k in range(s["lo"], s["hi"] + s["lines"])}
                    removed = {full[k] for k in gone}
                    out[0].append(len(full))
                    out[1].append(len(gone))
                    out[2].append(sum(k - 1 not in gone for k in gone))
                    out[3].append(None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in removed))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())],
                    ["doc_id", "n_lines", "n_removed", "n_runs", "text"])

    return rows.mapInArrow(run, "doc_id long, n_lines long, n_removed long, n_runs long, text string")


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_runs(read_table(spark, sf_dir, "documents"))


def op6_line_runs_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run counts from three lines or from 50 words on."""
    return remove_repeated_runs(read_table(spark, sf_dir, "documents"), run_words=RUN_WORDS)


OP6_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^{SPACE}]') AS full_line,
         sum(CASE WHEN regexp_matches(line, '[^{SPACE}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), kept AS (
  SELECT doc_id, k, md5(regexp_replace(regexp_replace(line, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')) AS h FROM lines WHERE full_line
), windows AS (
  SELECT doc_id, k, h || lead(h, 1) OVER w || lead(h, 2) OVER w AS win FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, k + d AS k FROM later, range(3) AS r(d)
), marked AS (
  SELECT l.*, g.k IS NOT NULL AS removed FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.k = g.k AND l.full_line
)
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (removed) AS n_removed,
       count(*) FILTER (removed AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = marked.doc_id AND g.k = marked.k - 1)) AS n_runs,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '') AS text
FROM marked GROUP BY doc_id
"""

OP6_WORDS_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^{SPACE}]') AS full_line,
         sum(CASE WHEN regexp_matches(line, '[^{SPACE}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), kept AS (
  SELECT doc_id, k, md5(regexp_replace(regexp_replace(line, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')) AS h,
         len(regexp_extract_all(line, '[^{SPACE}]+')) AS n_words FROM lines WHERE full_line
), stretches AS (
  SELECT doc_id, k, h AS h1, n_words AS w1, h || lead(h, 1) OVER w AS h2, n_words + lead(n_words, 1) OVER w AS w2,
         h || lead(h, 1) OVER w || lead(h, 2) OVER w AS h3 FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), windows AS (
  SELECT doc_id, k, 1 AS n_lines, h1 AS win FROM stretches WHERE w1 >= {RUN_WORDS}
  UNION ALL SELECT doc_id, k, 2, h2 FROM stretches WHERE w2 >= {RUN_WORDS}
  UNION ALL SELECT doc_id, k, 3, h3 FROM stretches WHERE h3 IS NOT NULL
), later AS (
  SELECT doc_id, k, n_lines FROM (
    SELECT doc_id, k, n_lines, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, k + d AS k FROM later, range(3) AS r(d) WHERE d < n_lines
), marked AS (
  SELECT l.*, g.k IS NOT NULL AS removed FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.k = g.k AND l.full_line
)
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (removed) AS n_removed,
       count(*) FILTER (removed AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = marked.doc_id AND g.k = marked.k - 1)) AS n_runs,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '') AS text
FROM marked GROUP BY doc_id
"""
