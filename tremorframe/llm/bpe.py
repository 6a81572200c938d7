"""Byte-level BPE by merge replay over a block of the corpus.

A task splits its texts into pieces, keeps the distinct pieces of a block once, and replays the merges on all of
them together: an inverted index leads from mergeable pairs, by range of rank, to the positions that hold them, the
lowest of a word is applied first, and only the pairs at both sides of a merged position are entered anew. Results
are then laid out per text. No text and no vocabulary of the corpus leaves its task, so memory is bounded by the
block and nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tremorframe.llm.common import read_table, travels

travels(__name__)

#: Pieces of a block, and pieces that a task remembers from earlier blocks: memory, never results.
BLOCK_PIECES = 200_000
REMEMBERED = 300_000
#: Bytes up to which words are merged side by side.
LONG_WORD = 64
#: Longer texts are split into pieces step by step.
LONG_TEXT = 2_000_000


class Decoder:
    """The bytes of every token, one after the other."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = {r: t for t, r in ranks.items()}
        size = max(tokens) + 1
        self.lengths = np.array([len(tokens.get(r, b"")) for r in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens.get(r, b"") for r in range(size)), np.uint8)


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}


class Vocabulary:
    """Ranks of tokens, and what two tokens make together: every split of a token in two tokens. Pairs (left << 32 | right) lie in a
    table with open addresses, so that many are looked up at once."""

    def __init__(self, rank_file: bytes):
        self.ranks = read_ranks(rank_file)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, made = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        pairs, made = np.array(keys, np.int64), np.array(made, np.int64)
        self.bits = max(int(4 * len(pairs)).bit_length(), 4)
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        place = self._place(pairs)
        while len(pairs):
            free = np.flatnonzero(self.keys[place] < 0)
            _, first = np.unique(place[free], return_index=True)
            taken = free[first]
            self.keys[place[taken]], self.made[place[taken]] = pairs[taken], made[taken]
            rest = np.ones(len(pairs), bool)
            rest[taken] = False
            pairs, made, place = pairs[rest], made[rest], (place[rest] + 1) & (len(self.keys) - 1)
        both = np.arange(1 << 16)
        self.byte_pairs = self.merged(self.byte_rank[both >> 8] << 32 | self.byte_rank[both & 255])
        #: Ranks lie in ranges, narrow where they are low: what the index keeps together.
        self.range_of = (8 * np.log2(np.arange(max(self.ranks.values()) + 1) / 256 + 1)).astype(np.int64)

    @classmethod
    def of(cls, parts: dict) -> Vocabulary:
        """From the ``vars`` of another one: plain values, which travel without this module."""
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of what each pair makes, or -1."""
        out = np.full(len(pairs), -1, np.int64)
        at, place = np.arange(len(pairs)), self._place(pairs)
        while len(at):
            held = self.keys[place]
            same = held == pairs[at]
            out[at[same]] = self.made[place[same]]
            on = ~same & (held >= 0)
            at, place = at[on], (place[on] + 1) & (len(self.keys) - 1)
        return out

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        held = np.flatnonzero(self.keys >= 0)
        return dict(zip(self.keys[held].tolist(), self.made[held].tolist(), strict=True))


def replay_merges(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Token ids of every word, as little-endian unsigned 32-bit integers."""
    whole = [vocab.ranks.get(w) for w in words]
    out = [b"" if r is None else r.to_bytes(4, "little") for r in whole]
    short = [k for k, r in enumerate(whole) if r is None and 0 < len(words[k]) <= LONG_WORD]
    long = [k for k, r in enumerate(whole) if r is None and len(words[k]) > LONG_WORD]
    for picked, replay in ((short, _replay_ranges), (long, _replay_ranks)):
        if picked:
            for k, ids in zip(picked, _laid_out(*replay([words[k] for k in picked], vocab)), strict=True):
                out[k] = ids
    return out


def _laid_out(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    alive = ids >= 0
    flat = ids[alive].astype("<u4").tobytes()
    bounds = (4 * np.concatenate([[0], np.cumsum(alive)[ends - 1]])).tolist()
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _chained(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, the ends of the words, and for each place the ones after and before it in its word (or -1)."""
    raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    places = np.arange(len(raw))
    after, before = places + 1, places - 1
    after[ends - 1] = -1
    before[0] = before[ends[:-1]] = -1
    return raw, ends, after, before


def _replay_ranges(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merges of many words at once. The inverted index leads from a range of ranks to the places whose pair has one of them; the lowest
    range is taken, each word in it merges its lowest pair (the leftmost of equal ones), and the pairs at both sides enter the
    index anew. Words do not touch each other, so the order is that of one rank after the other."""
    raw, ends, after, before = _chained(words)
    ids, n = vocab.byte_rank[raw], len(raw)
    word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    rank = np.full(n, -1, np.int64)  # of the pair that begins at a place
    rank[:-1] = vocab.byte_pairs[raw[:-1] << 8 | raw[1:]]
    rank[ends - 1] = -1
    index: dict[int, list[np.ndarray]] = {}
    lowest = np.empty(len(words), np.int64)

    def enter(places: np.ndarray) -> None:
        ranges = vocab.range_of[rank[places]]
        order = np.argsort(ranges, kind="stable")
        found, begin = np.unique(ranges[order], return_index=True)
        for r, part in zip(found.tolist(), np.split(places[order], begin[1:])[:len(found)], strict=True):
            index.setdefault(r, []).append(part)

    enter(np.flatnonzero(rank >= 0))
    while index:
        now = min(index)
        open_, new = np.concatenate(index.pop(now)), [np.zeros(0, np.int64)]
        while len(open_):
            r = rank[open_]
            held = (r >= 0) & (vocab.range_of[r] == now)  # a neighbour may have been merged meanwhile
            open_, r = open_[held], r[held]
            key, w = r << 32 | open_, word[open_]
            lowest[w] = np.iinfo(np.int64).max
            np.minimum.at(lowest, w, key)
            first = key == lowest[w]
            p, made, open_ = open_[first], r[first], open_[~first]
            q, left = after[p], before[p]
            right = after[q]
            ids[p], ids[q], rank[p], rank[q], after[p] = made, -1, -1, -1, right
            to_right, to_left = np.flatnonzero(right >= 0), np.flatnonzero(left >= 0)
            right, left = right[to_right], left[to_left]
            before[right] = p[to_right]
            rank[p[to_right]] = vocab.merged(made[to_right] << 32 | ids[right])
            rank[left] = vocab.merged(ids[left] << 32 | made[to_left])
            beside = np.concatenate([p[to_right], left])
            beside = beside[rank[beside] >= 0]
            ranges = vocab.range_of[rank[beside]]
            new.append(beside[ranges != now])
            open_ = np.concatenate([open_, beside[ranges == now]])
            if len(ranges) and ranges.min() < now:  # a lower pair goes first, the rest waits
                index[now] = [open_]
                break
        enter(np.concatenate(new))
    return ids, ends


def _replay_ranks(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merges of words that may be long: the lowest rank is applied at all its places, one rank after the other."""
    raw, ends, later, earlier = _chained(words)
    n = len(raw)
    ids, after, before = vocab.byte_rank[raw].tolist(), later.tolist(), earlier.tolist()

    # inverted index: rank of a pair -> positions of its left token
    first = np.full(n, -1, np.int64)
    first[:-1] = vocab.byte_pairs[raw[:-1] << 8 | raw[1:]]
    first[ends - 1] = -1
    held = np.flatnonzero(first >= 0)
    held = held[np.argsort(first[held], kind="stable")]
    ranks, begin = np.unique(first[held], return_index=True)
    index = {r: part.tolist() for r, part in zip(ranks.tolist(), np.split(held, begin[1:]), strict=True)} if len(held) else {}
    waiting = ranks.tolist()  # in order, so a heap
    pair, none = vocab.pairs.get, -1
    while waiting:
        rank = heapq.heappop(waiting)
        positions = index.pop(rank)
        positions.sort()
        for k, p in enumerate(positions):
            q = after[p]
            left = ids[p]
            if q < 0 or left < 0 or pair(left << 32 | ids[q]) != rank:
                continue  # a neighbour was merged meanwhile
            ids[p], ids[q] = rank, -1
            right = after[p] = after[q]
            least = rank + 1
            if right >= 0:
                before[right] = p
                r = pair(rank << 32 | ids[right], none)
                if r >= 0:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(waiting, r)
                    least = r
            left = before[p]
            if left >= 0:
                r = pair(ids[left] << 32 | rank, none)
                if r >= 0:
                    if r in index:
                        index[r].append(left)
                    else:
                        index[r] = [left]
                        heapq.heappush(waiting, r)
                    least = min(least, r)
            if least <= rank:  # a new pair goes first, or is another place of this rank: the rest waits
                if rank in index:
                    index[rank] += positions[k + 1:]
                else:
                    index[rank] = positions[k + 1:]
                    heapq.heappush(waiting, rank)
                break
    return np.array(ids, np.int64), ends


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Texts to ids; remembers the pieces of earlier blocks."""

    def __init__(self, rank_file: bytes | Vocabulary, pattern: str):
        import regex

        self.vocab = Vocabulary(rank_file) if isinstance(rank_file, bytes) else rank_file
        self.pattern, self.known = regex.compile(pattern), {}

    def pieces_of(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        part: list[str] = []
        for m in self.pattern.finditer(text):
            part.append(m[0])
            if len(part) == BLOCK_PIECES:
                yield part
                part = []
        yield part

    def block(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and the number of ids of each piece."""
        codes, words = pd.factorize(np.array(pieces, dtype=object))
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        self.known.update(zip(new, replay_merges([w.encode("utf-8", "surrogatepass") for w in new], self.vocab), strict=True))
        found = [self.known[w] for w in words]
        lengths = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
        flat = np.frombuffer(b"".join(found), "<u4")
        starts = np.cumsum(lengths) - lengths
        return flat[_gather(starts[codes], lengths[codes])], lengths[codes]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        pieces: list[str] = []
        owners: list[tuple[int, bool]] = []  # pieces of a text's part, and whether it is the last part
        done = b""
        for text in texts:
            parts = list(self.pieces_of(text or "")) if len(text or "") <= LONG_TEXT else self.pieces_of(text)
            for part in parts:
                pieces += part
                owners.append((len(part), False))
                if len(pieces) >= BLOCK_PIECES:
                    done = yield from self._flush(pieces, owners, done)
                    pieces, owners = [], []
            owners.append((0, True))
        yield from self._flush(pieces, owners, done)

    def _flush(self, pieces, owners, done):
        if pieces:
            ids, lengths = self.block(pieces)
        else:
            ids, lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = 0
        for n, last in owners:
            done += ids[ends[at]:ends[at + n]].astype("<u4").tobytes()
            at += n
            if last:
                yield done
                done = b""
        return done


def encode(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers in one binary).

    As ``encode_ordinary`` of a tokenizer with these ranks: no special tokens; a piece that is a token is taken
    whole. Null and empty texts have no tokens. Repeated rows are encoded each by itself, extra columns are ignored,
    an empty table gives an empty result. The vocabulary and its pairs (some ten megabytes, fixed) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vars(Vocabulary(rank_file)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, words = shared.value
        encoder = Encoder(Vocabulary.of(parts), words)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                found = list(encoder.encode(rows.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())],
                    ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """``encoded`` with the binary column ``decoded``: the bytes of its ids, one token after the other."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(Decoder(read_ranks(rank_file))))
    names = encoded.columns
    place = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts, blob = (shared.value[n] for n in ("lengths", "starts", "blob"))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                decoded = []
                for x in rows.column(place).to_pylist():
                    ids = np.frombuffer(x or b"", "<u4")
                    decoded.append(blob[_gather(starts[ids], lengths[ids])].tobytes())
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(decoded, pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField("decoded", BinaryType())]))


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def digested(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    both = decode(encode(docs, rank_file, pattern), rank_file)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(read_table(spark, sf_dir, "documents"), *public_vocabulary())
