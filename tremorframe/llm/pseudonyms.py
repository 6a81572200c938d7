"""Format-preserving pseudonyms for personal data.

Validated numbers, dates, addresses and names of mailboxes are replaced by other valid values of the same format. The
replacement is a keyed permutation of the value's domain (an alternating Feistel network), so equal values
get equal pseudonyms in all documents, different values different ones, and the owner of the key can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tremorframe.llm.common import read_table, travels

travels(__name__)

ROUNDS = 10
#: The key of the registered query; a real run passes its own secret.
TEST_KEY = b"pseudonym test key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
ROWS = 2_000

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _round(key: bytes, kind: str, i: int, value: int, size: int) -> int:
    """A number below ``size``; 128 bits more than needed, so that the remainder is close to even."""
    width = (size.bit_length() + 135) // 8
    raw = hashlib.shake_256(b"%d|%d|" % (len(key), i) + key + f"|{kind}|{size}|{value}".encode()).digest(width)
    return int.from_bytes(raw, "big") % size


def permute(value: tuple[int, int], sizes: tuple[int, int], key: bytes, kind: str, back: bool = False) -> tuple[int, int]:
    """A permutation of the pairs below ``sizes``; ``back`` inverts it."""
    left, right = value
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2 == 0:
            left = (left + sign * _round(key, kind, i, right, sizes[0])) % sizes[0]
        else:
            right = (right + sign * _round(key, kind, i, left, sizes[1])) % sizes[1]
    return left, right


def permute_symbols(symbols: list[int], radices: list[int], key: bytes, kind: str, back: bool = False) -> list[int]:
    """A permutation of the words with ``symbols[i] < radices[i]``."""
    cut = len(symbols) // 2

    def pack(a: int, b: int) -> tuple[int, int]:
        value, size = 0, 1
        for s, r in zip(symbols[a:b], radices[a:b], strict=True):
            value, size = value * r + s, size * r
        return value, size

    (left, left_size), (right, right_size) = pack(0, cut), pack(cut, len(symbols))
    left, right = permute((left, right), (left_size, right_size), key, kind, back)
    out = [0] * len(symbols)
    for value, a, b in ((left, 0, cut), (right, cut, len(symbols))):
        for i in reversed(range(a, b)):
            value, out[i] = divmod(value, radices[i])
    return out


def permute_below(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A permutation of 0 .. size - 1 by walking the cycle in the next rectangle."""
    side = int(size**0.5) + 1
    while True:
        a, b = permute(divmod(value, side), (side, side), key, kind, back)
        value = a * side + b
        if value < size:
            return value


def luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))


def _in_place(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order; separators stay."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _number(digits: str, radices: list[int], offsets: list[int], key: bytes, kind: str, back: bool) -> str:
    """Digit i is offsets[i] plus a symbol below radices[i]."""
    symbols = [int(d) - o for d, o in zip(digits, offsets, strict=True)]
    new = permute_symbols(symbols, radices, key, f"{kind}{len(digits)}", back)
    return "".join(str(s + o) for s, o in zip(new, offsets, strict=True))


def card(m: str, key: bytes, back: bool = False) -> str | None:
    """13 to 19 digits that pass the Luhn test; the first digit stays, the last one is the new check digit."""
    d = _digits(m)
    if not 13 <= len(d) <= 19 or luhn_sum(d) % 10 or len(set(d)) == 1:
        return None
    n = len(d) - 2
    body = d[0] + _number(d[1:-1], [10] * n, [0] * n, key, "card" + d[0], back)
    return _in_place(m, body + str(-luhn_sum(body + "0") % 10))


def iban(m: str, key: bytes, back: bool = False) -> str | None:
    """Two letters, two check digits, 11 to 30 letters or digits with remainder 1 modulo 97."""
    plain = m.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _remainder97(plain) != 1:
        return None
    body = _symbols(plain[4:], key, "iban" + plain[:2], back)
    head = plain[:2] + f"{98 - _remainder97(plain[:2] + '00' + body):02d}"
    new = iter(head + body)
    return "".join(c if c == " " else next(new) for c in m)


def _remainder97(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _symbols(text: str, key: bytes, kind: str, back: bool) -> str:
    """Letters become letters of the same case, digits digits; everything else stays."""
    places, sets = [], []
    for i, c in enumerate(text):
        for chars in (DIGITS, UPPER, LOWER):
            if c in chars:
                places.append(i)
                sets.append(chars)
    shape = "".join("d" if s is DIGITS else "U" if s is UPPER else "l" for s in sets)
    new = permute_symbols([s.index(text[i]) for i, s in zip(places, sets, strict=True)], [len(s) for s in sets], key, f"{kind}/{shape}", back)
    out = list(text)
    for i, s, v in zip(places, sets, new, strict=True):
        out[i] = s[v]
    return "".join(out)


def social(m: str, key: bytes, back: bool = False) -> str | None:
    """ddd-dd-dddd with an area of 001-665, 667-899, a group and a serial that are not zero."""
    a, g, s = int(m[:3]), int(m[4:6]), int(m[7:])
    if not 1 <= a <= 899 or a == 666 or not g or not s:
        return None
    value = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    value, s = divmod(permute_below(value, 898 * 99 * 9999, key, "social", back), 9999)
    a, g = divmod(value, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def phone(m: str, key: bytes, back: bool = False) -> str | None:
    """A North American number (area and exchange begin with 2-9), or + and 8 to 15 digits, of which the country's stay."""
    d = _digits(m)
    plus = m.lstrip().startswith("+")
    if plus and d[0] != "1":
        keep = len(_digits(re.match(r"\s*\+(\d{1,3})", m)[0]))
        if not 8 <= len(d) <= 15 or len(d) - keep < 4:
            return None
        n = len(d) - keep
        return _in_place(m, d[:keep] + _number(d[keep:], [10] * n, [0] * n, key, "phone" + d[:keep], back))
    country, local = d[:-10], d[-10:]
    if country not in ("", "1") or len(local) < 10 or not (plus or _north_american(local)):
        return None
    if _north_american(local):
        radices, offsets = [8, 10, 10, 8, 10, 10, 10, 10, 10, 10], [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
        return _in_place(m, country + _number(local, radices, offsets, key, "phone", back))
    while True:  # +1 and ten digits outside the plan: on along the cycle until they are outside again
        local = _number(local, [10] * 10, [0] * 10, key, "phone+1", back)
        if not _north_american(local):
            return _in_place(m, country + local)


def _north_american(local: str) -> bool:
    return local[0] not in "01" and local[3] not in "01"


def address(m: str, key: bytes, back: bool = False) -> str | None:
    """Four octets."""
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, permute_symbols([int(p) for p in parts], [256] * 4, key, "address", back)))


def mailbox(m: str, key: bytes, back: bool = False) -> str | None:
    """The name before the @; the domain stays, case apart."""
    name, _, domain = m.rpartition("@")
    if not any(c in DIGITS + UPPER + LOWER for c in name):
        return None
    return f"{_symbols(name, key, 'mailbox' + domain.lower(), back)}@{domain}"


def date(m: str, key: bytes, back: bool = False) -> str | None:
    """A calendar day from 1900 to 2099: y-m-d with -, / or ., or d.m.y, d-m-y or m/d/y; separators and the width of each part stay."""
    a, s, b, c = re.fullmatch(r"(\d{1,4})([-/.])(\d{1,2})\2(\d{1,4})", m).groups()
    if len(a) == 4:
        order = (0, 1, 2)
    elif len(c) == 4:
        order = (2, 0, 1) if s == "/" else (2, 1, 0)
    else:
        return None
    parts = [int(a), int(b), int(c)]
    y, mo, d = (parts[i] for i in order)
    try:
        day = datetime.date(y, mo, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    widths = [len((a, b, c)[i]) for i in order[1:]]
    while True:  # on along the cycle until month and day have their widths again
        day = FIRST_DAY + permute_below(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back)
        new = datetime.date.fromordinal(day)
        if all(w == 2 or v < 10 for w, v in zip(widths, (new.month, new.day), strict=True)):
            break
    out = [""] * 3
    for i, v, w in zip(order, (new.year, new.month, new.day), (4, *widths), strict=True):
        out[i] = f"{v:0{w}d}"
    return s.join(out)


#: Kind, pattern, replacement, in the order of trial at a place. A pattern that is not validated leaves the text to the next.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z]{2,}(?![A-Za-z0-9])", mailbox),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", iban),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", address),
    ("date", r"(?<![\w./\-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\w]|[-/.]\d)", date),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)", social),
    ("card", r"(?<![\w])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?!\d)", card),
    ("phone", r"(?<![\w+])(?:\+1[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)", phone),
    ("phone", r"(?<![\w])\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?!\d)", phone),
    ("phone", r"(?<![\w+])1?[2-9]\d{2}[2-9]\d{6}(?!\w)", phone),
)
NAMES = ("email", "iban", "ip", "date", "ssn", "card", "phone")


class Pseudonymiser:
    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.kinds = [(name, re.compile(pattern), make) for name, pattern, make in KINDS]

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The text with pseudonyms, and how many values of each of ``NAMES`` were replaced."""
        spans: list[tuple[int, int, str, str]] = []
        if any(c in text for c in DIGITS + "@"):
            for order, (name, pattern, make) in enumerate(self.kinds):
                if name == "email" and "@" not in text:
                    continue
                for m in pattern.finditer(text):
                    new = make(m[0], self.key, self.back)
                    if new is not None:
                        spans.append((order, m.start(), m.end(), name, new))
        # an earlier kind wins; of one kind the matches are apart
        chosen: list = []
        taken = _Intervals()
        for order, a, b, name, new in spans:
            if taken.add(a, b):
                chosen.append((a, b, name, new))
        counts = [0] * len(NAMES)
        out, at = [], 0
        for a, b, name, new in sorted(chosen):
            out += [text[at:a], new]
            at = b
            counts[NAMES.index(name)] += 1
        return "".join([*out, text[at:]]), counts


class _Intervals:
    """Spans that do not overlap, kept in order."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, a: int, b: int) -> bool:
        import bisect

        i = bisect.bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, text`` with pseudonyms, and ``n_email, n_iban, n_ip, n_date, n_ssn, n_card, n_phone``.

    Numbers that do not validate (Luhn, modulo 97, calendar, octets, numbering plans) are ordinary text. ``back`` with
    the same key restores the values: a pseudonym is valid wherever its value was. A null text stays null with counts
    of 0, repeated rows get equal results, extra columns are ignored, an empty table gives an empty result.
    """
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *[StructField(f"n_{n}", LongType()) for n in NAMES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonymiser(key, back)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                done = [(None, [0] * len(NAMES)) if t is None else work(t) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([t for t, _ in done], pa.string()),
                     *[pa.array([c[i] for _, c in done], pa.int64()) for i in range(len(NAMES))]],
                    schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"), TEST_KEY)
