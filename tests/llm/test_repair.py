"""Conversation repair against a search of all edits."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tremorframe.llm import audits, conversations

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """(cost, audit, repaired) of (role, text, must_go, cut) turns: shortest ways over whole strings, no shared prefixes."""
    legal_prefix = re.compile(r"(s?(ua)*u?)\Z")
    cells = {"": [(0, "", ())]}

    def key(roles):  # what may follow depends on this only
        return roles[:1] == "s" and len(roles) == 1, roles[-1:], roles == ""

    def inserted(found):
        out = dict(found)
        for _ in range(3):
            for k, (cost, audit, rows) in list(out.items()):
                roles = "".join(r[0][0] for r in rows)
                for new in ("user", "assistant"):
                    if legal_prefix.match(roles + new[0]):
                        offer(out, cost + 3, audit + "I", (*rows, (new, "")))
        return out

    def offer(out, cost, audit, rows):
        k = key("".join(r[0][0] for r in rows))
        if k not in out or (cost, audit) < out[k][:2]:
            out[k] = (cost, audit, rows)

    cells = inserted({key(""): (0, "", ())})
    for role, text, must_go, cut in turns:
        nxt = {}
        for cost, audit, rows in cells.values():
            roles = "".join(r[0][0] for r in rows)
            offer(nxt, cost + 4, audit + "D", rows)
            if not must_go:
                if legal_prefix.match(roles + role[:1]):
                    offer(nxt, cost + 3 * cut, audit + "K", (*rows, (role, text)))
                for new in ("user", "assistant"):
                    if legal_prefix.match(roles + new[0]):
                        offer(nxt, cost + 3 + 3 * cut, audit + "R", (*rows, (new, text)))
        cells = inserted(nxt)
    return min(c for c in cells.values() if LEGAL.match("".join(r[0][0] for r in c[2])))


def brute(rows):
    out = {}
    spaced = lambda v: " " if v is None else str(v)
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kept = groups[conv]
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, turns, counts = set(), [], collections.Counter()
        for _, role, text in kept:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in kept if t is not None]
        cost, audit, repaired = cheapest(turns)
        initials = [r[:1] for _, r, _ in kept]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, counts["blank"], counts["duplicate"], counts["truncated"],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def random_rows(rng, conversations_, longest):
    rows = []
    for conv in range(conversations_):
        for turn in sorted(rng.sample(range(longest * 2), rng.randint(1, longest))):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]),
                         rng.choice(["Yes.", "No!", "what", "", " \n", None, f"t{turn}.", f"t{turn}", "a? \t", "é."])))
    return rows


def run(spark, tmp_path, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, uid string, cost long")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    out = conversations.op13_conversations(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert out.count() == len(got)
    return got


def test_repair_equals_brute_force(spark, tmp_path):
    rows = random_rows(random.Random(5), 300, 9)
    rows += [(None, None, "user", "a."), (None, None, "assistant", "b."), (None, 3, None, None), (900, None, "user", "only null turns."),
             (901, 1, "user", "x " * 40_000 + "."), (901, 2, "assistant", "y."), (902, 5, "user", "same."), (902, 5, "user", "same."), (902, 5, "user", "same.")]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_a_long_conversation_is_cut_into_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "plans", lambda parts, plans=conversations.plans: (counted.append(parts.filter("conv = 7").count()), plans(parts))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    counted = []
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Yes.", f"{t}.", f"{t}", ""])) for t in range(3_000)]
    rows += random_rows(rng, 5, 6)
    try:
        assert run(spark, tmp_path, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert counted[0] >= 6


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


def test_a_conversation_of_which_nothing_is_left(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, tmp_path, [(conv, 0, "user", "Gone.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("length", range(5))
def test_all_short_code_strings(length):
    for codes in itertools.product("suaxdSUAX", repeat=length):
        turns = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "", c == "d", c.isupper()) for c in codes]
        assert audits.best("".join(codes)) == cheapest(turns)[:2]


def test_blocks_chain_to_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        codes = "".join(rng.choice("suaxdSUA") for _ in range(rng.randint(1, 14)))
        cuts = sorted(rng.sample(range(len(codes) + 1), min(3, len(codes))))
        pieces = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        cost, found = audits.chained([{(f, t): way for f in audits.STATES for t, way in audits.block(p, f).items()} for p in pieces])
        assert (cost, "".join(a for _, a in found)) == audits.best(codes)


def test_order_of_trails_survives_equal_hashes(monkeypatch):
    rng = random.Random(4)
    for prime in (audits._PRIME, 1, 3):
        monkeypatch.setattr(audits, "_PRIME", prime)
        trails = audits.Trails()
        nodes = [0]
        for _ in range(400):
            nodes.append(trails.add(rng.choice(nodes[-30:]), rng.choice("DIKR")))
        for _ in range(2_000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert trails.less(a, b) == (trails.text(a) < trails.text(b))
