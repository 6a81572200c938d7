"""Repair of the turn structure of conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tremorframe.llm import audits
from tremorframe.llm.common import SPACE, read_table, stash, travels

travels(__name__)

#: Audits of short conversations are kept by their turns' codes; the memory is emptied when it has so many entries.
MEMORY, SHORT = 50_000, 64
_NO_TURNS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing
_FAULTS = ("blank", "duplicate", "truncated")


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` with the planted faults: by the checksum of conversation and turn a row goes, loses its text or its
    sentence ends, comes twice, or becomes a user's. Nulls are one space, in the checksum, the role and the text."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"])) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    return rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(spaced["role"]).alias("role"),
        text.alias("text"), kind.alias("kind"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")
    ).filter("kind <> 0").drop("kind", "copy")


def _code(initial: Column, fault: Column) -> Column:
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(fault.isin("blank", "duplicate"), F.lit("d")).when(fault == "truncated", F.upper(known)).otherwise(known)


def judged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, digest, uid, initial, fault, code`` of the rows of ``with_uids``: the first fault that applies, or null.

    A duplicate is any but the first of equal roles and texts of a conversation. The first is a minimum, combined on the
    map side, and handed back by the row's own number: no task receives all copies of a text.
    """
    text, initial = F.col("text"), F.substring("role", 1, 1)
    light = rows.select("conv", "turn", "role", "uid", F.unhex(F.sha2(text, 256)).alias("digest"), (~text.rlike(f"[^{SPACE}]")).alias("blank"),
                        (~text.rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated"))
    first = light.filter(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "uid")).alias("first")) \
        .select(F.col("first.uid").alias("uid"), F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return light.join(first, "uid", "left").withColumns({"fault": fault, "initial": initial}).select(
        "conv", "turn", "role", "digest", "uid", "initial", "fault").withColumn("code", _code(F.col("initial"), F.col("fault")))


_PART = ("rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
         "min_turn long, max_turn long, n_turns long, first_turn long, last_turn long")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conversation, lists of turns, initials, faults, codes, uids)`` of consecutive rows of one conversation."""
    held: list | None = None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "initial", "fault", "code", "uid")]
        conv = columns[0]
        at = 0
        while at < len(conv):
            to = at + 1
            while to < len(conv) and conv[to] == conv[at]:
                to += 1
            if held is not None and held[0] == conv[at]:
                for mine, more in zip(held[1], columns[1:], strict=True):
                    mine.extend(more[at:to])
            else:
                if held is not None:
                    yield tuple(held)
                held = [conv[at], [c[at:to] for c in columns[1:]]]
            at = to
    if held is not None:
        yield tuple(held)


def _summary(turns: list, initials: list, faults: list) -> dict:
    known = [t for t in turns if t is not None]
    return {"rows": len(turns), **{f: faults.count(f) for f in _FAULTS},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            "first_initial": initials[0], "last_initial": initials[-1], "min_turn": min(known, default=None), "max_turn": max(known, default=None),
            "n_turns": len(set(known)), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None}


def stretches(ordered: DataFrame) -> DataFrame:
    """``conv, stretch, ends, codes, uids, ways`` and counts, of sorted partitions: a row for each run of a conversation's turns in one partition,
    with counts, and the cheapest edits between all states before and after it. Of a conversation that lies inside a partition
    (``ends`` is false) only the edits of the whole are kept."""
    conv = ordered.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, stretch int, ends boolean, codes string, uids array<long>, ways array<struct<before: int, after: int, cost: long, audit: string>>, {_PART}"
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        memory: dict[str, tuple[int, str]] = {}

        def row(found: tuple, ends: bool) -> dict:
            (turns, initials, faults, codes, uids) = found[1]
            text = "".join(codes)
            if ends:
                ways = [{"before": f, "after": t, "cost": c, "audit": a} for f in audits.STATES for t, (c, a) in audits.block(text, f).items()]
            else:
                whole = memory.get(text)
                if whole is None:
                    whole = audits.best(text)
                    if len(text) <= SHORT:
                        if len(memory) >= MEMORY:
                            memory.clear()
                        memory[text] = whole
                ways = [{"before": audits.NOTHING, "after": audits.NOTHING, "cost": whole[0], "audit": whole[1]}]
            return {"conv": found[0], "stretch": number, "ends": ends, "codes": text, "uids": uids, "ways": ways, **_summary(turns, initials, faults)}

        out, before, first = [], None, True
        for found in _stretches(batches):  # the first and the last may go on in another partition
            if before is not None:
                out.append(row(before, first))
                first = False
                if len(out) >= 2_000:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
            before = found
        if before is not None:
            out.append(row(before, True))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return ordered.mapInArrow(run, schema)


def _combined(parts: list[dict]) -> dict:
    """Counts of consecutive stretches of one conversation."""
    total = dict(parts[0])
    for p in parts[1:]:
        for name in ("rows", *_FAULTS):
            total[name] += p[name]
        total["illegal"] += p["illegal"] + (total["last_initial"] + p["first_initial"] not in ("su", "ua", "au"))
        total["last_initial"] = p["last_initial"]
        total["n_turns"] += p["n_turns"] - (p["first_turn"] is not None and p["first_turn"] == total["last_turn"])
        for name, pick in (("min_turn", min), ("max_turn", max)):
            total[name] = pick((v for v in (total[name], p[name]) if v is not None), default=None)
        total["last_turn"] = p["last_turn"] if p["last_turn"] is not None else total["last_turn"]
    return total


def plans(parts: DataFrame) -> DataFrame:
    """``conv, at, before, codes, uids, audit, report``: what to do with each stretch, and once per conversation its report.

    Conversations inside one partition pass through. The others, two for each partition at most, meet in the order of their
    stretches; one of them holds the audits of its stretches, a few times the size of its own audit in the result.
    """
    conv = parts.schema["conv"].dataType.simpleString()
    schema = (f"conv {conv}, at long, before int, codes string, uids array<long>, audit string, "
              "report struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>")
    kinds = _arrow(schema)

    def report(total: dict, cost: int, audit: str) -> dict:
        gaps = total["max_turn"] - total["min_turn"] + 1 - total["n_turns"] if total["n_turns"] else 0
        return {"gaps": gaps, **{f: total[f] for f in _FAULTS}, "illegal": total["illegal"], "cost": cost, "audit": audit}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                way = r["ways"][0]
                rows.append({"conv": r["conv"], "at": 0, "before": audits.NOTHING, "codes": r["codes"], "uids": r["uids"], "audit": way["audit"],
                             "report": report(r, way["cost"], way["audit"])})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    def joined(parts: list[dict]) -> list[dict]:
        cost, found = audits.chained([{(w["before"], w["after"]): (w["cost"], w["audit"]) for w in p["ways"]} for p in parts])
        rows, at = [], 0
        for p, (before, audit) in zip(parts, found, strict=True):
            rows.append({"conv": p["conv"], "at": at, "before": before, "codes": p["codes"], "uids": p["uids"], "audit": audit, "report": None})
            at += len(audit)
        rows[0]["report"] = report(_combined(parts), cost, "".join(a for _, a in found))
        return rows

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["conv"] != r["conv"]:
                    yield pa.RecordBatch.from_pylist(joined(held), schema=kinds)
                    held = []
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist(joined(held), schema=kinds)

    inside = parts.filter(~F.col("ends")).mapInArrow(whole, schema)
    over = parts.filter("ends").repartition("conv").sortWithinPartitions("conv", "stretch").mapInArrow(across, schema)
    return inside.unionByName(over)


def edits(planned: DataFrame) -> DataFrame:
    """``conv, at, edit, uid, new_role``: a row per edit but the deletions; inserted turns have no uid."""
    conv = planned.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["conv", "at", "before", "codes", "uids", "audit"]).to_pylist():
                state, turn, out = r["before"], 0, ([], [], [], [])
                for number, letter in enumerate(r["audit"]):
                    uid = None
                    if letter != "I":
                        uid = r["uids"][turn]
                        turn += 1
                    if letter == "D":
                        continue
                    # a kept turn has the only initial that its place allows, or opens the conversation for the system
                    opens = letter == "K" and r["codes"][turn - 1] in "sS"
                    state = audits.SYSTEM if opens else audits.NEXT[state]
                    for column, value in zip(out, (r["at"] + number, letter, uid, None if letter == "K" else audits.ROLES[state]), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["conv"]] * len(out[0]), batch.schema.field("conv").type), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()),
                     pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["conv", "at", "edit", "uid", "new_role"])

    return planned.mapInArrow(run, f"conv {conv}, at long, edit string, uid long, new_role string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(report, turns)`` of ``conv, turn, role, text`` rows.

    ``report`` has a row per conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``. ``turns`` are the
    repaired conversations: ``conv, at`` (their order), ``edit, role, text``.

    The turns of a conversation are ordered by ``turn`` (nulls first; equal ones by role, a digest of the text, and last the row's
    number). Its first fault makes a turn blank (no character but white space), a duplicate (role and text seen earlier) or
    truncated (the last such character is no ``.``, ``!`` or ``?``). Turns are kept, rewritten to the other role, deleted or
    inserted at the least cost so that roles read ``(s?(ua)+)?``; of equally cheap edits those come out whose initials are the
    ASCII-least. Null roles and texts count as one space; a null conversation id is a conversation. Repeated rows are duplicates.
    An empty table gives empty results; other columns are ignored.

    Turns are range-partitioned in their order, so a long conversation is cut into stretches of several tasks, and the edits
    between all states of a stretch are found by each; texts stay out of that and are joined to the edits by row number. Very long
    texts cost what their bytes cost.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    held = stash(rows.select("conv", F.col("turn").cast("long").alias("turn"), spaced["role"].alias("role"), spaced["text"].alias("text"))
                 .withColumn("uid", F.monotonically_increasing_id()), "turns")
    order = ["conv", "turn", "role", "digest", "uid"]
    light = stash(judged(held), "judged-turns")
    parts = stash(stretches(light.repartitionByRange(*order).sortWithinPartitions(*order)
                            .select("conv", "turn", "initial", "fault", "code", "uid")), "stretches")
    planned = stash(plans(parts), "edit-plans")
    report = planned.filter(F.col("report").isNotNull()).select("conv", "report.*")
    turns = edits(planned).join(held.select("uid", "role", "text"), "uid", "left").select(
        "conv", "at", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return report, turns


def digests(turns: DataFrame) -> DataFrame:
    """``conv, sha256`` of the turns' ``role:text``, newline-joined. One digest is one chain, so a conversation passes through one task:
    sorted there and fed turn by turn, never held."""
    conv = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        state, held = None, None
        for batch in batches:
            kind, names, sums = batch.schema.field("conv").type, [], []
            for name, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv", "role", "text")], strict=True):
                if state is None or name != held:
                    if state is not None:
                        names.append(held)
                        sums.append(state.hexdigest())
                    state, held = sha256(), name
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(sums, pa.string())], ["conv", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([state.hexdigest()])], ["conv", "sha256"])

    return turns.select("conv", "at", "role", "text").repartition("conv").sortWithinPartitions("conv", "at") \
        .select("conv", "role", "text").mapInArrow(run, f"conv {conv}, sha256 string")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations: their faults, the cheapest edits and a digest of what is left."""
    rows = read_table(spark, sf_dir, "conversations")
    report, turns = repair(damaged(rows))
    counts = ("gaps", *_FAULTS, "illegal", "cost")
    # three tables by conversation, each a row for one: the union needs no null-safe join
    parts = [rows.select(F.col("conv_id").alias("conv")), report, digests(turns)]
    union = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return union.groupBy("conv").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.lit(_NO_TURNS)).alias("repaired_sha256")).withColumnRenamed("conv", "conv_id")
