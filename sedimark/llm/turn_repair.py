"""Conversation structure repair by a rank-compressed dynamic programme.

Edits of a conversation are layers, one for each turn: a macro edit is a run of at most two insertions and what happens to the turn (a longer run would come back to where it
was, at a cost). Macro edits are the words `D K R ID IK IR IID IIK IIR`, of which none begins another, so of two audits over equally many turns none begins the
other either, and their order is that of the first macro edit that differs. So a state needs no audit string: it has its least cost and the rank of its
audit among those of its layer, and the next layer's ranks follow from (rank of the parent, macro edit). Parent pointers give the audit afterwards.
An audit decides which state it leads to, so two states never share a rank. A layer's costs less their least, its ranks and the kind of turn decide the next layer: such steps are
remembered and a turn mostly costs one lookup.

States: nothing yet, after a system turn, after a user turn, after an assistant turn. The first and last accept.

Rows of a conversation of at most `crowd` rows meet in one task and are folded as they come. Conversations with more are split by ranges of their order (repeated rows too); each range
gives least costs and ranks from every state to every state, these are composed, and each range is then repaired between the states that it was given. Nothing in
that path holds a conversation but the digest of its repaired text, one stream by definition, and the audit, one string.

Defined results. Damage: null role and text become one space, and so does a null in the damage key; rows that repeat conversation and turn are each damaged alike. Order: turn (null first), then role and
text (a repeat stands beside its original). A null conv_id is a conversation of its own. A role counts by its first character; an empty one counts as unlike any. An empty table
gives no rows; a conversation whose rows are all dropped has zeros, an empty audit and the digest of the empty string. Very long texts are rows like others. Other columns are ignored.
Gaps beyond 2**63 - 1 count as that.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, shuffle_width, small_batches, tidy, written

#: Fixed values of the contract: costs of edits, and what a truncated turn costs that stays.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"s": 0, "u": 1, "a": 2}
#: Faults in the order in which the first counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_TURN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_NAME = {"u": "user", "a": "assistant"}
_MACROS = sorted("I" * k + x for k in range(3) for x in "DKR")
_CODE = {m: k for k, m in enumerate(_MACROS)}
INF = float("inf")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, sort_) of conversations as the contract damages them; dropped rows are gone."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    made = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"),
    ).where("kind <> 0")
    return made.withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "again")


def _text_fault(text: str) -> int:
    solid = text.rstrip(SPACE)
    return BLANK if not solid else SOUND if solid[-1] in ".!?" else CUT


def _macros(state: int, role: int, fault: int):
    """Macro edits of a turn from a state: (state after, cost, code)."""
    for k in range(3):
        at = state
        for _ in range(k):
            at = _NEXT[at, _TURN[at]]
        stay = TRUNCATED if fault == CUT else 0
        yield at, INSERT * k + DELETE, _CODE["I" * k + "D"]
        if fault in (BLANK, DUPLICATE):
            continue
        if (to := _NEXT.get((at, "sua?"[role]))) is not None:
            yield to, INSERT * k + stay, _CODE["I" * k + "K"]
        yield _NEXT[at, _TURN[at]], INSERT * k + REROLE + stay, _CODE["I" * k + "R"]


_MOVES = {(s, r, f): tuple(_macros(s, r, f)) for s in range(4) for r in range(4) for f in range(4)}
_STEPS: dict = {}


def _step(layer: tuple, role: int, fault: int):
    """(next layer, what its least cost is above this one's, for each state the parent and the macro's code). A layer has (cost, rank) for each state."""
    found = _STEPS.get((layer, role, fault))
    if found is None:
        best: dict[int, tuple] = {}
        for state, (cost, rank) in enumerate(layer):
            if cost < INF:
                for to, more, code in _MOVES[state, role, fault]:
                    new = (cost + more, rank, code, state)
                    if to not in best or new < best[to]:
                        best[to] = new
        least = min(b[0] for b in best.values())
        order = {x: k for k, x in enumerate(sorted((b[1], b[2]) for b in best.values()))}
        made = tuple((best[s][0] - least, order[best[s][1:3]]) if s in best else (INF, 0) for s in range(4))
        back = tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))
        if len(_STEPS) > 200_000:
            _STEPS.clear()
        found = _STEPS[layer, role, fault] = made, least, back
    return found


def layers(kinds, entry: int = START):
    """Last layer, its base cost and the back pointers of all turns (role, fault) from an entry state."""
    layer, base, backs = tuple((0, 0) if s == entry else (INF, 0) for s in range(4)), 0, []
    for role, fault in kinds:
        layer, more, back = _step(layer, role, fault)
        base += more
        backs.append(back)
    return layer, base, backs


#: Insertions after the last turn that lead to acceptance, with the state after them.
_CLOSE = {START: ((0, START),), SYSTEM: ((2, ASSISTANT),), USER: ((1, ASSISTANT),), ASSISTANT: ((0, ASSISTANT),)}


def close(layer) -> tuple[int, int, int]:
    """(cost above the layer's least, state, insertions at the end) of the cheapest end with the least audit."""
    cost, _, state, k = min((cost + INSERT * k, rank, s, k) for s, (cost, rank) in enumerate(layer) if cost < INF for k, _ in _CLOSE[s])
    return cost, state, k


def trace(backs, state: int) -> list[str]:
    """The macro edits of all turns that lead to a state."""
    out = []
    for back in reversed(backs):
        state, code = back[state]
        out.append(_MACROS[code])
    return out[::-1]


def applied(rows, macros, entry: int, last: int):
    """Repaired (role, text, edit) of turns (role, text) under macro edits, from an entry state, with insertions at the end."""
    at = entry
    for (role, text), macro in zip(rows, macros):
        for x in macro:
            if x in "IR":
                turn = _TURN[at]
                at = _NEXT[at, turn]
                yield _NAME[turn], "" if x == "I" else text, x
            elif x == "K":
                at = _NEXT[at, role[:1]]
                yield role, text, x
    for _ in range(last):
        turn = _TURN[at]
        at = _NEXT[at, turn]
        yield _NAME[turn], "", "I"


def _gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else min(most - least + 1 - distinct, 2**63 - 1)


def repair(rows: list[tuple]) -> dict:
    """Faults, cheapest edits and repaired turns of one conversation's rows (turn, role, text) in order."""
    seen, kinds, count, illegal, before = set(), [], [0] * 4, 0, None
    for _, role, text in rows:
        fault = _text_fault(text)
        if fault != BLANK:
            mark = role, hashlib.sha256(text.encode()).digest()
            fault = DUPLICATE if mark in seen else fault
            seen.add(mark)
        count[fault] += 1
        kinds.append((ROLES.get(role[:1], 3), fault))
        illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
    layer, base, backs = layers(kinds)
    cost, state, last = close(layer)
    macros = trace(backs, state)
    turns = sorted({t for t, _, _ in rows if t is not None})
    return {
        "gaps": _gaps(turns[0], turns[-1], len(turns)) if turns else 0, "blank": count[BLANK], "duplicate": count[DUPLICATE], "truncated": count[CUT], "illegal": illegal, "cost": base + cost,
        "audit": "".join(macros) + "I" * last, "turns": [*applied([(r, t) for _, r, t in rows], macros, START, last)],
    }


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FIELDS = [c.split()[0] for c in COUNTS.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _stream(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows, schema: str, most: int = 2_000, most_bytes: int = 4 << 20):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _digest(turns) -> str:
    out = hashlib.sha256()
    for k, (role, text, *_) in enumerate(turns):
        out.update(f"{chr(10) if k else ''}{role}:{text}".encode())
    return out.hexdigest()


REPORT = f"conv_id long, {COUNTS}, repaired_sha256 string"
TURNS = "conv_id long, part long, position long, role string, text string, edit string"


def _small(batches, one):
    """Folds conversations as they come; rows are sorted, so one conversation is held at a time."""
    for conv, rows in groupby(_stream(batches), key=lambda r: r[0]):
        yield from one(conv, repair([r[1:] for r in rows]))


def _ordered(rows: DataFrame, *by: str) -> DataFrame:
    return rows.sortWithinPartitions(*by, F.asc_nulls_first("turn"), "role", "text")


class Repair:
    """Conversations repaired: `report()` has a row for each with its digest, `turns()` the repaired turns themselves."""

    def __init__(self, rows: DataFrame, crowd: int = 100_000, part_bytes: int = 32 << 20):
        """rows: conv_id, turn, role, text, in any order. Conversations with more than `crowd` rows are worked on in parts."""
        spark = rows.sparkSession
        small_batches(spark)
        self.rows, self.part_bytes = rows.select("conv_id", "turn", "role", "text"), part_bytes
        sizes = self.rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 16).alias("size"))
        total = sizes.agg(F.sum("n"), F.sum("size")).first()
        self.bytes = total[1] or 0
        # at most HOT_KEYS conversations can be so large: what is broadcast is bounded
        crowd = max(crowd, (total[0] or 0) // HOT_KEYS)
        large = sizes.where((F.col("n") > crowd) | (F.col("size") > max(part_bytes, self.bytes // HOT_KEYS)))
        self.large = written(large.select(F.coalesce("conv_id", F.lit(0)).alias("large_id"), F.col("conv_id").isNull().alias("large_null")))
        self.any_large = self.large.limit(1).count() > 0
        on = (F.coalesce("conv_id", F.lit(0)) == F.col("large_id")) & (F.col("conv_id").isNull() == F.col("large_null"))
        self._on, self._parts = on, None

    def _dealt(self) -> DataFrame:
        rows = self.rows.join(F.broadcast(self.large), self._on, "left_anti") if self.any_large else self.rows
        width = max(shuffle_width(self.rows.sparkSession), -(-self.bytes // self.part_bytes))
        return _ordered(rows.repartition(width, "conv_id"), "conv_id")

    def report(self) -> DataFrame:
        """REPORT rows of the conversations that have any row."""

        def run(batches):
            one = lambda conv, r: [(conv, *(r[f] for f in _FIELDS), _digest(r["turns"]))]
            yield from _batched(_small(batches, one), REPORT)

        small = self._dealt().mapInArrow(tidy(run), REPORT)
        return small.unionByName(self._large_report()) if self.any_large else small

    def turns(self) -> DataFrame:
        """TURNS rows: the repaired turns by conversation, part and position, with the edit that made each (deleted ones are gone)."""

        def run(batches):
            one = lambda conv, r: ((conv, 0, k, *t) for k, t in enumerate(r["turns"]))
            yield from _batched(_small(batches, one), TURNS)

        small = self._dealt().mapInArrow(tidy(run), TURNS)
        return small.unionByName(self._large_turns().drop("audit")) if self.any_large else small

    # conversations that are worked on in parts

    def _sorted(self) -> DataFrame:
        """Rows of large conversations in the order of all, with range, place in the range and role and fault, but for duplicates; a written table."""
        rows = self.rows.join(F.broadcast(self.large), self._on, "left_semi").withColumn("salt", F.monotonically_increasing_id())
        size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        width = max(shuffle_width(self.rows.sparkSession), -(-size // self.part_bytes))
        order = (F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "salt")
        schema = "conv_id long, part long, place long, turn long, role string, text string, kind long, mark string"

        def run(batches):
            part, place = TaskContext.get().partitionId(), 0

            def placed():
                nonlocal place
                for conv, turn, role, text in _stream(batches):
                    fault = _text_fault(text)
                    mark = None if fault == BLANK else hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
                    yield conv, part, place, turn, role, text, ROLES.get(role[:1], 3) * 4 + fault, mark
                    place += 1

            yield from _batched(placed(), schema)

        dealt = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).drop("salt")
        return written(dealt.mapInArrow(tidy(run), schema))

    def _large(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Placed rows with their faults, the path of each part (entry and exit state, insertions at the end), and costs by conversation."""
        if self._parts is not None:
            return self._parts
        rows = self._sorted()
        first = rows.where("mark is not null").groupBy("conv_id", "mark").agg(F.min(F.struct("part", "place")).alias("f")).select("f.part", "f.place", F.lit(True).alias("first"))
        fault = F.when(F.col("mark").isNotNull() & F.col("first").isNull(), F.col("kind") - F.col("kind") % 4 + DUPLICATE).otherwise(F.col("kind"))
        rows = written(rows.join(first, ["part", "place"], "left").withColumn("kind", fault).drop("first", "mark"))
        kinds = rows.select("conv_id", "part", "place", "kind", F.substring("role", 1, 1).alias("initial")).repartition(shuffle_width(rows.sparkSession), "conv_id", "part").sortWithinPartitions("conv_id", "part", "place")
        schema = "conv_id long, part long, moves string, illegal long, first_initial string, last_initial string"

        def summed(batches):
            def out():
                for (conv, part), own in groupby(_stream(batches), key=lambda r: r[:2]):
                    moves, illegal, ends, before = [tuple((0, 0) if s == e else (INF, 0) for s in range(4)) for e in range(4)], 0, None, None
                    base = [0] * 4
                    for *_, kind, initial in own:
                        for e in range(4):
                            moves[e], more, _ = _step(moves[e], kind // 4, kind % 4)
                            base[e] += more
                        illegal += before is not None and before + initial not in ("su", "ua", "au")
                        ends, before = ends if ends is not None else initial, initial
                    said = ";".join(",".join("-" if c == INF else f"{base[e] + int(c)}:{r}" for c, r in moves[e]) for e in range(4))
                    yield conv, part, said, int(illegal), ends, before

            yield from _batched(out(), schema)

        parts = written(kinds.mapInArrow(tidy(summed), schema))

        def composed(key, table):
            """Least costs and ranks over the parts of a conversation in order: a few numbers a part."""
            table = table.sort_values("part")
            layer, base, backs, illegal, before = [(0, 0), (INF, 0), (INF, 0), (INF, 0)], 0, [], int(table["illegal"].sum()), None
            for moves, head, tail in zip(table["moves"], table["first_initial"], table["last_initial"]):
                illegal += before is not None and before + head not in ("su", "ua", "au")
                before, best = tail, {}
                for e, row in enumerate(moves.split(";")):
                    for x, cell in enumerate(row.split(",")):
                        if cell != "-" and layer[e][0] < INF:
                            c, r = map(int, cell.split(":"))
                            new = (layer[e][0] + c, layer[e][1], r, e)
                            best[x] = min(best.get(x, new), new)
                order = {v: k for k, v in enumerate(sorted(b[1:] for b in best.values()))}
                layer = [(best[s][0], order[best[s][1:]]) if s in best else (INF, 0) for s in range(4)]
                backs.append({s: b[3] for s, b in best.items()})
            cost, state, last = close(layer)
            ends, path = [0] * len(backs), []
            ends[-1] = last
            for back in reversed(backs):
                path.append((back[state], state))
                state = back[state]
            path = path[::-1]
            return pd.DataFrame({"conv_id": table["conv_id"], "part": table["part"], "enter": [p[0] for p in path], "leave": [p[1] for p in path], "last": ends, "cost": cost, "illegal": illegal})

        of = "conv_id long, part long, enter long, leave long, last long, cost long, illegal long"
        paths = written(parts.groupBy("conv_id").applyInPandas(composed, of))
        counted = lambda fault: F.count_if(F.col("kind") % 4 == fault)
        faults = rows.groupBy("conv_id").agg(counted(BLANK).alias("blank"), counted(DUPLICATE).alias("duplicate"), counted(CUT).alias("truncated"))
        self._parts = rows, paths, written(faults)
        return self._parts

    def _large_turns(self) -> DataFrame:
        rows, paths, _ = self._large()
        met = rows.join(paths.select("part", F.col("conv_id").alias("of"), "enter", "leave", "last"), (F.col("conv_id").eqNullSafe(F.col("of"))) & (rows["part"] == paths["part"]))
        dealt = met.select("conv_id", rows["part"], "place", "role", "text", "kind", "enter", "leave", "last").repartition(shuffle_width(rows.sparkSession), "conv_id", "part").sortWithinPartitions("conv_id", "part", "place")
        schema = f"{TURNS}, audit string"

        def run(batches):
            def out():
                for (conv, part), own in groupby(_stream(batches), key=lambda r: r[:2]):
                    own = [*own]
                    enter, leave, last = own[0][6:]
                    _, _, backs = layers(((k // 4, k % 4) for *_, k, _, _, _ in own), enter)
                    macros = trace(backs, leave)
                    yield conv, part, -1, None, None, None, "".join(macros) + "I" * last
                    for k, turn in enumerate(applied([r[3:5] for r in own], macros, enter, last)):
                        yield conv, part, k, *turn, None

            yield from _batched(out(), schema)

        return dealt.mapInArrow(tidy(run), schema)

    def _large_report(self) -> DataFrame:
        rows, paths, faults = self._large()
        turns = written(self._large_turns())
        turn_counts = rows.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.least(wide("high") - wide("low") + 1 - F.col("turns"), F.lit(2**63 - 1).cast("decimal(22,0)"))).cast("long")
        audit = turns.where("position = -1").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        stream = turns.where("position >= 0").select("conv_id", "part", "position", "role", "text").repartition(shuffle_width(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "position")

        def run(batches):
            for conv, own in groupby(_stream(batches), key=lambda r: r[0]):
                yield _batch([(conv, _digest((r[3], r[4]) for r in own))], "conv_id long, repaired_sha256 string")

        digests = stream.mapInArrow(tidy(run), "conv_id long, repaired_sha256 string")
        out = faults.withColumnRenamed("conv_id", "id")
        costs = paths.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
        for other in (turn_counts, audit, digests, costs):
            out = out.join(other, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
        empty = F.sha2(F.lit("").cast("binary"), 256)
        return out.select(F.col("id").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def repaired(conversations: DataFrame, crowd: int = 100_000, part_bytes: int = 32 << 20) -> DataFrame:
    """REPORT of the conversations as the contract damages them, a row for every original conv_id."""
    found = Repair(damaged(conversations), crowd, part_bytes).report()
    # an id of the input that has no row left gives a row with zeros
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", *(F.lit(0).cast("long").alias(f) for f in _FIELDS[:-1]), F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    best = F.max_by(F.struct(*_FIELDS, "repaired_sha256"), F.col("repaired_sha256").isNotNull())
    empty = hashlib.sha256(b"").hexdigest()
    return found.unionByName(ids).groupBy("conv_id").agg(best.alias("r")).select("conv_id", *(f"r.{f}" for f in _FIELDS), F.coalesce("r.repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
