"""Least-cost repair of conversations by a parallel Viterbi pass with rank convergence.

A conversation is right if the initials of its roles match ``(s?(ua)+)?``; a machine with four states reads them. Every
row is kept, given the role that fits (user or assistant), or deleted, and turns without text may be inserted. The backward
cost of a place is a vector with one entry per state, the least cost to finish from there, and each row is one
min-plus step of it.

Rows in the order of their conversations are cut into chunks of CHUNK_ROWS. A chunk whose conversation goes on in the
next one starts from a speculative vector. In fix-up passes a chunk gets the vector that its neighbour has
found; it runs old and new vectors side by side and stops where they differ by a constant only, for then all that
lies before is the same. Passes go on until no chunk gets another vector. With the stitched vectors known, the cheapest edits
are traced forward, letter by letter in ASCII order among those that keep the least cost; a chunk in the middle of a
conversation starts from a guessed state, and the same kind of passes put it right.

A conversation is therefore never gathered: chunks are bounded, and passes touch only chunks whose border changed. Vectors of some
conversations never converge (say, of roles that fit nowhere, or of deleted rows only). There are 16 vectors in all, so after
PASSES passes the chunks left give their whole map from vector to vector, and maps of neighbours are joined over twice the distance in each
round, until every border is known: rounds grow with the logarithm of a conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.scale.ordering import row_index
from tabulon.scale.storage import materialize

CHUNK_ROWS = 4096
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAULTS = (None, "truncated", "duplicate", "blank")
ROLES = {2: "user", 3: "assistant"}  # the role that a state is reached by, other than s
_INITIALS = "sua"  # classes 0 to 2; 3: any other role, 4: a role without letters
_CLASSES = 5
_FAR = 1 << 20
SPECULATIVE = (0, 0, 0, 0)
GUESS = 3
PASSES = 3  # fix-up passes before the maps of what is left are joined
_EDITS = "at long, fault string, illegal boolean, before array<string>, edit string, role_now string, after array<string>"


def fitting(state: int) -> int:
    """The state after the one turn, user or assistant, that may follow ``state``."""
    return 3 if state == 2 else 2


def kept_state(kind: int, state: int) -> int | None:
    """The state after a kept row whose role is of class ``kind``, None if it may not stand there."""
    if kind == 4:
        return state  # no initial, nothing to read
    return {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(kind)


def _with_inserts(vector: Sequence[int]) -> list[int]:
    for _ in range(2):  # more than two inserted turns in one place never pay
        vector = [min(v, INSERT + vector[fitting(s)]) for s, v in enumerate(vector)]
    return list(vector)


END = tuple(_with_inserts([0, _FAR, _FAR, 0]))


class Costs:
    """Min-plus steps and traced edits, remembered: both vectors and kinds of rows are few."""

    def __init__(self):
        self._back: dict = {}
        self._edit: dict = {}

    def back(self, after: tuple[int, ...], code: int) -> tuple[int, ...]:
        """Vector before a row from the one behind it, less its minimum."""
        key = (after, code)
        if key not in self._back:
            vector = self._before(after, code)
            self._back[key] = tuple(v - min(vector) for v in vector)
        return self._back[key]

    @staticmethod
    def _options(after, code, state):
        kind, fault = code % _CLASSES, code // _CLASSES
        yield "D", DELETE + after[state], state
        if fault < 2:
            late = TRUNCATED * fault
            to = kept_state(kind, state)
            if to is not None:
                yield "K", late + after[to], to
            yield "R", late + REROLE + after[fitting(state)], fitting(state)

    def _before(self, after, code):
        return _with_inserts([min(cost for _, cost, _ in self._options(after, code, s)) for s in range(4)])

    def edit(self, after: tuple[int, ...], code: int, state: int) -> tuple[tuple[str, ...], str, int]:
        """Inserted roles, the row's edit and the next state: ASCII-least of the cheapest."""
        key = (after, code, state)
        if key not in self._edit:
            vector, inserted, now = self._before(after, code), [], state
            while True:
                options = {name: (cost, to) for name, cost, to in self._options(after, code, now) if cost == vector[now]}
                if "D" not in options and INSERT + vector[fitting(now)] == vector[now]:
                    now = fitting(now)
                    inserted.append(ROLES[now])
                    continue
                name = min(options)
                self._edit[key] = (tuple(inserted), name, options[name][1])
                break
        return self._edit[key]

    @staticmethod
    def closing(state: int) -> list[str]:
        """Roles to insert at the end of a conversation."""
        added = []
        while END[state]:
            state = fitting(state)
            added.append(ROLES[state])
        return added


def all_vectors() -> list[tuple[int, ...]]:
    """Every vector that a pass can meet, from the speculative and the last one on."""
    costs, found = Costs(), [SPECULATIVE, END]
    for vector in found:  # grows while it is read
        found += {costs.back(vector, code) for code in range(_CLASSES * len(FAULTS))} - set(found)
    return found


def faults_of(text: Column, first: Column) -> Column:
    """Index into FAULTS; ``first`` is false for a row whose role and text were seen earlier in the conversation."""
    return (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), 3).when(~first, 2)
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 1).otherwise(0)
    )


def _chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """One row per chunk of ``rows(at, conv_id, role, text, mark)``: conversations and codes in order, and its borders."""
    wordy = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    firsts = wordy.groupBy("conv_id", "role", "mark").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    kind = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))
    kind = F.when(F.col("role") == "", 4).when(kind == 0, 3).otherwise(kind - 1)
    faults = rows.select("at", "conv_id", kind.alias("kind"), faults_of(F.col("text"), F.lit(True)).alias("fault"))
    # Places are unique, so this join has no hot key however often a row is repeated.
    marked = faults.join(firsts, "at", "left")
    fault = F.when((F.col("fault") < 3) & F.col("first").isNull(), 2).otherwise(F.col("fault"))
    coded = marked.select("at", "conv_id", (F.col("kind") + _CLASSES * fault).cast("int").alias("code"))
    chunk = F.floor(F.col("at") / chunk_rows).alias("chunk")
    lists = coded.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct("at", "conv_id", "code"))).alias("rows"))
    lists = materialize(lists.select("chunk", F.col("rows.conv_id").alias("convs"), F.col("rows.code").alias("codes")), "chunks")
    border = lists.select(
        "chunk", F.col("convs")[0].alias("head"), F.element_at("convs", -1).alias("tail"), F.element_at("codes", -1).alias("code")
    )
    before = border.select((F.col("chunk") + 1).alias("chunk"), F.struct("tail", "code").alias("prev"))
    behind = border.select((F.col("chunk") - 1).alias("chunk"), F.struct("head").alias("next"))
    joined = lists.join(before, "chunk", "left").join(behind, "chunk", "left")
    same = lambda own, other, at: other.isNotNull() & own.eqNullSafe(other[at])
    return materialize(
        joined.select(
            "chunk", (F.col("chunk") * chunk_rows).alias("base"), "convs", "codes", same(F.col("convs")[0], F.col("prev"), "tail").alias("continued"),
            same(F.element_at("convs", -1), F.col("next"), "head").alias("continues"), F.col("prev.code").alias("prev_code"),
        ),
        "bordered",
    )


def _segment(convs: list, at: int) -> tuple[int, int]:
    """Bounds of the rows of the conversation that row ``at`` (the first or the last) belongs to."""
    low = high = at % len(convs)
    while low > 0 and convs[low - 1] == convs[low]:
        low -= 1
    while high + 1 < len(convs) and convs[high + 1] == convs[high]:
        high += 1
    return low, high + 1


def back_border(costs: Costs, row: dict) -> tuple:
    """Vector at the head of a chunk, from ``into`` behind it; ``was`` and ``out`` are those of the pass before."""
    low, high = _segment(row["convs"], 0)
    whole = high == len(row["convs"]) and row["continues"]
    now, old = tuple(row["into"]) if whole else END, row.get("was")
    if old is not None and not whole:
        return tuple(row["out"])
    for code in reversed(row["codes"][low:high]):
        now = costs.back(now, code)
        if old is not None:
            old = costs.back(tuple(old), code)
            if now == old:  # they differ by a constant only, and so do all before
                return tuple(row["out"])
    return now


def _vectors(costs: Costs, codes: list[int], behind: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The vector behind every row."""
    found = [behind]
    for code in reversed(codes[1:]):
        found.append(costs.back(found[-1], code))
    return found[::-1]


def fore_border(costs: Costs, row: dict) -> tuple:
    """State at the end of a chunk, from the state ``into`` before it."""
    low, high = _segment(row["convs"], -1)
    whole = low == 0 and row["continued"]
    now, old = row["into"][0] if whole else 0, row.get("was")
    if old is not None and not whole:
        return tuple(row["out"])
    old = None if old is None else old[0]
    codes = row["codes"][low:high]
    for code, behind in zip(codes, _vectors(costs, codes, tuple(row["behind"]))):
        now = costs.edit(behind, code, now)[2]
        if old is not None:
            old = costs.edit(behind, code, old)[2]
            if now == old:
                return tuple(row["out"])
    return (now,)


def _mapped(df: DataFrame, border: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["chunk"] for r in rows], pa.int64()),
                    pa.array([r["into"] for r in rows], pa.list_(pa.int32())),
                    pa.array([border(costs, r) for r in rows], pa.list_(pa.int32())),
                ],
                ["chunk", "into", "out"],
            )

    return df.mapInArrow(run, "chunk long, into array<int>, out array<int>")


def _settle(spanning: DataFrame, border: Callable, domain: list[tuple], guess: tuple, fixed: tuple, open_end: str, step: int) -> DataFrame:
    """``(chunk, into)`` once every chunk has what its neighbour ``chunk + step`` gives out at the common border."""
    literal = lambda values: F.array(*map(F.lit, values))
    into = F.when(F.col(open_end), literal(guess)).otherwise(literal(fixed))
    state = materialize(_mapped(spanning.withColumn("into", into), border), "pass")
    open_chunks = spanning.where(open_end).select("chunk")
    for _ in range(PASSES):
        given = state.select((F.col("chunk") - step).alias("chunk"), F.col("out").alias("given"))
        changed = state.join(open_chunks, "chunk").join(given, "chunk").where("into != given")
        changed = materialize(changed.select("chunk", F.col("given").alias("into"), F.col("into").alias("was"), "out"), "changed")
        if changed.isEmpty():
            return state.select("chunk", "into")
        again = _mapped(spanning.join(changed, "chunk"), border).select(
            "chunk", F.col("into").alias("new_into"), F.col("out").alias("new_out")
        )
        merged = state.join(again, "chunk", "left").select(
            "chunk", F.coalesce("new_into", "into").alias("into"), F.coalesce("new_out", "out").alias("out")
        )
        state = materialize(merged, "pass")
    outs = _leap(spanning, border, domain, step).select((F.col("chunk") - step).alias("chunk"), "out")
    known = F.get(F.array(*map(literal, domain)), F.col("out"))
    return spanning.select("chunk", open_end).join(outs, "chunk", "left").select(
        "chunk", F.when(F.col(open_end), known).otherwise(literal(fixed)).alias("into")
    )


def _leap(spanning: DataFrame, border: Callable, domain: list[tuple], step: int) -> DataFrame:
    """``(chunk, out)``, places in ``domain``: what every chunk gives out, from maps joined over growing distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, place = Costs(), {v: i for i, v in enumerate(domain)}
        for batch in batches:
            rows = batch.to_pylist()
            maps = [[place[tuple(border(costs, r | {"into": v}))] for v in domain] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array(maps, pa.list_(pa.int32()))], ["chunk", "map"])

    maps = spanning.mapInArrow(run, "chunk long, map array<int>").withColumn("to", F.col("chunk") + step)
    maps = materialize(maps, "maps")
    varies = F.array_min("map") < F.array_max("map")  # else what comes in makes no difference any more
    while not maps.where(varies).isEmpty():
        further = maps.select(F.col("chunk").alias("to"), F.col("map").alias("then"), F.col("to").alias("beyond"))
        joined = maps.join(further, "to", "left")
        both = F.transform("then", lambda v: F.get("map", v))
        maps = materialize(
            joined.select("chunk", F.when(varies, both).otherwise(F.col("map")).alias("map"), F.when(varies, F.col("beyond")).otherwise(F.col("to")).alias("to")),
            "maps",
        )
    return maps.select("chunk", F.get("map", F.lit(0)).alias("out"))


def trace_chunk(costs: Costs, row: dict) -> Iterator[tuple]:
    """Edits of every row of a chunk, given the vector behind it and the state before it."""
    convs, codes, n = row["convs"], row["codes"], len(row["convs"])
    low = 0
    while low < n:
        high = low + 1
        while high < n and convs[high] == convs[low]:
            high += 1
        open_end = high == n and row["continues"]
        state = row["before"] if low == 0 and row["continued"] else 0
        last = row["prev_code"] if low == 0 and row["continued"] else None
        vectors = _vectors(costs, codes[low:high], tuple(row["behind"]) if open_end else END)
        for at, behind in zip(range(low, high), vectors):
            code = codes[at]
            inserted, edit, state = costs.edit(behind, code, state)
            pair = None if last is None else (last % _CLASSES, code % _CLASSES)
            last = code
            yield (
                row["base"] + at, FAULTS[code // _CLASSES], pair not in (None, (0, 1), (1, 2), (2, 1)), list(inserted), edit,
                ROLES[state] if edit == "R" else None, costs.closing(state) if at == high - 1 and not open_end else [],
            )
        low = high


def repair(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Edits of every row of ``turns(conv_id, turn, role, text)`` in the order of turns.

    Returns ``conv_id, at`` (global place), ``turn, role, text, fault`` (blank, duplicate, truncated or null),
    ``illegal`` (the role may not follow the row before), ``before`` (roles inserted before the row), ``edit`` (K, R or D),
    ``role_now`` (of R) and ``after`` (roles inserted at the end of the conversation).

    Null roles and texts count as one space; null turns come first, ties go by role and text, repeated rows are
    duplicates. A role without letters has no initial and may stand anywhere. Rows without conv_id are one conversation.
    Other columns are not read. An empty table gives an empty result.
    """
    space = F.lit(" ")
    text = F.coalesce("text", space)
    plain = turns.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("mark")
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = row_index(plain, order, "at")
    chunks = _chunks(rows, chunk_rows)
    spanning = materialize(chunks.where("continued or continues"), "spanning")
    behind = _settle(spanning, back_border, all_vectors(), SPECULATIVE, END, "continues", 1)
    behind = materialize(spanning.join(behind.withColumnRenamed("into", "behind"), "chunk"), "behind")
    before = _settle(behind, fore_border, [(s,) for s in range(4)], (GUESS,), (0,), "continued", -1)
    known = before.join(behind.select("chunk", "behind"), "chunk").select("chunk", "behind", F.col("into")[0].alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        schema = pa.schema([
            ("at", pa.int64()), ("fault", pa.string()), ("illegal", pa.bool_()), ("before", pa.list_(pa.string())),
            ("edit", pa.string()), ("role_now", pa.string()), ("after", pa.list_(pa.string())),
        ])
        for batch in batches:
            for at in range(batch.num_rows):
                found = list(trace_chunk(costs, batch.slice(at, 1).to_pylist()[0]))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    edits = materialize(chunks.join(known, "chunk", "left").mapInArrow(run, _EDITS), "edits")
    return rows.drop("mark").join(edits, "at")


def repaired(edits: DataFrame) -> DataFrame:
    """Rows of the repaired conversations: ``conv_id, at, nth, role, text``, in the order of ``at, nth``."""
    added = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.coalesce("role_now", "role").alias("role"), F.col("text").alias("text")))
    own = F.when(F.col("edit") != "D", own).otherwise(F.filter(own, lambda _: F.lit(False)))
    return edits.select("conv_id", "at", F.posexplode(F.concat(added("before"), own, added("after"))).alias("nth", "row")).select(
        "conv_id", "at", "nth", "row.role", "row.text"
    )


def audit_letters() -> Column:
    return F.concat(F.repeat(F.lit("I"), F.size("before")), F.col("edit"), F.repeat(F.lit("I"), F.size("after")))


def edit_cost() -> Column:
    kept = F.when((F.col("edit") != "D") & (F.col("fault") == "truncated"), TRUNCATED).otherwise(0)
    own = F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "R", REROLE).otherwise(0)
    return kept + own + INSERT * (F.size("before") + F.size("after"))


def digests(edits: DataFrame) -> DataFrame:
    """``(conv_id, audit, sha256)``: audit letters and the hash of the repaired ``role:text`` lines, streamed row by row.

    A hash over a whole conversation is made in one task, for it depends on all before; no more than a batch of rows is held.
    """
    empty = lambda c: F.transform(c, lambda r: F.concat(r, F.lit(":")))
    own = F.when(F.col("edit") != "D", F.array(F.concat(F.coalesce("role_now", "role"), F.lit(":"), "text")))
    lines = F.concat(empty("before"), F.coalesce(own, F.array().cast("array<string>")), empty("after"))
    pieces = edits.select("conv_id", "at", audit_letters().alias("audit"), lines.alias("lines"))
    kind = edits.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, started = None, None, None, False
        names = ["conv_id", "audit", "sha256"]
        for batch in batches:
            done = []
            for c, letters, lines in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "lines"))):
                if audit is None or c != conv:
                    if audit is not None:
                        done.append((conv, "".join(audit), sha.hexdigest()))
                    conv, audit, sha, started = c, [], hashlib.sha256(), False
                audit.append(letters)
                for line in lines:
                    sha.update(("\n" if started else "").encode() + line.encode())
                    started = True
            if done:
                yield _batch(done, names, batch.schema.field("conv_id").type)
            id_type = batch.schema.field("conv_id").type
        if audit is not None:
            yield _batch([(conv, "".join(audit), sha.hexdigest())], names, id_type)

    streamed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return streamed.mapInArrow(run, f"conv_id {kind}, audit string, sha256 string")


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], id_type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage by ``crc32("conv_id:turn") % 20``, nulls written as one space.

    0 drops the row, 1 empties its text, 2 takes out its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    marked = turns.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(named.cast("binary")) % 20).alias("fate"),
    ).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")
