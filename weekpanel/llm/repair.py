"""Conversation structure repair: the cheapest edits that make roles alternate.

Every row of a conversation (ordered by turn, NULLs first; ties by role, then by
the digest of the text) gets one fault at most: ``blank`` (nothing but white
space), else ``duplicate`` (role and text seen earlier), else ``truncated`` (the
last character that is not white space is none of ``. ! ?``).  Edits: keep (K, 0),
rerole to user or assistant (R, 1), delete (D, 2; required for blank and duplicate
rows), insert an empty user or assistant text (I, 5); a truncated row that stays
adds 5.  The result's role initials must read ``(s?(ua)+)?``.  Of the cheapest edit
lists the ASCII-least string of initials, the audit, is taken.

Method.  The roles read so far are one of four states, so edit lists are paths
through nodes (row, state).  A cost DP from the end gives the cost of every node
and with it the arcs that lie on a cheapest path.  Arcs that leave one node differ
in their letter, so a node's least audit starts with its least optimal arc, and one
pointer a node is enough.  Prefix doubling: nodes are ranked by 1, 2, 4, ... letters
of their least audit, each round from the ranks of the node and of the node its
pointer reaches, while pointers double; the path is read off the doubled pointers.
A conversation is cut into segments of ``SEGMENT`` rows.  Segments are min-plus
matrices of four by four, composed from the end to get the costs at each border, so
all segments take the steps of the DP side by side.

What Spark does.  Faults, digests and sums are native.  Rows alike in turn, role and
text are counted before they are shuffled; a duplicate is found by a join with the
first turns of texts that occur more than once.  A conversation's rows stream
through one task in order, since its audit is one cell and its digest one sequence:
that task holds a byte a row, never the texts.

NULL conversation ids form one conversation; NULL role or text reads as one space.
An empty table gives empty results.  Columns other than conv_id, turn, role and text
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.text import lean
from weekpanel.session import materialize

WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
NEXT = np.array([AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER])  # by the role that a state asks for
INITIALS, FAULTS = "sua", ("blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
END = 16  # code of the mark after the last row
LETTERS = np.frombuffer(b"\0\0DIKR", np.uint8)  # by rank: 0 none, 1 the end mark
SEGMENT, CHUNK = 128, 2048
FAR = 1 << 40


def _row_costs(code: np.ndarray):
    """Of rows with these codes: cost of deleting, of keeping the text, and whether its role is (u or a) or s."""
    initial, fault = code % 4, code // 4
    end = code == END
    stay = np.where(end | (fault == BLANK) | (fault == DUPLICATE), FAR, np.where(fault == TRUNCATED, CUT_OFF, 0))
    delete = np.where(end, FAR, DELETE)
    fits = np.stack([initial == 1, initial == 1, initial == 2, initial == 1], -1)  # the role each state asks for
    return delete, stay, fits, (initial == 0) & ~end, end


def _arcs(code: np.ndarray, after: np.ndarray):
    """Costs over each arc that reads a row: end mark, delete, keep, rerole; ``after[..., state]`` is the cost behind it."""
    delete, stay, fits, system, end = _row_costs(code)
    onward = after[..., NEXT]
    mark = np.full(after.shape, FAR)
    mark[..., [START, AFTER_ASSISTANT]] = np.where(end, 0, FAR)[..., None] + after[..., START, None]
    keep = np.where(fits, stay[..., None] + onward, FAR)
    keep[..., START] = np.where(system, stay + after[..., AFTER_SYSTEM], keep[..., START])
    return mark, delete[..., None] + after, keep, stay[..., None] + REROLE + onward


def _insertions(cost: np.ndarray) -> np.ndarray:
    """The least costs when texts may be inserted before the row."""
    out = cost.copy()
    out[..., AFTER_USER] = np.minimum(cost[..., AFTER_USER], INSERT + cost[..., AFTER_ASSISTANT])
    out[..., AFTER_ASSISTANT] = np.minimum(cost[..., AFTER_ASSISTANT], INSERT + cost[..., AFTER_USER])
    for state in (START, AFTER_SYSTEM):
        out[..., state] = np.minimum(cost[..., state], INSERT + out[..., AFTER_USER])
    return np.minimum(out, FAR)


def _costs(code: np.ndarray, size: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Costs of all nodes, ``[row, ..., state]``, from those after the last row.  Segments are aligned at their ends."""
    steps = code.shape[1]
    out = np.empty((steps + 1, *last.shape), np.int64)
    out[steps] = last
    for t in range(steps - 1, -1, -1):
        here = code[:, t].reshape(-1, *[1] * (last.ndim - 2))
        row = np.minimum.reduce(_arcs(np.broadcast_to(here, last.shape[:-1]), out[t + 1]))
        live = (t >= steps - size).reshape(-1, *[1] * (last.ndim - 1))
        out[t] = np.where(live, _insertions(row), out[t + 1])
    return out


def _matrices(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``[segment, state before, state behind]``: least costs through each segment."""
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    through = _costs(code, size, np.broadcast_to(unit[None], (len(code), 4, 4)))[0]
    return through.transpose(0, 2, 1)


def least_arcs(code: np.ndarray, costs: np.ndarray):
    """Rank of the least letter and the node its arc leads to, for all nodes (numbered along ``[row, segment, state]``)."""
    steps, shape = code.shape[1], costs.shape
    number = np.arange(costs.size).reshape(shape)
    letter, target = np.zeros(shape, np.int64), number.copy()
    here, after, behind = costs[:-1], costs[1:], number[1:]
    mark, delete, keep, rerole = _arcs(code.T, after)
    system = (code.T % 4 == 0)[..., None] & (np.arange(4) == START)
    kept = np.where(system, behind[..., AFTER_SYSTEM, None], behind[..., NEXT])
    choices = [
        (5, rerole, behind[..., NEXT]),
        (4, keep, kept),
        (3, INSERT + here[..., NEXT], number[:-1][..., NEXT]),
        (2, delete, behind),
        (1, mark, np.broadcast_to(behind[..., START, None], here.shape)),
    ]
    for rank, cost, to in choices:  # the least letter last, so it stays
        best = (cost == here) & (here < FAR)
        letter[:steps][best] = rank
        target[:steps][best] = to[best]
    return letter.ravel(), target.ravel()


def doubled(letter: np.ndarray, target: np.ndarray):
    """Pointers over 1, 2, 4, ... letters, and the ranks of all nodes by their least audits."""
    rank, pointer, levels = letter, target, []
    while True:
        levels.append(pointer)
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[pointer], return_inverse=True)
        beyond = pointer[pointer]
        if np.array_equal(beyond, pointer):
            return levels, rank
        pointer = beyond


def _padded(segments: list[np.ndarray]):
    size = np.array([len(s) for s in segments])
    code = np.zeros((len(segments), size.max()), np.int64)
    for i, s in enumerate(segments):
        code[i, code.shape[1] - len(s) :] = s
    return code, size


def solve(conversations: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(cost, audit) of each conversation, given the codes of its rows."""
    order = sorted(range(len(conversations)), key=lambda i: len(conversations[i]))
    segments, owner = [], []
    for i in order:
        codes = np.append(conversations[i], END)
        for at in range(0, len(codes), SEGMENT):
            segments.append(codes[at : at + SEGMENT])
            owner.append(i)
    goal = np.array([0, FAR, FAR, FAR])
    behind = [goal] * len(segments)
    joined = [k for k in range(1, len(segments)) if owner[k] == owner[k - 1]]  # segments that continue a conversation
    through = {}
    for at in range(0, len(joined), CHUNK):
        some = joined[at : at + CHUNK]
        through.update(zip(some, _matrices(*_padded([segments[k] for k in some]))))
    for k in reversed(joined):
        behind[k - 1] = np.minimum((through[k] + behind[k]).min(1), FAR)

    cost: dict[int, int] = {}
    audit: dict[int, list[bytes]] = {i: [] for i in order}
    state = START
    for at in range(0, len(segments), CHUNK):
        some = segments[at : at + CHUNK]
        code, size = _padded(some)
        costs = _costs(code, size, np.stack(behind[at : at + CHUNK]))
        letter, target = least_arcs(code, costs)
        levels, _ = doubled(letter, target)
        steps, n = code.shape[1], len(some)
        first = ((steps - size) * n + np.arange(n)) * 4  # node of state START before each segment's first row
        leaves = levels[-1][first[:, None] + np.arange(4)] % 4
        entry = np.empty(n, np.int64)
        for s in range(n):
            k = at + s
            if k == 0 or owner[k] != owner[k - 1]:
                state = START
                cost[owner[k]] = int(costs[steps - size[s], s, START])
            entry[s] = state
            state = int(leaves[s, state])
        path = (first + entry)[:, None]
        for pointer in levels:
            path = np.concatenate([path, pointer[path]], 1)
        ranks = letter[path]
        for s in range(n):
            audit[owner[at + s]].append(LETTERS[ranks[s][ranks[s] > 1]].tobytes())
    return [(cost[i], b"".join(audit[i])) for i in range(len(conversations))]


# --------------------------------------------------------------------------- Spark


def _prepared(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest, code``; the code holds role initial and fault, duplicates aside."""
    space = F.lit(" ")
    plain = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    initial = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))  # 0 for none and for an empty role
    known = F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3)
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return plain.select("*", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), (known + 4 * fault).cast("int").alias("code"))


def _counted(prepared: DataFrame) -> DataFrame:
    """Rows alike in turn, role and text once, with their number and whether the text came before their turn."""
    alike = prepared.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("code").alias("code"))
    alike = materialize(alike, "alike")
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    said = alike.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("said"), F.count(F.lit(1)).alias("turns"))
    again = said.filter("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "said")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    late = F.coalesce(place > F.col("said"), F.lit(False))
    return alike.join(again, same, "left").select("conv_id", "turn", "role", "digest", "n", "code", late.alias("late"))


REPORT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


class _Open:
    """What a task holds of the conversation it reads: a byte a row and a few numbers."""

    def __init__(self, conv):
        self.conv, self.codes, self.turns, self.low, self.high = conv, [], 0, None, None

    def add(self, turns: list, distinct_new: int, codes: np.ndarray):
        if turns:
            self.low = turns[0] if self.low is None else self.low
            self.turns += distinct_new - (self.high == turns[0])
            self.high = turns[-1]
        self.codes.append(codes)

    def finish(self):
        codes = np.concatenate(self.codes)
        fault, initial = np.bincount(codes // 4, minlength=4), codes % 4
        illegal = int((~_LEGAL[initial[:-1], initial[1:]]).sum())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return codes, (gaps, int(fault[BLANK]), int(fault[DUPLICATE]), int(fault[TRUNCATED]), illegal)


def _runs(column) -> np.ndarray:
    """Starts of the runs of equal values (NULL equals NULL), and the end."""
    import pyarrow.compute as pc

    index = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(index)) + 1, [len(index)]])


def _report_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    waiting, held, current, kind = [], 0, None, None

    def flush():
        solved = solve([codes for _, codes, _ in waiting])
        columns = list(zip(*[(conv, *counts, cost, audit.decode()) for (conv, _, counts), (cost, audit) in zip(waiting, solved)]))
        names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit"]
        types = [kind, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column("conv_id").type
        starts = _runs(batch.column("conv_id"))
        ids = batch.column("conv_id").take(starts[:-1]).to_pylist()
        n = batch.column("n").to_numpy()
        code = batch.column("code").to_numpy().astype(np.uint8)
        late = batch.column("late").to_numpy(zero_copy_only=False)
        repeat = np.where(code // 4 == BLANK, code, code % 4 + 4 * DUPLICATE).astype(np.uint8)
        turn = batch.column("turn")
        given = turn.is_valid().to_numpy(zero_copy_only=False)
        value = turn.fill_null(0).to_numpy()
        for conv, a, b in zip(ids, starts, starts[1:]):
            if current is None or conv != current.conv:
                if current is not None:
                    waiting.append((current.conv, *current.finish()))
                    held += len(waiting[-1][1])
                current = _Open(conv)
                if held > 100_000:
                    yield flush()
                    waiting, held = [], 0
            codes = np.repeat(repeat[a:b], n[a:b])
            heads = np.cumsum(n[a:b]) - n[a:b]
            codes[heads] = np.where(late[a:b], repeat[a:b], code[a:b])
            known = value[a:b][given[a:b]]
            current.add([int(known[0]), int(known[-1])] if len(known) else [], 1 + int(np.count_nonzero(np.diff(known))) if len(known) else 0, codes)
    if current is not None:
        waiting.append((current.conv, *current.finish()))
        yield flush()


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *by)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``: gaps in its turns, faults, illegal neighbours, cost and audit.

    ``gaps`` is last turn - first turn + 1 - distinct turns, NULL turns aside (0 if all are NULL)."""
    keyed = _sorted(_counted(_prepared(rows)), "turn", "role", "digest").select("conv_id", "turn", "n", "code", "late")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return keyed.mapInArrow(lean(_report_batches), REPORT.format(kind))


REPAIRED = "conv_id {}, position long, edit string, role string, text string"


def _repair_batches(batches: Iterator) -> Iterator:
    """Applies audits to rows; a conversation's audit precedes its rows."""
    import pyarrow as pa

    names = ["conv_id", "position", "edit", "role", "text"]
    for batch in _plans(batches):
        kind, out = batch
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _plans(batches: Iterator) -> Iterator:
    audit, at, state, position = "", 0, START, 0
    conv = object()

    def placed(edit: str, role: str, text: str):
        nonlocal state, position
        if edit == "K" and state == START and role.startswith("s"):
            state = AFTER_SYSTEM
        else:
            if edit != "K":
                role = "assistant" if state == AFTER_USER else "user"
            state = int(NEXT[state])
        position += 1
        return conv, position - 1, edit, role, text

    def insertions():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield placed("I", "", "")

    kind = None
    for batch in batches:
        kind = batch.column("conv_id").type
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")]
        for row_conv, row_audit, role, text in zip(*columns):
            if row_audit is not None:
                out.extend(insertions())  # those after the last row of the conversation before
                conv, audit, at, state, position = row_conv, row_audit, 0, START, 0
                continue
            out.extend(insertions())
            edit = audit[at]
            at += 1
            if edit != "D":
                out.append(placed(edit, role, text))
        if out:
            yield kind, out
    out = list(insertions())
    if out:
        yield kind, out


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations, ``(conv_id, position, edit, role, text)``: those of one conversation
    in one partition and in order.  ``report`` is the written result of :func:`audits` on the same rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    orders = report.select("conv_id", "audit", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in
                           (("turn", turn), ("role", "string"), ("digest", "binary"), ("text", "string"))])
    texts = _prepared(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    both = _sorted(orders.unionByName(texts), "kind", "turn", "role", "digest")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(lean(_repair_batches), REPAIRED.format(kind))


def _digest_batches(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    conv, digest, kind, done = object(), None, None, []

    def result():
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], ["conv_id", "sha256"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for row_conv, position, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")]):
            if position == 0:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = row_conv, hashlib.sha256()
            digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
        if len(done) > 10_000:
            yield result()
            done.clear()
    if digest is not None:
        done.append((conv, digest.hexdigest()))
    if done:
        yield result()


def digests(fixed: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, read from :func:`repaired` where it lies."""
    kind = fixed.schema["conv_id"].dataType.simpleString()
    return fixed.mapInArrow(lean(_digest_batches), f"conv_id {kind}, sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows spoilt by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its ``. ! ?``, 3 repeats it, 4 makes its role user; NULLs become one space (a NULL turn or id keeps its place)."""
    space = F.lit(" ")

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), space)

    spoilt = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    marked = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), spoilt.alias("spoilt")).filter("spoilt <> 0")
    times = F.sequence(F.lit(1), F.when(F.col("spoilt") == 3, 2).otherwise(1))
    return marked.select(
        "conv_id", "turn",
        F.when(F.col("spoilt") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("spoilt") == 1, "").when(F.col("spoilt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(times).alias("copy"),
    ).drop("copy")
