"""Conversation repair against a forward search over whole edit lists, and its ranks, edges and skew."""

import hashlib
import random

import numpy as np

from weekpanel.llm import repair
from weekpanel.llm.repair import SEGMENT, audits, damage, digests, repaired, solve

SCHEMA = "conv_id long, turn long, role string, text string, audit string, n long, code int, kind int, position int"
NONE = (10**9, "")


def search(kinds):
    """Least (cost, audit) for rows of (initial, fault): a forward search that keeps the best list of each state."""

    def insertions(v):
        for _ in range(3):
            for a, b in ((0, 2), (1, 2), (2, 3), (3, 2)):
                v[b] = min(v[b], (v[a][0] + 5, v[a][1] + "I"))
        return v

    v = insertions([(0, ""), NONE, NONE, NONE])
    for initial, fault in kinds:
        w = [NONE] * 4
        for state, (cost, audit) in enumerate(v):
            if cost >= NONE[0]:
                continue
            w[state] = min(w[state], (cost + 2, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            wanted, to = ("a", 3) if state == 2 else ("u", 2)
            w[to] = min(w[to], (cost + 1, audit + "R"))
            if initial == wanted:
                w[to] = min(w[to], (cost, audit + "K"))
            if initial == "s" and state == 0:
                w[1] = min(w[1], (cost, audit + "K"))
        v = insertions(w)
    return min(v[0], v[3])


def judged(rows):
    """Rows of one conversation in order -> (initial, fault)."""
    seen, out = set(), []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return rows, out


def brute(rows):
    rows, kinds = judged(rows)
    cost, audit = search(kinds)
    out, at, turns = [], 0, [r[0] for r in rows if r[0] is not None]
    for letter in audit:
        row = None
        if letter != "I":
            row, at = rows[at], at + 1
        if letter == "D":
            continue
        previous = out[-1][0][:1] if out else ""
        role = row[1] if letter == "K" else "assistant" if previous == "u" else "user"
        out.append((role, row[2] if row else ""))
    initials = [k for k, _ in kinds]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[sum(f == x for _, f in kinds) for x in repair.FAULTS],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def spark_result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)
    report = spark.createDataFrame(audits(df).collect(), audits(df).schema)
    sha = {r.conv_id: r.sha256 for r in digests(repaired(df, report)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv_id, empty)) for r in report.collect()}


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def codes(kinds):
    faults = ("", *repair.FAULTS)
    return np.array(["sua".find(i) % 4 + 4 * faults.index(f) if i else 3 + 4 * faults.index(f) for i, f in kinds], np.uint8)


def random_kinds(rng, n):
    return [(rng.choice("suax"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_solver_equals_search():
    rng = random.Random(5)
    sizes = [0, 1, 2, 3, 4, 5, 7, SEGMENT - 2, SEGMENT - 1, SEGMENT, SEGMENT + 1, 3 * SEGMENT + 5]
    kinds = [random_kinds(rng, rng.choice(sizes)) for _ in range(250)]
    for (cost, audit), k in zip(solve([codes(k) for k in kinds]), kinds):
        assert (cost, audit.decode()) == search(k)


def test_ranks_order_nodes_by_their_audits():
    rng = random.Random(8)
    code, size = repair._padded([np.append(codes(random_kinds(rng, 9)), repair.END) for _ in range(12)])
    costs = repair._costs(code, size, np.tile(np.array([0, repair.FAR, repair.FAR, repair.FAR]), (12, 1)))
    letter, target = repair.least_arcs(code, costs)
    _, rank = repair.doubled(letter, target)

    def audit(node):
        out = []
        while target[node] != node:
            out.append(letter[node])
            node = target[node]
        return tuple(out)

    strings = [audit(v) for v in range(len(letter))]
    places = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert [places[s] for s in strings] == rank.tolist()


EDGES = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."),
    (2, 0, "user", " \n"), (2, 1, "user", ""), (2, 2, None, None),
    (3, None, "user", "first?"), (3, None, "assistant", "a!"), (3, 4, "user", "first?"), (3, 9, "assistant", "cut"),
    (4, 2, "system", "S."), (4, 2, "system", "S."), (4, 2, "system", "S."), (4, 3, "tool", "T."), (4, 5, "", "no role."),
    (None, 0, "assistant", "alone."), (None, 7, "user", "x" * 100_000 + "."),
    (5, -3, "system", "only system!"), (6, 0, "assistant", "ü?\t\n"),
]


def test_edges(spark):
    got = spark_result(spark, EDGES)
    assert got == {c: brute(r) for c, r in by_conversation(EDGES).items()}


def test_random_conversations_and_a_long_one(spark):
    rng = random.Random(11)
    texts = ["Fine.", "cut", "", " ", "So?", "No!", "tail ", "x. \n"]
    rows = []
    for conv in range(120):
        size = 700 if conv == 7 else rng.randrange(1, 9)
        for turn in range(size):
            said = rng.choice(texts) if rng.random() < 0.5 else f"{turn} says."
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", None]), said))
    assert spark_result(spark, rows) == {c: brute(r) for c, r in by_conversation(rows).items()}


def test_one_row_repeated_many_times(spark):
    rows = [(1, 0, "user", "same.")] * 5000 + [(1, 1, "assistant", "end.")]
    assert spark_result(spark, rows)[1][5:7] == (2 * 4999, "K" + "D" * 4999 + "K")


def test_empty_table(spark):
    assert spark_result(spark, []) == {}


def test_damage(spark):
    from binascii import crc32

    rows = [(c, t, ("user", "assistant")[t % 2], "Go. Now! Why?") for c in range(30) for t in range(10)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)
    got = sorted(map(tuple, damage(df).collect()), key=str)
    want = []
    for conv, turn, role, text in rows:
        h = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            text = {1: "", 2: "Go Now Why" if text != " " else " "}.get(h, text)
            want += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    assert got == sorted(want, key=str)
