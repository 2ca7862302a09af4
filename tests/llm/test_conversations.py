"""op11 and op13 against plain versions, and their edges."""

import hashlib
import random
import re
import zlib
from itertools import pairwise

import pytest

from ladderbook.llm import auction, conversations
from ladderbook.llm.queries import QUERIES, damaged

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """rows: (turn, role, text) in order; all of op11's columns but conv_id, by trying edits message after message."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def insert(states):
        for _ in range(3):
            for q, (cost, audit, out) in list(states.items()):
                new = NEXT[q]
                made = (cost + 5, audit + "I", (*out, ("user" if new == "u" else "assistant", "")))
                if new not in states or made[:2] < states[new][:2]:
                    states[new] = made
        return states

    insert(best)
    for (_, role, text), fault in zip(rows, faults):
        nxt = {}
        for q, (cost, audit, out) in best.items():
            arcs = [(2, "D", q, ())]
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                arcs.append((1 + more, "R", NEXT[q], (("user" if NEXT[q] == "u" else "assistant", text),)))
                initial = role[:1]
                if initial == NEXT[q] or initial == "s" and q == "":
                    arcs.append((more, "K", initial, ((role, text),)))
            for c, e, to, add in arcs:
                made = (cost + c, audit + e, out + add)
                if to not in nxt or made[:2] < nxt[to][:2]:
                    nxt[to] = made
        best = insert(nxt)
    cost, audit, out = min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def digest(row):
    return hashlib.md5(f"{len(row[1])}:{row[1]}{row[2]}".encode()).digest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))


def test_repair_query(spark, sf):
    found = {}
    for c, t, role, text in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = found.setdefault(c, [])
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        own += [(t, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    want = {c: plain_repair(in_order(rows)) for c, rows in found.items()}
    got = {r["conv_id"]: tuple(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert got == want


def compared(spark, convs, columns="conv_id bigint, turn bigint, role string, text string"):
    rows = [(c, *r) for c, own in convs.items() for r in own]
    random.Random(3).shuffle(rows)
    got = conversations.repair(spark.createDataFrame(rows, columns))
    hashed = {r["conv_id"]: r["sha256"] for r in conversations.digests(got.messages).collect()}
    found = {r["conv_id"]: (*tuple(r)[1:], hashed.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in got.summary.collect()}
    clean = lambda x: " " if x is None else x
    assert found == {c: plain_repair(in_order([(t, clean(role), clean(text)) for t, role, text in own])) for c, own in convs.items() if own}


def test_repair_hard_conversations(spark):
    rng = random.Random(7)
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "", "sam", "ua", None, "Tool"])
    text = lambda: rng.choice(["a.", "b!", "c", "d ?\n", "", " \t", "e. \r\n", None, "long " * 50 + ".", "é."])
    convs = {c: [(rng.choice([None, *range(12)]), role(), text()) for _ in range(rng.randrange(1, 14))] for c in range(80)}
    convs |= {100 + k: [(t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else role(), f"{t}." if rng.random() < 0.8 else text()) for t in range(n)] for k, n in enumerate((31, 32, 33, 64, 65, 200, 700))}
    convs |= {None: [(0, "user", "x."), (1, "assistant", "y.")], 300: [(0, "assistant", "x.")] * 90, 301: [(None, "user", None)] * 40, 302: [(0, "user", "x.")], 303: [(0, "system", "x.")]}
    compared(spark, convs)


def test_repair_of_nothing(spark):
    got = conversations.repair(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert got.summary.count() == 0 and got.messages.count() == 0


def test_repair_other_columns(spark):
    rows = spark.createDataFrame([("a", 0, "user", "x.", 1, 2, "z"), ("a", 1, "assistant", "y.", 3, 4, "q")], "conv_id string, turn int, role string, text string, place int, run int, letters string")
    assert [tuple(r) for r in conversations.repair(rows).summary.collect()] == [("a", 0, 0, 0, 0, 0, 0, "KK")]


@pytest.mark.parametrize("run", [1, 2, 5])
def test_auctions_of_runs(run):
    """Runs put together by their costs give what one auction of all messages gives, and prices expose all cheapest ways."""
    rng = random.Random(run)
    for _ in range(400):
        letters = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 11)))
        runs = [letters[i : i + run] for i in range(0, len(letters), run)]
        v, ends = auction.END, []
        for k in range(len(runs) - 1, -1, -1):
            ends.append(v)
            lines = auction.costs(runs[k], k == len(runs) - 1)
            v = tuple(min(auction.FAR, min(line[0] if k == len(runs) - 1 else c + x for c, x in zip(line, v))) for line in lines)
        state, edits = auction.START, ""
        for k, own in enumerate(runs):
            _, more, state = auction.traced(own, ends[len(runs) - 1 - k], k == len(runs) - 1)[state]
            edits += more
        assert (v[auction.START], edits) == auction.solved(letters)


def test_damage_repeats_and_drops(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "a! b.") for c in range(40) for t in range(10)], "conv_id bigint, turn bigint, role string, text string")
    got = sorted(map(tuple, damaged(rows).collect()))
    want = []
    for c in range(40):
        for t in range(10):
            n = zlib.crc32(f"{c}:{t}".encode()) % 20
            if n:
                want += [(c, t, "user" if n == 4 else "assistant", "" if n == 1 else "a b" if n == 2 else "a! b.")] * (2 if n == 3 else 1)
    assert got == sorted(want)


def plain_trie(seqs):
    """Nodes of whole sequences by id: every prefix as a key."""
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}

    def leaves(p):
        return sum(map(leaves, kids[p])) if kids[p] else 1

    def saved(p):
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        return own + sum(map(saved, kids[p]))

    ends = {p: ",".join(str(c) for c in sorted(nodes[p]) if len(seqs[c]) == len(p)) for p in nodes}
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves(p), saved(p), hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items())


def grafted_plainly(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    own = {c: [r[1:] for r in in_order(x)] for c, x in own.items()}
    out = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + x[h:]
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes_of(frame):
    return sorted(tuple(-1 if n == "parent_conv_id" and r[n] is None else r[n] for n in NODE) for r in frame.collect())


def test_trie_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert nodes_of(QUERIES["op13_prefix_trie"](spark, sf)) == plain_trie(grafted_plainly(map(tuple, rows)))


def test_trie_query_equals_sql(spark, sf):
    from ladderbook.llm.queries import ORACLES

    from ..test_queries import compare

    compare(spark, sf, QUERIES["op13_prefix_trie"], ORACLES["op13_prefix_trie"])


def test_trie_hard_conversations(spark, monkeypatch):
    from ladderbook.llm import trie as T
    from ladderbook.llm.queries import grafted

    monkeypatch.setattr(T, "ENDS", 7)  # lists of ends in several ranges
    rng = random.Random(5)
    rows = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None, "é", "user"])) for c in range(60) for _ in range(rng.randrange(0, 6))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)] + [(None, 0, "user", "x")]
    rows += [(200, t, "user", "one long") for t in range(300)] + [(201, 0, "user", "one long"), (203, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = T.turns_of(frame)
    ids = turns.select("conv_id").distinct()
    import sys

    sys.setrecursionlimit(5000)
    assert nodes_of(T.trie(grafted(turns, ids), ids)) == plain_trie(grafted_plainly(rows))


def test_trie_of_nothing(spark):
    from ladderbook.llm import trie as T

    turns = T.turns_of(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, place int"))
    assert T.trie(turns, turns.select("conv_id").distinct()).count() == 0
