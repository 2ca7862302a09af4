"""Faults of conversations and their cheapest repair.

Messages become letters (a role's initial and a fault), letters runs of at most RUN; the auction of
auction.py finds each run's edits, so that a conversation of any length is spread over tasks. Texts move
once, when edits are applied.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import auction
from .common import trimmed, written
from .order import placed

#: messages of a conversation that one auction decides
RUN = 32
#: fixed values: white space and the ends of sentences
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
STOPS = ".!?"
KEPT_PATTERNS = 100_000  # patterns whose edits a task remembers


@dataclass
class Repaired:
    """summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has a row.

    messages: conv_id, place, edit, role, text, what the edits leave; a conversation's stand together and in
    order, in one partition.
    """

    summary: DataFrame
    messages: DataFrame


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def _same(conv: str) -> Column:
    return F.col("conv_id").eqNullSafe(F.col(conv))


def _letters(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n, first, more) of equal rows of a turn: the letters of the first and of its n - 1 repetitions."""
    text = F.rtrim(F.col("text"), F.lit(WHITE))
    is_cut = ~F.right(text, F.lit(1)).isin(*STOPS)
    lean = rows.select("conv_id", "turn", _digest().alias("digest"), F.left("role", F.lit(1)).alias("initial"), (text == "").alias("blank"), is_cut.alias("is_cut"))
    each = lean.groupBy("conv_id", "turn", "digest").agg(F.count("*").alias("n"), F.max("initial").alias("initial"), F.max("blank").alias("blank"), F.max("is_cut").alias("is_cut"))
    each = written(each, "turns")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = each.groupBy("conv_id", "digest").agg(F.min(turn).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "_first")
    joined = each.join(firsts, _same("_conv") & (F.col("digest") == F.col("_digest")), "left")
    later = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    of_role = F.when(F.col("initial").isin(*"sua"), F.instr(F.lit("sua"), F.col("initial")) - 1).otherwise(3) * 4
    letter = lambda fault: F.substr(F.lit("abcdefghijklmnop"), of_role + fault + 1, F.lit(1))
    fault = F.when(F.col("blank"), auction.BLANK).when(later, auction.DUPLICATE).when(F.col("is_cut"), auction.CUT).otherwise(auction.CLEAN)
    again = F.when(F.col("blank"), auction.BLANK).otherwise(auction.DUPLICATE)
    return joined.select("conv_id", "turn", "digest", "n", letter(fault).alias("first"), letter(again).alias("more"))


def _runs(letters: DataFrame, stats: DataFrame) -> DataFrame:
    """(conv_id, run, letters, total): runs of RUN messages, total in the conversation."""
    at = placed(letters, ["conv_id"], ["turn", "digest"], F.col("n"))
    each = at.select("conv_id", "place", "first", "more", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("_at"))
    letter = F.when(F.col("_at") == F.col("place"), F.col("first")).otherwise(F.col("more"))
    each = each.select("conv_id", F.floor((F.col("_at") - 1) / RUN).alias("run"), F.col("_at"), letter.alias("letter"))
    runs = each.groupBy("conv_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "letter"))), lambda x: x["letter"]), "").alias("letters"))
    total = stats.select(F.col("conv_id").alias("_conv"), "total")
    return runs.join(total, _same("_conv")).drop("_conv")


def _added(df: DataFrame, run, **fields) -> DataFrame:
    """df with what run gives for each row; run gets a batch's columns as lists and gives lists by name."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields.items()]])
    types = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.LongType()): pa.list_(pa.int64()), T.ArrayType(T.StringType()): pa.list_(pa.string())}
    names = df.columns

    def each(batches):
        state: dict = {}
        for batch in batches:
            if batch.num_rows:
                found = run({n: batch.column(n).to_pylist() for n in names}, state)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[n], types[t]) for n, t in fields.items()]], [*batch.schema.names, *fields])

    return df.mapInArrow(each, schema)


def _solved(rows: dict, memo: dict) -> dict:
    out = []
    for letters in rows["letters"]:
        if letters not in memo:
            if len(memo) >= KEPT_PATTERNS:
                memo.clear()
            memo[letters] = auction.solved(letters)
        out.append(memo[letters])
    return {"cost": [c for c, _ in out], "edits": [e for _, e in out]}


def _closing(rows: dict) -> list[bool]:
    return [(r + 1) * RUN >= t for r, t in zip(rows["run"], rows["total"])]


def _costs(rows: dict, _) -> dict:
    return {"costs": [[x for line in auction.costs(s, end) for x in line] for s, end in zip(rows["letters"], _closing(rows))]}


def _ends(rows: dict, state: dict) -> dict:
    """Runs from a conversation's last to its first: what its last states cost from there on."""
    out = []
    for end, costs in zip(_closing(rows), rows["costs"]):
        if end:
            state["v"] = list(auction.END)
        out.append(state["v"])
        wide = len(costs) // 4
        lines = [costs[q * wide : (q + 1) * wide] for q in range(4)]
        state["v"] = [min(auction.FAR, min(c if end else c + v for c, v in zip(line, state["v"]))) for line in lines]
    return {"ends": out}


def _traced(rows: dict, _) -> dict:
    found = [auction.traced(s, tuple(v), end) for s, v, end in zip(rows["letters"], rows["ends"], _closing(rows))]
    return {"ways": [[w[1] for w in x] for x in found], "numbers": [[n for w in x for n in (w[0], w[2])] for x in found]}


def _chosen(rows: dict, state: dict) -> dict:
    """Runs from a conversation's first to its last: the way that goes on where the run before has ended."""
    out: dict[str, list] = {"cost": [], "edits": [], "state": [], "before": []}
    for run, letters, ways, numbers in zip(rows["run"], rows["letters"], rows["ways"], rows["numbers"]):
        q, before = (state["q"], state["before"]) if run else (auction.START, "")
        for name, value in (("cost", 0 if run else numbers[0]), ("edits", ways[q]), ("state", q), ("before", before)):
            out[name].append(value)
        state.update(q=numbers[2 * q + 1], before=letters[-1])
    return out


def _decided(runs: DataFrame) -> DataFrame:
    """runs with cost (of the conversation, at its first run), edits, state (before the run) and before (the letter before it)."""
    long, text, longs = T.LongType(), T.StringType(), T.ArrayType(T.LongType())
    short = _added(runs.filter(F.col("total") <= RUN), _solved, cost=long, edits=text)
    short = short.withColumns({"state": F.lit(auction.START).cast("bigint"), "before": F.lit("")})
    cut = _added(runs.filter(F.col("total") > RUN), _costs, costs=longs)
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("run"))
    cut = _added(cut, _ends, ends=longs).drop("costs").repartition("conv_id", "run")  # traced by as many tasks as there are runs for
    cut = _added(cut, _traced, ways=T.ArrayType(text), numbers=longs).repartition("conv_id").sortWithinPartitions("conv_id", "run")
    cut = _added(cut, _chosen, cost=long, edits=text, state=long, before=text)
    return short.unionByName(cut.select(*short.columns))


def _counted(decided: DataFrame, stats: DataFrame) -> DataFrame:
    faulty = lambda fault: F.length(F.regexp_replace("letters", f"[^{'bfjn' if fault == 1 else 'cgko' if fault == 2 else 'dhlp'}]", ""))
    roles = F.translate(F.concat("before", "letters"), "abcdefghijklmnop", "ssssuuuuaaaa????")
    legal = lambda i: F.substr(roles, i, F.lit(2)).isin("su", "ua", "au")
    pairs = F.when(F.length(roles) > 1, F.sequence(F.lit(1), F.length(roles) - 1)).otherwise(F.array().cast("array<int>"))
    long = lambda c: F.sum(c).cast("bigint")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "edits"))), lambda x: x["edits"]), "")
    found = decided.groupBy("conv_id").agg(*[long(faulty(k)).alias(n) for k, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))], long(F.size(F.filter(pairs, lambda i: ~legal(i)))).alias("illegal"), long("cost").alias("cost"), audit.alias("audit"))
    gaps = stats.select(F.col("conv_id").alias("_conv"), "gaps")
    return found.join(gaps, _same("_conv")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _apply(batches):
    """A conversation's runs, then its rows in order: the rows as repaired."""
    ops: list[str] = []  # what becomes of a message, by number
    codes: dict[str, int] = {}
    plan, at, place, conv, began = array("H"), 0, 0, None, False
    names = {"s": "system", "u": "user", "a": "assistant"}
    out: list[list] = [[], [], [], [], []]

    def put(op: str, role: str, text: str) -> None:
        nonlocal place
        new, _, own = op.partition(".")
        made = [("I", names[x], "") for x in new] + ([("K", role, text)] if own == "k" else [("R", names[own], text)] if own else [])
        for edit, r, t in made:
            place += 1
            for column, value in zip(out, (conv, place, edit, r, t)):
                column.append(value)

    for batch in batches:
        col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for c, kind, run, letters, edits, state, role, text in zip(*(col[n] for n in ("conv_id", "kind", "run", "letters", "edits", "state", "role", "text"))):
            if c != conv or not began:
                conv, began, at, place, plan = c, True, 0, 0, array("H")
            if kind == 0:
                for op in auction.decided(edits, letters, state)[0]:
                    if op not in codes:
                        codes[op] = len(ops)
                        ops.append(op)
                    plan.append(codes[op])
                continue
            put(ops[plan[at]], role, text)
            at += 1
            if at == len(plan) - 1 and ops[plan[at]].startswith("+"):  # inserted behind the last message
                put(ops[plan[at]][1:], "", "")
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (batch.column("conv_id").type, pa.int64(), pa.string(), pa.string(), batch.column("text").type))], ["conv_id", "place", "edit", "role", "text"])
            out = [[], [], [], [], []]


def repair(rows: DataFrame) -> Repaired:
    """Conversations' faults and cheapest repair; rows: conv_id, turn, role, text (other columns are not read).

    A conversation is its rows by turn, nulls first; rows of one turn come in order of a digest of role and
    text. Null roles and texts count as one space; rows of the null conv_id are one conversation. The first
    that holds of a row is its fault: blank (nothing but white space), duplicate (role and text stood before),
    truncated (the last character that is no white space ends no sentence). Edits: K keep, R change the
    role, D delete, I insert an empty message; see auction.py for their costs. Equal rows and ties have the
    same result in any order. An empty table gives empty tables.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    letters = written(_letters(rows), "letters")
    turns = letters.groupBy("conv_id", "turn").agg(F.sum("n").alias("n"))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    stats = turns.groupBy("conv_id").agg(F.sum("n").alias("total"), span.alias("gaps"))
    runs = written(_runs(letters, stats), "runs")
    decided = written(_decided(runs), "edits")
    return Repaired(_counted(decided, stats), _messages(rows, decided))


def _messages(rows: DataFrame, decided: DataFrame) -> DataFrame:
    none = F.lit(None)
    plans = decided.select("conv_id", F.lit(0).alias("kind"), "run", "letters", "edits", "state", none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("binary").alias("digest"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), none.cast("bigint").alias("run"), none.cast("string").alias("letters"), none.cast("string").alias("edits"), none.cast("bigint").alias("state"), "turn", _digest().alias("digest"), "role", "text")
    # a conversation is put together where its digest is made, which is made byte after byte
    both = plans.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "run", F.col("turn").asc_nulls_first(), "digest")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]])
    return both.drop("turn", "digest").mapInArrow(lambda batches: trimmed(_apply(batches)), schema)


def _hash(batches):
    import hashlib

    conv, digest = None, None
    for batch in batches:
        convs, found = [], []
        col = [batch.column(n).to_pylist() for n in ("conv_id", "role", "text")]
        for c, role, text in zip(*col):
            if digest is None or c != conv:
                if digest is not None:
                    convs.append(conv)
                    found.append(digest.hexdigest())
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if convs:
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.column("conv_id").type), pa.array(found)], ["conv_id", "sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], batch.column("conv_id").type), pa.array([digest.hexdigest()])], ["conv_id", "sha256"])


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, sha256) of repair()'s messages as `role:text` lines; reads them in the order in which they stand."""
    return messages.mapInArrow(_hash, T.StructType([messages.schema["conv_id"], T.StructField("sha256", T.StringType())]))
