"""DuckDB counterparts of the registered queries, over the events table."""

from __future__ import annotations

from ..operators.levels import STATE
from ..sources.adapters import feed_sql, triggers_sql

FEED = feed_sql(True)
E6 = 1_000_000


def over_feed(select: str, more: str = "") -> str:
    return f"with {FEED}{', ' + more if more else ''} {select}"


_DIFF_LEVELS = f"""select symbol, seg, event_id * 2 + 1 as spot, 0 as side, 0 as pos, b1 * {E6} as price, q * {E6} as qty from judged where outcome = 'apply'
  union all select symbol, seg, event_id * 2 + 1, 0, 1, b2 * {E6}, q * {E6} from judged where outcome = 'apply'
  union all select symbol, seg, event_id * 2 + 1, 1, 0, a1 * {E6}, q * {E6} from judged where outcome = 'apply'
  union all select symbol, seg, event_id * 2 + 1, 1, 1, a2 * {E6}, q * {E6} from judged where outcome = 'apply'"""


def _seed_levels(where: str, n: int, step: int, qty: str) -> str:
    one = lambda side, sign: f"select symbol, seg, event_id * 2 as spot, {side} as side, i as pos, (p {sign} (1 + {step} * i)) * {E6} as price, {qty} * {E6 * 100} as qty from judged, unnest(range({n})) t(i) where {where}"
    return f"{one(0, '-')} union all {one(1, '+')}"


#: a depth5 row starts a segment; outcomes of diffs in it
_CHECKPOINT = f"""
s0 as (select *, sum(case when kind = 'depth5' then 1 else 0 end) over (partition by symbol order by event_id) as seg from feed),
s1 as (select *, max(case when kind = 'depth5' then ep end) over (partition by symbol, seg) as seg_ep,
  max(case when kind = 'depth5' then dn * 10 when kind = 'depth_diff' then final_id end) over (partition by symbol, seg order by event_id rows between unbounded preceding and 1 preceding) as reached from s0),
s2 as (select *, seg > 0 and ep = seg_ep as ready, kind = 'depth_diff' and seg > 0 and ep = seg_ep and final_id > reached and first_id > reached + 1 as jump from s1),
s3 as (select *, coalesce(bool_or(jump) over (partition by symbol, seg order by event_id rows between unbounded preceding and 1 preceding), false) as gapped from s2),
judged as (select *, case when kind <> 'depth_diff' then kind when not ready or gapped then 'buffered' when final_id <= reached then 'stale' when jump then 'gap' else 'apply' end as outcome from s3),
updates as ({_DIFF_LEVELS} union all {_seed_levels("kind = 'depth5'", 5, 2, "(k + i + 1)")})"""


def _sidecar(venue: str) -> str:
    return f"""
s0 as (select *, {triggers_sql(venue)} as trigger from feed),
s1 as (select *, sum(case when trigger then 1 else 0 end) over (partition by symbol order by event_id) as seg from s0),
judged as (select *, case when kind <> 'depth_diff' then kind when trigger then 'apply' when final_id <= pm then 'stale' else 'apply' end as outcome from s1),
updates as ({_DIFF_LEVELS} union all {_seed_levels("trigger", 20, 1, "(i + 1)")})"""


def _best(marks: str) -> str:
    """CTE `best`: the five best levels a side at marks (symbol, seg, mark, upto)."""
    pick = ", ".join(f"coalesce(max(case when side = {s} and n = {i + 1} then {c} end), 0) as {name}{i}" for s, name, c in ((0, "bid", "price"), (0, "bid_size", "qty"), (1, "ask", "price"), (1, "ask_size", "qty")) for i in range(5))
    return f"""
marks as ({marks}),
held as (select m.symbol, m.mark, u.side, u.price, arg_max(u.qty, u.spot * 1000 + u.pos) as qty from marks m join updates u on u.symbol = m.symbol and u.seg = m.seg and u.spot <= m.upto
  where not (u.spot % 2 = 0 and u.qty = 0) group by m.symbol, m.mark, u.side, u.price),
ranked as (select *, row_number() over (partition by symbol, mark, side order by case when side = 0 then -price else price end) as n from held where qty <> 0),
best as (select m.symbol, m.mark, {pick} from marks m left join ranked r on r.symbol = m.symbol and r.mark = m.mark and r.n <= 5 group by m.symbol, m.mark)"""


_ID = "cast(list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(range(1, length(symbol) + 1), lambda i: cast(ascii(symbol[i]) as bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) & 2147483647 as integer)"
_PARTIAL = ", ".join(x for i in range(5) for x in (f"(p - {1 + 2 * i}) * {E6} as bid{i}", f"(k + {i + 1}) * {100 * E6} as bid_size{i}", f"(p + {1 + 2 * i}) * {E6} as ask{i}", f"(k + {i + 1}) * {100 * E6} as ask_size{i}"))


def book(mode: str, trades: bool = False) -> str:
    """The book table of a rebuild."""
    rules = _CHECKPOINT if mode == "checkpoint" else _sidecar(mode)
    taken = "outcome = 'apply'" + (" or kind = 'trade' and ready and not gapped" if trades else "")
    marks = f"select symbol, seg, event_id as mark, event_id * 2 + 1 as upto from judged where {taken}"
    cols = ", ".join(STATE)
    return f"""with {FEED}, {rules}, {_best(marks)},
rows as (select b.symbol, j.event_id, j.tsec, j.tnsec, case when j.kind = 'trade' then 'T' else 'D' end as type, {cols} from best b join judged j on j.event_id = b.mark
  union all select symbol, event_id, tsec, tnsec, 'S', {cols} from (select *, {_PARTIAL} from feed where kind = 'depth5'))
select symbol, tsec, cast(tnsec as integer) as tnsec, row_number() over (partition by symbol order by event_id) as "seqNo", {_ID} as id, type, 'N' as side, {cols} from rows"""


def final_top5() -> str:
    marks = "select symbol, seg, seg as mark, max(event_id) * 2 + 1 as upto from judged where seg > 0 group by symbol, seg"
    return f"with {FEED}, {_CHECKPOINT}, {_best(marks)} select symbol, cast(mark as bigint) as segment, {', '.join(STATE)} from best"


def checks() -> str:
    """Depth5 rows beside the best bid of the book before them."""
    marks = """select j.symbol, j.seg - 1 as seg, j.event_id as mark, j.event_id * 2 - 1 as upto from judged j
      join (select symbol, seg, ep from judged where kind = 'depth5') d on d.symbol = j.symbol and d.seg = j.seg - 1 and d.ep = j.ep where j.kind = 'depth5'"""
    return f"with {FEED}, {_CHECKPOINT}, {_best(marks)} select b.symbol, b.mark + 1 as seq, bid0 as book_bid, (p - 1) * {E6} as depth5_bid from best b join feed f on f.event_id = b.mark"


def writes() -> str:
    """Price levels at the end of each checkpoint segment."""
    return f"""with {FEED}, {_CHECKPOINT}
select symbol, cast(seg as bigint) as segment, cast(side as integer) as side, price, arg_max(qty, spot * 1000 + pos) as qty from updates where not (spot % 2 = 0 and qty = 0)
group by symbol, seg, side, price having arg_max(qty, spot * 1000 + pos) <> 0"""


def spans() -> str:
    """How long each level of a checkpoint segment stands, in applied updates."""
    return f"""with {FEED}, {_CHECKPOINT},
ords as (select symbol, seg, event_id * 2 + 1 as spot, row_number() over (partition by symbol, seg order by event_id) as ordinal from judged where outcome = 'apply'
  union all select symbol, seg, event_id * 2, 0 from judged where kind = 'depth5'),
one as (select symbol, seg, spot, side, price, arg_max(qty, pos) as qty from updates where not (spot % 2 = 0 and qty = 0) group by all)
select symbol, cast(seg as bigint) as segment, cast(side as integer) as side, price, ordinal, qty,
  lead(ordinal) over (partition by symbol, seg, side, price order by ordinal) as until from one join ords using (symbol, seg, spot)"""


def metrics() -> str:
    count = lambda c: f"count(*) filter (where {c})"
    return f"""with {FEED}, {_CHECKPOINT}, lagged as (select *, lag(ep) over (partition by symbol order by event_id) as ep_before from judged),
mismatch as (select symbol, count(*) filter (where book_bid <> depth5_bid) as n from ({checks()}) group by symbol),
per as (select l.symbol, count(*) as msgs_total, {count("kind = 'depth_diff'")} as depth_diff, {count("kind = 'depth5'")} as depth5, {count("kind = 'trade'")} as trade, 0 as parse_errors,
  {count("outcome = 'gap'")} as gaps, {count("ep <> ep_before")} as reconnects, 0 as resyncs, 0 as buffer_overflows, coalesce(max(m.n), 0) as depth5_mismatch,
  {count("outcome in ('apply', 'depth5')")} as ob_rows, count(*) as md_rows from lagged l left join mismatch m on m.symbol = l.symbol group by l.symbol)
select symbol, {", ".join(f"cast(sum({n}) as bigint) as {n}" for n in "msgs_total depth_diff depth5 trade parse_errors gaps reconnects resyncs buffer_overflows depth5_mismatch ob_rows md_rows".split())} from per group by rollup (symbol)"""


def metrics_by_capture() -> str:
    """metrics() with the one capture of the feed."""
    names = "msgs_total depth_diff depth5 trade parse_errors gaps reconnects resyncs buffer_overflows depth5_mismatch ob_rows md_rows".split()
    cols = ", ".join(names)
    return f"select 'c0' as capture_id, symbol, {cols} from ({metrics()}) union all select null, null, {cols} from ({metrics()}) where symbol is null"


def summary() -> str:
    count = lambda sql: f"(select count(*) from ({sql}))"
    book_sql = book("spot")
    one = f"select 'c0' as capture_id, {count(over_feed('select * from feed'))} as market_rows, {count(over_feed('select * from feed where ' + triggers_sql('spot')))} as snapshot_rows"
    return f"{one}, {count(book_sql)} as book_rows, {count(f'select * from ({book_sql}) where bid0 > 0 and ask0 > 0 and bid0 >= ask0')} as crossed_rows"


def continuity(venue: str) -> str:
    gap = "first_id > pm + 1" if venue == "spot" else "pu <> pm"
    return over_feed(f"select symbol, event_id + 1 as seq, case when pm is null then 'first' when final_id <= pm then 'stale' when {gap} then 'gap' else 'next' end as outcome from feed where kind = 'depth_diff'")
