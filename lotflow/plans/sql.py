"""SQL of the derived inputs and of the ledger, in the oracle's dialect."""

MOVEMENTS = """movements as (
 select concat_ws('-',substr(h,1,8),substr(h,9,4),substr(h,13,4),substr(h,17,4),substr(h,21,12)) as event_id,
  concat('00-',h,'-',substr(h,1,16),'-01') as trace_parent, concat('VENDOR-',cast(l_suppkey as varchar)) as aggregate_id,
  l_shipdate as occurred_at, l_shipdate + to_days(cast(l_orderkey % 45 as integer)) as published_at,
  cast(day*100000000000+l_orderkey*10+l_linenumber as bigint) as sequence_engine_key,
  case when l_returnflag='N' then 1 when l_returnflag='A' then 2 else 3 end as movement_type,
  concat('SKU-',cast(l_partkey as varchar)) as sku, concat('VENDOR-',cast(l_suppkey as varchar)) as mdm_vendor_id,
  concat('LOC-',cast(l_suppkey % 2 as varchar)) as location_id,
  cast(cast(case when l_returnflag='R' and l_linestatus='F' then -l_quantity else l_quantity end as decimal(18,4)) as varchar) as quantity,
  cast(cast(l_extendedprice as decimal(18,2)) as varchar) as unit_cost, l_linenumber = 1 as redelivered
 from (select *, datediff('day', date '1992-01-01', cast(l_shipdate as date)) as day,
  md5(concat_ws('-',cast(l_orderkey as varchar),cast(l_linenumber as varchar),cast(l_partkey as varchar),cast(l_suppkey as varchar),cast(l_shipdate as varchar))) as h from lineitem) x)"""

TYPED = """typed as (select * replace (cast(quantity as decimal(18,4)) as quantity, cast(unit_cost as decimal(18,4)) as unit_cost) from movements),
signed as (select *, case when movement_type = 2 then -quantity else quantity end as delta,
  cast(case when movement_type in (1,3) and quantity > 0 then quantity else 0 end as decimal(18,4)) as supply,
  cast(case when movement_type = 2 then quantity when movement_type = 3 and quantity < 0 then -quantity else 0 end as decimal(18,4)) as demand,
  row_number() over (partition by sku, location_id order by sequence_engine_key, event_id) as rn from typed)"""

WALK = """walk(sku, location_id, rn, on_hand, ok) as (
 select sku, location_id, rn, cast(case when demand > 0 then 0 else supply end as decimal(28,4)), demand = 0 from signed where rn = 1
 union all
 select s.sku, s.location_id, s.rn, cast(case when s.demand > w.on_hand then w.on_hand else w.on_hand + s.supply - s.demand end as decimal(28,4)), s.demand <= w.on_hand
 from walk w join signed s on s.sku = w.sku and s.location_id = w.location_id and s.rn = w.rn + 1)"""

LEDGER = """accepted as (select s.* from signed s join walk w on s.sku = w.sku and s.location_id = w.location_id and s.rn = w.rn where w.ok),
spans as (select *, sum(supply) over k as s_hi, sum(demand) over k as d_hi from accepted
  window k as (partition by sku, location_id order by sequence_engine_key, event_id rows unbounded preceding)),
allocations as (select l.sku, l.location_id, l.event_id as lot_id, d.event_id as consumption_id, l.unit_cost,
  least(l.s_hi, d.d_hi) - greatest(l.s_hi - l.supply, d.d_hi - d.demand) as taken
  from spans l join spans d on l.sku = d.sku and l.location_id = d.location_id and l.supply > 0 and d.demand > 0
  and l.s_hi - l.supply < d.d_hi and d.d_hi - d.demand < l.s_hi),
cogs as (select sku, location_id, consumption_id, sum(cast(taken as decimal(18,4)) * unit_cost) as cogs from allocations group by all),
facts as (select s.*, coalesce(c.cogs, 0) as cogs, sum(supply - demand) over k as qty_on_hand,
  sum(cast(supply * unit_cost as decimal(38,8)) - coalesce(c.cogs, 0)) over k as fifo_total_value
  from spans s left join cogs c on s.sku = c.sku and s.location_id = c.location_id and s.event_id = c.consumption_id
  window k as (partition by s.sku, s.location_id order by sequence_engine_key, event_id rows unbounded preceding))"""


def with_movements(tail: str) -> str:
    return f"with {MOVEMENTS} {tail}"


def with_ledger(tail: str) -> str:
    return f"with recursive {MOVEMENTS}, {TYPED}, {WALK}, {LEDGER} {tail}"


#: The ledger in order of arrival, one arrival of every key a round: the log in order of sequence, the lots that are left,
#: and what the arrival did. Quantities and costs are in ten-thousandths. A restatement replays the whole log.
ARRIVALS = """arrivals as (select event_id as id, sku, location_id, sequence_engine_key as seq, movement_type as kind, cast(cast(quantity as decimal(18,4)) * 10000 as bigint) as q,
  cast(cast(unit_cost as decimal(18,4)) * 10000 as bigint) as c, published_at - occurred_at > interval 30 day as stale,
  row_number() over (partition by sku, location_id order by published_at, sequence_engine_key, event_id) as rn from movements),
walk(sku, location_id, rn, log, lots, ok, how, id, seq, delta, cogs, need, held, worth) as (
 select distinct sku, location_id, cast(0 as bigint), cast([] as struct(seq bigint, id varchar, up bigint, down bigint, c bigint, delta bigint)[]), cast([] as struct(seq bigint, id varchar, rem bigint, c bigint)[]),
  false, cast(null as varchar), cast(null as varchar), cast(null as bigint), cast(null as bigint), cast(null as hugeint), cast(null as bigint), cast(null as hugeint), cast(null as hugeint) from arrivals
 union all
 select sku, location_id, rn, case when ok then log2 else log end, case when not ok then lots when how = 'restated' then replayed else after end, ok, how, id, seq, delta, cogs, down,
  cast(list_sum(list_transform(after, lambda x: x.rem)) as hugeint), cast(list_sum(list_transform(after, lambda x: cast(x.rem as hugeint) * x.c)) as hugeint)
 from (select *, case when how = 'restated' then feasible else down <= on_hand end as ok,
   list_sort(list_filter(case when up > 0 then list_append(left_over, {'seq': seq, 'id': id, 'rem': up, 'c': c}) else left_over end, lambda x: x.rem > 0)) as after,
   cast(coalesce(list_sum(list_transform(list_zip(lots, left_over), lambda x: cast(x[1].rem - x[2].rem as hugeint) * x[1].c)), 0) as hugeint) as cogs,
   list_filter(list_transform(range(1, len(log2) + 1), lambda i: {'seq': log2[i].seq, 'id': log2[i].id, 'rem': cast(greatest(0, ups[i] - greatest(ups[i] - log2[i].up, downs[-1])) as bigint), 'c': log2[i].c}), lambda x: x.rem > 0) as replayed
  from (select *, coalesce(list_bool_and(list_transform(range(1, len(log2) + 1), lambda i: log2[i].down = 0 or downs[i] <= ups[i])), true) as feasible,
    list_transform(range(1, len(lots) + 1), lambda i: {'seq': lots[i].seq, 'id': lots[i].id, 'rem': cast(greatest(0, his[i] - greatest(his[i] - lots[i].rem, down)) as bigint), 'c': lots[i].c}) as left_over
   from (select *, list_transform(range(1, len(log2) + 1), lambda i: cast(list_sum(list_transform(log2[1:i], lambda x: x.up)) as bigint)) as ups,
     list_transform(range(1, len(log2) + 1), lambda i: cast(list_sum(list_transform(log2[1:i], lambda x: x.down)) as bigint)) as downs,
     list_transform(range(1, len(lots) + 1), lambda i: cast(list_sum(list_transform(lots[1:i], lambda x: x.rem)) as bigint)) as his,
     cast(coalesce(list_sum(list_transform(lots, lambda x: x.rem)), 0) as bigint) as on_hand
    from (select *, case when how <> 'adjusted' and kind = 2 then 0 else greatest(q, 0) end as up, case when how = 'adjusted' or kind = 3 then greatest(-q, 0) when kind = 2 then q else 0 end as down,
      case when kind = 2 and how <> 'adjusted' then -q else q end as delta,
      list_sort(list_append(log, {'seq': seq, 'id': id, 'up': case when kind = 2 then 0 else greatest(q, 0) end, 'down': case when kind = 2 then q when kind = 3 then greatest(-q, 0) else 0 end, 'c': c, 'delta': case when kind = 2 then -q else q end})) as log2
     from (select a.*, w.log, w.lots, case when coalesce(a.seq < list_max(list_transform(w.lots, lambda x: x.seq)), false) then case when a.stale then 'adjusted' else 'restated' end else 'appended' end as how
      from walk w join arrivals a on a.sku = w.sku and a.location_id = w.location_id and a.rn = w.rn + 1)))))),
replays as (select sku, location_id, max(rn) as rn from walk where ok and how = 'restated' group by all),
logged as (select sku, location_id, unnest(log, recursive := true) from walk join replays using (sku, location_id, rn)),
summed as (select *, sum(up) over k as s_hi, sum(down) over k as d_hi, sum(cast(up as hugeint) * c) over k as paid from logged window k as (partition by sku, location_id order by seq, id rows unbounded preceding)),
costs as (select d.sku, d.location_id, d.id, sum(cast(least(s.s_hi, d.d_hi) - greatest(s.s_hi - s.up, d.d_hi - d.down) as hugeint) * s.c) as cogs
 from summed s join summed d on s.sku = d.sku and s.location_id = d.location_id and s.up > 0 and d.down > 0 and s.s_hi - s.up < d.d_hi and d.d_hi - d.down < s.s_hi group by all),
last_facts as (select s.sku, s.location_id, s.id, s.seq, 'restated' as outcome, delta, coalesce(cogs, 0) as cogs, down as need, s_hi - d_hi as held, paid - sum(coalesce(cogs, 0)) over (partition by s.sku, s.location_id order by seq, s.id rows unbounded preceding) as worth
  from summed s left join costs c on s.sku = c.sku and s.location_id = c.location_id and s.id = c.id
 union all select w.sku, w.location_id, w.id, w.seq, how, delta, cogs, need, coalesce(held, 0), coalesce(worth, 0) from walk w left join replays r using (sku, location_id) where ok and w.rn > coalesce(r.rn, 0))"""
