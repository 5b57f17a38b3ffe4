"""Mixing sources to target weights with equal-token blocks and Sainte-Lague apportionment.

Targets. Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``scale`` of all words; a target
stops at ``most`` times its source's words and the excess is shared anew by weight.

Cells. A source is dealt by a hash of doc_id into cells of about ``cell_words`` words, so a hot source is many cells.
Inside a cell the documents stand in a seeded order and the words are cut into blocks of equal size, at most
``block_words``. Each cell belongs to one shard of the mix.

Quotas. The seats of a shard are its cells' wanted blocks, rounded once. Seats go to cells by the highest quotients
wanted / (2 k + 1). Seats that must be won or lost are known from a bound on the divisor, so that only a few quotients a
cell are ranked; the outcome is that of ranking all. A cell at its ceiling takes every block ``most`` times.

Selection. A cell with q seats takes each block q div n times, and once more a run of q mod n blocks from a seeded
start. The order of documents is itself seeded, so a run is a random sample of documents of which two at most are cut.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.arrow import only
from lotflow.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"


def _number(text: str, first: int = 1) -> str:
    """SQL of a whole number below 16^8 from the md5 of a SQL string."""
    return f"cast(conv(substr(md5({text}), {first}, 8), 16, 10) as bigint)"


def _size(text: str) -> F.Column:
    return F.coalesce(F.expr(f"regexp_count({text}, r'{WORD}')").cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, scale: float = 1.5, most: int = 2) -> DataFrame:
    """``sources(key, source, total)`` with the target of each: one row a source, ranked as one small table."""
    placed = (
        sources.withColumn("place", F.expr("row_number() over (order by source asc nulls last)"))
        .withColumn("weight", F.expr("element_at(array(3, 1, 2), cast((place - 1) % 3 as int) + 1)"))
        .withColumn("ceiling", F.expr(f"{most} * total"))
        .withColumn("ratio", F.expr("cast(ceiling as double) / weight"))
        .withColumn("before", F.expr("sum(ceiling) over (order by ratio, place) - ceiling"))
        .withColumn("lighter", F.expr("sum(weight) over (order by ratio, place) - weight"))
        .withColumn("level", F.expr(f"({scale}D * sum(total) over () - before) / (sum(weight) over () - lighter)"))
    )
    # in order of ratio, the first source that stays below its ceiling sets the line for all that do
    return placed.withColumn("line", F.expr("min(case when ratio > level then struct(ratio, place, level) end) over ()").getField("level")).select(
        "key", "total", F.expr("case when line is null or ratio <= level then cast(ceiling as double) else weight * line end").alias("target")
    )


def mix(docs: DataFrame, scale: float = 1.5, most: int = 2, block_words: int = 64, cell_words: int = 1 << 20, seed: int = 7, few_sources: int = 20_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, and two word ranges) for every row of ``docs``.

    ``docs(doc_id, text, source)``; other columns are ignored. The table of sources is broadcast if it has
    no more than ``few_sources`` rows, else joined. taken = copies x size + the lengths of the
    ranges [first_from, first_to) and [second_from, second_to). A null text has size 0; a document of size 0 takes
    nothing. A null source is a source of its own, after all others. Equal rows are placed one after the other, so the
    result is the same on every run. An empty table gives an empty result.
    """
    sized = (
        only(docs, "doc_id", "text", "source")
        .withColumn("size", _size("text"))
        .withColumn("key", F.expr("case when source is null then 'n' else concat('s', source) end"))
        .select("doc_id", "source", "size", "key")
    )
    sized = cut(sized)
    sources = targets(sized.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("total")), scale, most)
    sources = cut(
        sources.withColumn("cells", F.expr(f"greatest(1L, cast(ceil(total / {cell_words}D) as bigint))"))
        .withColumn("shards", F.expr("max(cells) over ()"))
        .withColumn("rate", F.expr("case when total > 0 then target / total else 0D end"))
    )
    if sources.count() <= few_sources:
        sources = F.broadcast(sources)
    hashed = (
        sized.where("size > 0")
        .join(sources, "key")
        .withColumn("h", F.expr(f"md5(concat('{seed}-doc-', coalesce(cast(doc_id as string), '')))"))
        .withColumn("cell", F.expr("cast(conv(substr(h, 17, 8), 16, 10) as bigint) % cells"))
        .repartition("key", "cell")  # not by source alone: a hot source is many cells
    )
    placed = hashed.withColumn("stop", F.expr("sum(size) over (partition by key, cell order by h, doc_id, size rows unbounded preceding)"))
    cells = (
        hashed.groupBy("key", "cell")
        .agg(F.sum("size").alias("words"), F.first("rate").alias("rate"), F.first("shards").alias("shards"))
        .withColumn("n", F.expr(f"cast(ceil(words / {block_words}D) as bigint)"))
        .withColumn("shard", F.expr(f"({_number(f"concat('{seed}-shard-', key)")} + cell) % shards"))
        .withColumn("want", F.expr("cast(floor(rate * n * 1000 + 0.5D) as bigint)"))
        .withColumn("start", F.expr(f"{_number(f"concat('{seed}-start-', key, '-', cell)")} % n"))
    )
    free = (
        cells.where(f"rate < {most}")
        .withColumn("all_want", F.expr("sum(want) over (partition by shard)"))
        .withColumn("slack", F.expr("case when all_want > 0 then (count(*) over (partition by shard) + 1) * 1000 / (2D * all_want) else 0D end"))
        .withColumn("sure", F.expr("greatest(0L, cast(floor(want / 1000D * (1 - slack) - 0.5D) as bigint) - 1)"))
        .withColumn("reach", F.expr(f"least({most} * n, cast(ceil(want / 1000D * (1 + slack) + 0.5D) as bigint) + 1)"))
        .withColumn("open", F.expr("cast(floor((all_want + 500) / 1000) as bigint) - sum(sure) over (partition by shard)"))
    )
    ranked = (
        free.withColumn("k", F.expr("explode(case when reach > sure then sequence(sure, reach - 1) else array(cast(null as bigint)) end)"))
        .withColumn("quotient", F.expr("want / (2D * k + 1)"))
        .withColumn("rank", F.expr("row_number() over (partition by shard order by quotient desc nulls last, key, cell, k)"))
        .groupBy("key", "cell")
        .agg((F.first("sure") + F.count_if(F.expr("k is not null and want > 0 and rank <= open"))).alias("won"))
    )
    quota = (
        cells.join(ranked, ["key", "cell"], "left")
        .withColumn("q", F.expr(f"coalesce(won, {most} * n)"))
        .select("key", "cell", "words", F.expr("q div n").alias("copies"), "start", "n", F.expr("q % n").alias("run"))
        .select(
            "key", "cell", "copies",
            F.expr("floor(start * words / n)").alias("f1"), F.expr("floor(least(start + run, n) * words / n)").alias("t1"),
            F.expr("floor(greatest(start + run - n, 0L) * words / n)").alias("t2"),
        )
    )
    span = lambda a, b: (F.expr(f"least(greatest({a} - (stop - size), 0L), size)"), F.expr(f"least(greatest({b} - (stop - size), 0L), size)"))
    (a1, b1), (a2, b2) = span("f1", "t1"), span("0L", "t2")
    taken = (
        placed.join(quota, ["key", "cell"])
        .select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", "copies", a1.alias("first_from"), b1.alias("first_to"), a2.alias("second_from"), b2.alias("second_to"))
        .withColumn("taken", F.expr("copies * size + (first_to - first_from) + (second_to - second_from)"))
    )
    empty = sized.where("size = 0").join(sources, "key").select(
        "doc_id", "source", "size", F.col("total").alias("source_size"), "target", *[F.lit(0).cast("long").alias(c) for c in ("copies", "first_from", "first_to", "second_from", "second_to")], F.lit(0).cast("long").alias("taken")
    )
    return taken.unionByName(empty)


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and once more the words of its partial range.

    Returns the columns of ``docs``, whatever their names; a cut text keeps its words, joined by single spaces, and
    n_chars follows it. The mix is made of ids and sizes; whole rows are shuffled once, to meet what is taken of them.
    Rows alike in id, source and size take their shares in any order; rows odd in other ways fare as in ``mix``.
    """
    name = F.to_json(F.struct("doc_id", "source", "size")).alias("name")
    take = F.struct("copies", "first_from", "first_to", "second_from", "second_to")
    shares = mix(docs, **params).where("taken > 0").groupBy(name).agg(F.array_sort(F.collect_list(take)).alias("shares"))
    fields = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"))
    named = rows.select("row", F.to_json(F.struct(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), _size("row.text").alias("size"))).alias("name"))
    met = named.join(shares, "name").withColumn("place", F.expr("row_number() over (partition by name order by name)")).withColumn("t", F.expr("get(shares, place - 1)")).where("t is not null")
    words = f"regexp_extract_all(row.text, r'{WORD}', 0)"
    part = f"array_join(transform(array({words}), w -> concat_ws(' ', slice(w, cast(t.second_from as int) + 1, cast(t.second_to - t.second_from as int)), slice(w, cast(t.first_from as int) + 1, cast(t.first_to - t.first_from as int)))), '')"
    cut_text = f"case when t.second_to - t.second_from + t.first_to - t.first_from = 0 then array() else array({part}) end"
    texts = met.withColumn("text", F.explode(F.expr(f"concat(array_repeat(row.text, cast(t.copies as int)), {cut_text})")))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in fields:
        whole = F.expr("text = row.text")
        row = row.withField("n_chars", F.when(whole, F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return texts.select(row.alias("row")).select("row.*")


ORACLE = r"""
with sized as (
  select doc_id, source, case when source is null then 'n' else 's' || source end as key,
    cast(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    md5('7-doc-' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
totals as (select key, max(source) as source, cast(sum(size) as bigint) as total from sized group by key),
placed as (select *, row_number() over (order by source asc nulls last) as place from totals),
weighed as (select *, [3, 1, 2][1 + (place - 1) % 3] as weight, 2 * total as ceiling from placed),
ratios as (select *, cast(ceiling as double) / weight as ratio from weighed),
levels as (select *, (1.5::double * (sum(total) over ())::double - (sum(ceiling) over (order by ratio, place) - ceiling)::double)
  / (sum(weight) over () - (sum(weight) over (order by ratio, place) - weight))::double as level from ratios),
lined as (select *, (select arg_min(level, ratio * 1000000 + place) from levels where ratio > level) as line from levels),
aimed as (select key, total, case when line is null or ratio <= level then cast(ceiling as double) else weight * line end as target,
  greatest(1, cast(ceil(total / 1048576.0::double) as bigint)) as cells from lined),
sources as (select *, max(cells) over () as shards, case when total > 0 then target / total else 0 end as rate from aimed),
docs as (select d.doc_id, d.size, d.h, s.*, cast('0x' || substr(d.h, 17, 8) as bigint) % s.cells as cell
  from sized d join sources s on d.key = s.key),
stops as (select *, cast(sum(size) over (partition by key, cell order by h, doc_id, size rows unbounded preceding) as bigint) as stop from docs where size > 0),
cells0 as (select key, cell, cast(sum(size) as bigint) as words, any_value(rate) as rate, any_value(shards) as shards from docs where size > 0 group by key, cell),
cells1 as (select *, cast(ceil(words / 64.0::double) as bigint) as n from cells0),
cells2 as (select *, (cast('0x' || substr(md5('7-shard-' || key), 1, 8) as bigint) + cell) % shards as shard,
  cast(floor(rate * n * 1000 + 0.5::double) as bigint) as want,
  cast('0x' || substr(md5('7-start-' || key || '-' || cell), 1, 8) as bigint) % n as start from cells1),
seats as (select shard, cast(sum(want) as bigint) as all_want, (cast(sum(want) as bigint) + 500) // 1000 as open from cells2 where rate < 2 group by shard),
quotients as (select c.key, c.cell, row_number() over (partition by c.shard order by c.want / (2.0::double * k + 1) desc, c.key, c.cell, k) as rank, s.open
  from cells2 c join seats s on c.shard = s.shard, unnest(range(0, 2 * c.n)) as t(k) where c.rate < 2 and c.want > 0),
won as (select key, cell, count(*) as won from quotients where rank <= open group by key, cell),
quota as (select c.*, case when c.rate < 2 then coalesce(w.won, 0) else 2 * c.n end as q from cells2 c left join won w on c.key = w.key and c.cell = w.cell),
runs as (select key, cell, q // n as copies, (start * words) // n as f1, (least(start + q % n, n) * words) // n as t1,
  (greatest(start + q % n - n, 0) * words) // n as t2 from quota)
select s.doc_id, s.size, s.total as source_size, s.target, cast(r.copies * s.size
  + least(greatest(r.t1 - (s.stop - s.size), 0), s.size) - least(greatest(r.f1 - (s.stop - s.size), 0), s.size)
  + least(greatest(r.t2 - (s.stop - s.size), 0), s.size) as bigint) as taken
from stops s join runs r on s.key = r.key and s.cell = r.cell
union all
select doc_id, size, total, target, cast(0 as bigint) from docs where size = 0
"""
