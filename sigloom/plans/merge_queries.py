"""The merge pass, over vectors as threads of one article each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import vectors as V
from sigloom.operators import merging
from sigloom.plans.base import query, table
from sigloom.plans.vector_queries import _CENTRED
from sigloom.sources.bind import ARTICLES, articles
from sigloom.sources.folders import ready_checkpoints

#: These vectors are spread wide, so the queries take pairs from here on; the stand-in judge says event and story from here.
NEAR, EVENT, STORY = 0.30, 0.44, 0.36


def _judge(similarity: Column, a: Column, b: Column) -> Column:
    return F.when(similarity >= EVENT, "event").when(similarity >= STORY, "story").otherwise("different")


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread of one article for each vector: title, tier, publisher and time of the article of its number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("centroid"))
    mean = F.broadcast(V.mean_vector(vectors, "centroid"))  # one row, as long as a vector
    rows = vectors.crossJoin(mean).select("id", "centroid", V.unit(V.centred(F.col("centroid"), F.col("mean"))).alias("c")).join(articles(spark, sf_dir), "id")
    return rows.select(
        F.col("id").alias("thread_id"), "title", "centroid", "c", F.when(F.col("tier") == "primary", "CONFIRMED").otherwise("LEAD").alias("lifecycle"), F.col("created_at").alias("first_seen"),
        F.col("created_at").alias("last_update"), (F.col("tier") == "primary").alias("resonant"), F.when(F.col("tier") != "aggregated", F.col("title")).alias("summary"), F.lit(None).cast("bigint").alias("storyline_id"),
        F.lit(1).cast("bigint").alias("n"), (F.col("tier") == "aggregated").alias("rumor"), "publisher", "lang", "tier",
    )


def _pass(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Threads, and what a pass decides; pairs of one publisher count as judged before."""
    ready_checkpoints(spark)
    threads = _threads(spark, sf_dir).checkpoint()
    recent = merging.recent_threads(threads.select("thread_id", "c", "last_update", "publisher")).checkpoint()
    near = merging.similar(recent, "thread_id", "c", NEAR)  # a pass meets no pair of other threads
    who = recent.select("thread_id", "publisher")
    one, two = who.toDF("a", "pa"), who.toDF("b", "pb")
    judged = near.join(one, "a").join(two, "b").where("pa = pb").select("a", "b")
    pairs = merging.near_pairs(threads.select("thread_id", "c", "last_update"), judged, near=NEAR)
    return threads, merging.decide(pairs, threads, _judge).checkpoint()


_PASS = f"""with recursive {_CENTRED}, {ARTICLES},
th as (select u.vec_id as id, u.c, title, tier, publisher, lang, created_at from u join article on article.id = u.vec_id),
near as (select a.id as a, b.id as b, list_inner_product(a.c, b.c) as s, a.created_at <= b.created_at as first, a.tier = 'aggregated' and b.tier = 'aggregated' as rumor from th a join th b on a.id < b.id and a.publisher <> b.publisher
  where list_inner_product(a.c, b.c) >= {NEAR} and least(a.created_at, b.created_at) >= (select max(created_at) from th) - interval '{merging.WINDOW_HOURS} hours'),
pairs as (select *, row_number() over (order by s desc, a, b) as k, case when s >= {EVENT} then 'event' when s >= {STORY} then 'story' else 'different' end as said, case when first then a else b end as o, case when first then b else a end as y from near order by s desc, a, b limit {merging.PAIRS}),
w(k, gone, keep, lines, acts) as (
  select 0::bigint, []::bigint[], []::bigint[], map([]::bigint[], []::bigint[]), []::struct(k bigint, v varchar, keep bigint, gone bigint, linked bigint, line bigint)[]
  union all
  select k + 1, case when act.gone is null then gone else list_append(gone, act.gone) end, case when act.gone is null then keep else list_append(keep, act.keep) end,
    case when act.line is null then lines when act.linked is not null and act.line < 0 then map_concat(lines, map([act.linked, -1 - act.line], [act.line, act.line])) else map_concat(lines, map([coalesce(act.linked, act.keep)], [act.line])) end, case when act.v is null then acts else list_append(acts, act) end
  from (select w.*, case
      when list_contains(w.gone, p.a) or list_contains(w.gone, p.b) then null
      when said = 'event' then struct_pack(k := p.k, v := 'merged', keep := o, gone := y, linked := null::bigint, line := case when w.lines[o] is null then w.lines[y] end)
      when said = 'story' and w.lines[o] is not null and w.lines[y] is null then struct_pack(k := p.k, v := 'story', keep := null::bigint, gone := null::bigint, linked := y, line := w.lines[o])
      when said = 'story' and w.lines[o] is null and w.lines[y] is not null then struct_pack(k := p.k, v := 'story', keep := null::bigint, gone := null::bigint, linked := o, line := w.lines[y])
      when said = 'story' and w.lines[o] is null and w.lines[y] is null and rumor then struct_pack(k := p.k, v := 'story', keep := null::bigint, gone := null::bigint, linked := y, line := -1 - o)
      else struct_pack(k := p.k, v := said, keep := null::bigint, gone := null::bigint, linked := null::bigint, line := null::bigint) end as act
    from w join pairs p on p.k = w.k + 1) q),
acts as (select unnest(acts) as x from (select acts from w order by k desc limit 1)),
dec as (select p.a, p.b, s, x.v as verdict, x.keep, x.gone, x.linked, x.line from acts join pairs p on p.k = x.k),
ends(gone, keep) as (select gone, keep from dec where gone is not null union all select e.gone, d.keep from ends e join dec d on d.gone = e.keep),
fin as (select gone, keep from ends where keep not in (select gone from dec where gone is not null)),
part as (select th.*, coalesce(fin.keep, th.id) as thread_id, fin.keep is not null as moved from th left join fin on fin.gone = th.id)"""


@query(f"{_PASS} select a, b, round(s, 5) as similarity, verdict, keep, gone, linked, case when linked is not null or line is not null then line end as storyline from dec")
def merge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge pass says of the best pairs, in their order."""
    return _pass(spark, sf_dir)[1].select("a", "b", F.round("similarity", 5).alias("similarity"), "verdict", "keep", "gone", "linked", "storyline")


@query(f"""{_PASS}, v as (select part.thread_id, round(avg(e.embedding[1]::double), 6) as c1, round(avg(e.embedding[64]::double), 6) as c64 from part join embeddings e on e.vec_id = part.id group by 1)
select p.thread_id, count(*) as members, count(distinct publisher) as publishers, case when bool_or(tier = 'primary') then 'CONFIRMED' else 'LEAD' end as lifecycle, min(created_at) as first_seen, max(created_at) as last_update,
bool_or(tier = 'primary') as resonant, (list(title order by moved, created_at, id))[1] as title, (list(title order by moved, created_at, id) filter (tier <> 'aggregated'))[1] as summary, (count(*) - 1) as taken_in,
(select any_value(line) from dec where linked = p.thread_id or (linked is null and keep = p.thread_id) or (linked is not null and line = -1 - p.thread_id)) as storyline_id, any_value(c1) as c1, any_value(c64) as c64
from part p join v on v.thread_id = p.thread_id group by 1""")
def merge_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads after a merge pass."""
    threads, decisions = _pass(spark, sf_dir)
    members = threads.select("thread_id", F.col("thread_id").alias("id"), "publisher", F.lit(True).alias("processed"))
    found = merging.apply_merges(decisions, threads, members, threads.select("thread_id", F.col("lang").alias("target"), F.col("tier").alias("source")), threads.select("thread_id", F.col("tier").alias("reason")))
    at = lambda k: F.round(F.element_at("centroid", k), 6)
    return found.threads.drop("centroid").join(found.threads.select("thread_id", at(1).alias("c1"), at(64).alias("c64")), "thread_id")


@query(f"""{_PASS}, r as (select thread_id, lang, tier, row_number() over (partition by thread_id, lang order by moved, tier) as place from part)
select 'member' as kind, thread_id, id::varchar as what, case when moved then 'again' else 'done' end as state from part union all select 'relation', thread_id, lang, tier from r where place = 1 union all select 'alert', thread_id, tier, null from part""")
def merge_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, relations and alerts after a merge pass, each by the thread that it belongs to then."""
    threads, decisions = _pass(spark, sf_dir)
    members = threads.select("thread_id", F.col("thread_id").alias("id"), "publisher", F.lit(True).alias("processed"))
    found = merging.apply_merges(decisions, threads, members, threads.select("thread_id", F.col("lang").alias("target"), F.col("tier").alias("source")), threads.select("thread_id", F.col("tier").alias("reason")))
    rows = found.members.select(F.lit("member").alias("kind"), "thread_id", F.col("id").cast("string").alias("what"), F.when(F.col("processed"), "done").otherwise("again").alias("state"))
    rows = rows.union(found.relations.select(F.lit("relation"), "thread_id", "target", "source"))
    return rows.union(found.alerts.select(F.lit("alert"), "thread_id", "reason", F.lit(None).cast("string")))
