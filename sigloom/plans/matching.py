"""Targets and articles, relations, emergent sources, route planning, clustering and the probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.functions import vectors as V
from sigloom.operators.clustering import arrival_threads
from sigloom.operators.main_text import main_texts
from sigloom.operators.pages import readable_pages, unified_diffs
from sigloom.operators.probe import apply_probe, changes, train_targets
from sigloom.plans.base import query, table
from sigloom.sources.bind import ARTICLES, articles
from sigloom.sources.folders import new_folder

_ALIASES = "al as (select item_id as target_id, lower(list_filter(regexp_split_to_array(text, '[^A-Za-zÀ-ÿ]+'), lambda w: len(w) >= 7)[1]) as alias from benchmark)"


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first long word of each benchmark item, as a target's alias."""
    words = F.filter(F.split("text", "[^A-Za-zÀ-ÿ]+", -1), lambda w: F.length(w) >= 7)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target_id"), F.lower(F.get(words, F.lit(0))).alias("alias")).where("alias is not null")


@query(f"""with {ARTICLES}, {_ALIASES}, w as (select distinct id, unnest(regexp_split_to_array(lower(title), '[^a-zà-ÿ]+')) as alias from article),
b as (select id, alias, i from (select id, unnest(regexp_split_to_array(lower(substr(content, 1, 20000)), '[^a-zà-ÿ]+')) as alias, 1 as i from article)),
bd as (select id, target_id, count(distinct b.alias) as n from b join al using (alias) group by 1, 2),
t as (select id, target_id, true as in_title from w join al using (alias) group by 1, 2)
select id, target_id, coalesce(in_title, false) as in_title, coalesce(n, 0)::bigint as n_body from t full join bd using (id, target_id)""")
def article_target_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that an article names, in its title or its body: whole words met by an equal join on the word, not by
    trying every alias on every text."""
    rows, aliases = articles(spark, sf_dir), _aliases(spark, sf_dir)
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), "[^a-zà-ÿ]+", -1)))
    title = rows.select("id", words(F.col("title")).alias("alias")).join(aliases, "alias").groupBy("id", "target_id").agg(F.lit(True).alias("in_title"))
    body = rows.select("id", words(F.substring("content", 1, 20000)).alias("alias")).join(aliases, "alias").groupBy("id", "target_id").agg(F.countDistinct("alias").alias("n_body"))
    return title.join(body, ["id", "target_id"], "full").select("id", "target_id", F.coalesce("in_title", F.lit(False)).alias("in_title"), F.coalesce("n_body", F.lit(0)).alias("n_body"))


@query("""with u as (select o_orderkey as thread_id, o_custkey as target_id, 0 as src from orders where o_orderstatus = 'F' union all select o_orderkey, o_custkey % 10, 1 from orders where o_orderkey % 3 = 0)
select thread_id, target_id, case min(src) when 0 then 'match' else 'route' end as source from u group by 1, 2""")
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of threads to targets; a match beats a route."""
    orders = table(spark, sf_dir, "orders")
    match = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("thread_id"), F.col("o_custkey").alias("target_id"), F.lit(0).alias("src"))
    route = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_custkey") % 10, F.lit(1))
    best = match.union(route).groupBy("thread_id", "target_id").agg(F.min("src").alias("src"))
    return best.select("thread_id", "target_id", F.when(F.col("src") == 0, "match").otherwise("route").alias("source"))


_VERDICT = "case l_linenumber % 3 when 0 then true when 1 then false end"


@query(f"with v as (select l_orderkey as thread_id, l_suppkey as target_id, {_VERDICT} as verdict from lineitem) select thread_id, min(target_id) as primary_target, count(*) as kept from v where verdict is distinct from false group by 1")
def primary_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest target that isn't rejected: no verdict keeps a relation."""
    verdict = F.when(F.col("l_linenumber") % 3 == 0, True).when(F.col("l_linenumber") % 3 == 1, False)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thread_id"), F.col("l_suppkey").alias("target_id"), verdict.alias("v")).where(~F.col("v").eqNullSafe(False))
    return rows.groupBy("thread_id").agg(F.min("target_id").alias("primary_target"), F.count("*").alias("kept"))


@query("""with shown as (select o_orderkey as thread_id from orders where o_orderkey % 2 = 0), named as (select o_orderkey as thread_id from orders where o_orderkey % 3 = 0)
select coalesce(s.thread_id, n.thread_id) as thread_id, case when n.thread_id is null then 'rejected' when s.thread_id is null then 'added' else 'confirmed' end as verdict from shown s full join named n on s.thread_id = n.thread_id""")
def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge was shown against what it named: a full join."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("thread_id"))
    shown, named = orders.where("thread_id % 2 = 0").withColumn("s", F.lit(1)), orders.where("thread_id % 3 = 0").withColumn("n", F.lit(1))
    return shown.join(named, "thread_id", "full").select("thread_id", F.when(F.col("n").isNull(), "rejected").when(F.col("s").isNull(), "added").otherwise("confirmed").alias("verdict"))


@query("""with m as (select s_nationkey as target_id, p_brand as value, l_orderkey as thread_id from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey)
select target_id, value, count(distinct thread_id) as threads from m group by 1, 2 having count(distinct thread_id) >= 6""")
def emergent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that recur in six threads of a target at least."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thread_id"), "l_suppkey", "l_partkey")
    rows = rows.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target_id")), "l_suppkey")
    rows = rows.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("value")), "l_partkey")
    return rows.groupBy("target_id", "value").agg(F.countDistinct("thread_id").alias("threads")).where("threads >= 6")


@query("""with s as (select p_brand as term, s_nationkey as target_id, count(*) as support from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by 1, 2)
select term, arg_max(target_id, (support, -target_id)) as target_id, max(support) as support from s group by 1""")
def contested_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term that several targets want goes to the one with most support, the first on ties."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    rows = rows.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target_id")), "l_suppkey")
    rows = rows.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("term")), "l_partkey")
    support = rows.groupBy("term", "target_id").agg(F.count("*").alias("support"))
    return support.groupBy("term").agg(F.max_by("target_id", F.struct("support", -F.col("target_id"))).alias("target_id"), F.max("support").alias("support"))


@query("select p_partkey, regexp_extract_all(lower(p_name || ' v1.' || p_size || ' and v2.' || (p_size % 7) || '.1'), 'v?\\d+(?:\\.\\d+)+') as versions from part")
def version_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions named beside an alias."""
    text = F.lower(F.concat("p_name", F.lit(" v1."), F.col("p_size").cast("string"), F.lit(" and v2."), (F.col("p_size") % 7).cast("string"), F.lit(".1")))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract_all(text, F.lit(T.VERSION), F.lit(0)).alias("versions"))


@query("select p_brand as anchor, max(p_size) as major, unnest(['v' || max(p_size) || '.' || (max(p_size) % 5 + 1), 'v' || (max(p_size) + 1)]) as probe from part group by 1")
def successor_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next minor and major version after the highest of each anchor."""
    top = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("anchor")).agg(F.max("p_size").alias("major"))
    minor = F.concat(F.lit("v"), F.col("major").cast("string"), F.lit("."), (F.col("major") % 5 + 1).cast("string"))
    return top.select("anchor", "major", F.explode(F.array(minor, F.concat(F.lit("v"), (F.col("major") + 1).cast("string")))).alias("probe"))


@query("""with ch as (select unnest(['news', 'forum', 'hn']) as channel, unnest([2, 3, 1]) as priority)
select p_partkey, channel, priority, channel || '-' || p_partkey as route_id, 'https://' || channel || '.example/search?q=' || replace(p_brand, '#', '%23') || '+when:7d' as url from part cross join ch""")
def route_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search routes of each keyword on every channel."""
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(p).alias("priority")) for c, p in (("news", 2), ("forum", 3), ("hn", 1))]))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", channels.alias("c")).select("p_partkey", "p_brand", "c.*")
    url = F.concat(F.lit("https://"), "channel", F.lit(".example/search?q="), F.replace("p_brand", F.lit("#"), F.lit("%23")), F.lit("+when:7d"))
    return rows.select("p_partkey", "channel", "priority", F.concat_ws("-", "channel", F.col("p_partkey").cast("string")).alias("route_id"), url.alias("url"))


_ROUTES = "r as (select l_orderkey as target_id, l_suppkey as grp, l_linenumber as priority, l_returnflag = 'N' as agg, l_linenumber as pos from lineitem)"


@query(f"""with {_ROUTES}, g as (select target_id, grp, min((agg::int * 100 + priority)) as rank, min(pos) as first from r group by 1, 2),
k as (select *, row_number() over (partition by target_id order by rank, first, grp) as place from g) select r.target_id, r.grp, r.pos from r join k using (target_id, grp) where place <= 2""")
def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the two best groups of each target: by rank of the group, not by route."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target_id"), F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "N").cast("int").alias("agg"))
    groups = line.groupBy("target_id", "grp").agg(F.min(F.col("agg") * 100 + F.col("pos")).alias("rank"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.partitionBy("target_id").orderBy("rank", "first", "grp"))
    return line.join(groups.withColumn("place", place).where("place <= 2").select("target_id", "grp"), ["target_id", "grp"]).select("target_id", "grp", "pos")


@query("""with s as (select c_custkey as target_id, r_regionkey as plan_id, (case when contains(upper(c_name || c_mktsegment), substr(r_name, 1, 1)) then 1 else 0 end + 3 * (case when n_regionkey = r_regionkey then 1 else 0 end)) as score
from customer join nation on n_nationkey = c_nationkey cross join region), k as (select *, row_number() over (partition by target_id order by score desc, plan_id desc) as place from s)
select target_id, plan_id, score, place::int as place from k where place <= 4""")
def fallback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best plans for each target by shared words and thrice by lexicon; plans are a handful."""
    plans = table(spark, sf_dir, "region").agg(F.collect_list(F.struct("r_regionkey", "r_name")).alias("plans"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey").crossJoin(F.broadcast(plans)).select("c_custkey", "c_name", "c_mktsegment", "n_regionkey", F.explode("plans").alias("p"))
    score = F.upper(F.concat("c_name", "c_mktsegment")).contains(F.substring("p.r_name", 1, 1)).cast("int") + 3 * (F.col("n_regionkey") == F.col("p.r_regionkey")).cast("int")
    rows = rows.select(F.col("c_custkey").alias("target_id"), F.col("p.r_regionkey").alias("plan_id"), score.alias("score"))
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("score"), F.desc("plan_id")))
    return rows.withColumn("place", place).where("place <= 4")


@query("select distinct c_custkey as target_id, lower(trim(t)) as term from (select c_custkey, unnest(string_split(c_name || ',' || c_mktsegment || ',' || c_mktsegment, ',')) as t from customer) where length(trim(t)) >= 3")
def targets_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each target, once each."""
    terms = F.array_distinct(F.transform(F.split(F.concat_ws(",", "c_name", "c_mktsegment", "c_mktsegment"), ",", -1), lambda t: F.lower(F.trim(t))))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), F.explode(F.filter(terms, lambda t: F.length(t) >= 3)).alias("term"))


@query("select page_id, regexp_extract(url, '^[a-z]+') || '-' || page_id % 7 as grp, least(greatest(page_id % 200, 1), 90)::bigint as warm_up, least(greatest(page_id * 3 % 2000, 5), 1440)::bigint as minutes from pages")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route's fallback group and the clamps on warm-up and interval."""
    clamp = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi)).cast("bigint")
    group = F.concat_ws("-", F.regexp_extract("url", "^[a-z]+", 0), (F.col("page_id") % 7).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", group.alias("grp"), clamp(F.col("page_id") % 200, 1, 90).alias("warm_up"), clamp(F.col("page_id") * 3 % 2000, 5, 1440).alias("minutes"))


@query("select doc_id, coalesce(quality, -1) as quality, case when quality = 1 then 'positive' when quality = 0 then 'negative' else 'background' end as label from documents left join labels using (doc_id)")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives, negatives and background for the probe."""
    label = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").otherwise("background")
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), label.alias("label"))


@query("select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1) union select doc_id from labels where quality = 0")
def pending_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has new content or has changed."""
    labels = table(spark, sf_dir, "labels")
    new = table(spark, sf_dir, "documents").select("doc_id").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return new.union(labels.where("quality = 0").select("doc_id")).distinct()


@query()
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of articles in order of arrival, on their mean-centred vectors, by the rule judge."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    mean = F.broadcast(V.mean_vector(vectors, "v"))  # one row, as long as a vector
    vectors = vectors.crossJoin(mean).select("id", V.unit(V.centred(F.col("v"), F.col("mean"))).alias("v"))
    return arrival_threads(articles(spark, sf_dir).select("id", "title").join(vectors, "id"))


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label and x, what a probe sees of a vector: mean-centred, of length one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    mean = F.broadcast(V.mean_vector(vectors, "v"))  # one row, as long as a vector
    return vectors.crossJoin(mean).select("id", "label", V.unit(V.centred(F.col("v"), F.col("mean"))).alias("x"))


def _targets_of(rows: DataFrame, *kept: str) -> DataFrame:
    """rows with each of ten targets."""
    return rows.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("target"), "id", *kept)


@query()
def probe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe for each of ten targets: its vectors against those of the others, mean-centred."""
    rows = _targets_of(_probed(spark, sf_dir), "label", "x").select("target", "id", (F.col("label") == F.col("target")).cast("int").alias("y"), "x")
    return train_targets(rows).select("target", "n", F.round("auc", 6).alias("auc"), "enabled")


@query()
def probe_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes fitted on the even vectors and used on the odd ones: what they change among the relations that a matcher
    made.  A target's are the vectors whose coordinate of its number is above the mean; the matcher takes every third.
    The models are written between fit and use."""
    rows = _probed(spark, sf_dir)
    at = f"{new_folder(spark, 'probes')}/models"
    labelled = _targets_of(rows.where("id % 2 = 0"), "x")
    train_targets(labelled.select("target", "id", (F.get("x", F.col("target").cast("int")) > 0).cast("int").alias("y"), "x")).write.parquet(at)
    models = spark.read.parquet(at)
    used = rows.where("id % 2 = 1")
    scores = apply_probe(used.select("id", "x"), models).select(F.col("id").alias("thread_id"), "target", "p")
    related = _targets_of(used).where((F.col("id") + F.col("target")) % 3 == 0)
    relations = related.select(F.col("id").alias("thread_id"), "target", F.lit("match").alias("source"), F.when(F.col("id") % 7 == 0, True).alias("verdict"))
    return changes(scores, models.where("enabled").select("target", "add_t", "veto_t"), relations).withColumn("score", F.round("score", 6))


@query()
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose of every page."""
    return readable_pages(table(spark, sf_dir, "pages"))


@query()
def unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added and dropped by every version of a monitor."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return unified_diffs(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("no"), before.alias("old"), F.col("text").alias("new")))


@query()
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page's best block."""
    return main_texts(table(spark, sf_dir, "pages"))
