"""Screens, title families and article-target matches, over the driver's tables and literal cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import screens as S
from sigloom.functions import text as T
from sigloom.operators.titles import title_families
from sigloom.plans.base import query, table
from sigloom.plans.texts import _HOST, _NORM, _PATH, _any, _under
from sigloom.sources import cases
from sigloom.sources.bind import ARTICLES, articles

_ITEMS = cases.values("case_item", cases.ITEMS, cases.ITEM)
_PLAIN = lambda p: p.replace("'", "''")
_SUB = f"regexp_extract(coalesce(url, ''), '(?i){S.SUBREDDIT}', 1)"


@query(f"""with {ARTICLES}, {_ITEMS}, item as (select id, title, content, url, tier, (id % 11)::int as age, 7 as max_days from article union all select * from case_item),
p as (select *, {_SUB} as sub, lower(title || ' ' || content) as both_, {_HOST.format(u='url')} as h, {_PATH.format(u='url')} as p from item),
s as (select *, regexp_matches(title, '{T.MARKET_TAG}') or regexp_matches(title, '{T.HAVE_WANT}')
    or list_has_any(string_split(regexp_replace(lower(regexp_replace(sub, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[_\\d]+', '_', 'g'), '_'), {list(S.PROMO_WORDS)}) or {_any('lower(sub)', S.PROMO_SUBSTRINGS)} as promotional,
  length(trim(content)) < 80 and (trim(title) = '' or regexp_matches(title, '{T.VERSION_ONLY}')) as contentless,
  regexp_matches(title, '{_PLAIN(S.SELF_LAUNCH)}') and not (regexp_matches(title, '{S.VENDOR_EVENT}') and regexp_matches(title, '{S.VENDOR_TOKEN}')) as self_launch,
  {_any('both_', T.AMBIGUOUS)} and not {_any('both_', S.DISAMBIGUATORS)} as ambiguous,
  regexp_matches(title, '{S.HOUSEKEEPING}') or regexp_matches(title, '{S.RECURRING}') or regexp_matches(title, '{S.JOBS}') as housekeeping,
  coalesce(max_days > 0 and age > max_days, false) as too_old,
  not coalesce(tier in ('primary', 'curated'), false) or ({_under('h', T.CODE_HOSTS)} and not {_any('p', T.OFFICIAL_PATHS)}) as screened from p)
select id, promotional, contentless, self_launch, lower(sub) like 'u\\_%' escape '\\' and (self_launch or contentless) as profile_post, ambiguous, housekeeping, too_old, screened,
  too_old or (screened and (promotional or contentless or self_launch or ambiguous or housekeeping)) as dropped from s""")
def editorial_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every screen of every item, whether the screens apply to it, and whether it is dropped."""
    age = (F.col("id") % 11).cast("int")
    rows = articles(spark, sf_dir).select("id", "title", "content", "url", "tier", age.alias("age"), F.lit(7).alias("max_days"))
    rows = rows.union(cases.literal(spark, cases.ITEMS, cases.ITEM))
    title, content, url = F.col("title"), F.col("content"), F.col("url")
    found = rows.select(
        "id", S.promotional(title, url).alias("promotional"), T.contentless(title, content).alias("contentless"), S.self_launch(title).alias("self_launch"),
        S.low_value_profile(title, content, url).alias("profile_post"), S.ambiguous(title, content).alias("ambiguous"), S.housekeeping(title).alias("housekeeping"),
        S.too_old(F.col("age"), F.col("max_days")).alias("too_old"), S.screened(F.col("tier"), url).alias("screened"),
    )
    any_ = F.col("promotional") | F.col("contentless") | F.col("self_launch") | F.col("ambiguous") | F.col("housekeeping")
    return found.withColumn("dropped", F.col("too_old") | (F.col("screened") & any_))


_SIGNALS = f"list_sort(list_distinct(list_concat(regexp_extract_all(lower(coalesce(title, '')), '{T.VERSION}'), regexp_extract_all(lower(coalesce(title, '')), '{T.DATEISH}'))))"
_TITLED = f"""{cases.values("case_title", cases.TITLED, cases.TITLE)}, titled as (select * from case_title union all select source, doc_id::int, lang, trim(regexp_extract(text, '^[^\\n.]*')) from documents),
w as (select thread, no, publisher, {_NORM.format(t="coalesce(title, '')")} as norm, {_SIGNALS} as signals from titled),
m as (select *, list_filter(string_split(norm, ' '), lambda x: len(x) > 1) as tokens from w)"""


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.regexp_extract("text", r"^[^\n.]*", 0))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("thread"), F.col("doc_id").cast("int").alias("no"), F.col("lang").alias("publisher"), title.alias("title"))
    return cases.literal(spark, cases.TITLED, cases.TITLE).union(docs)


@query(f"""with {_TITLED}, c as (select thread, signals, list_distinct(tokens) as t, min(no) as no from m where norm <> '' and len(tokens) >= 3 group by thread, norm, signals, tokens),
l as (select thread, list({{'s': array_to_string(signals, ' '), 't': t}} order by no) as l from c group by 1),
near as (select thread, len(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: case when len(list_filter(acc, lambda r: r.s = x[1].s
   and len(list_intersect(r.t, x[1].t)) >= 0.8 * (len(r.t) + len(x[1].t) - len(list_intersect(r.t, x[1].t))))) > 0 then acc else list_concat(acc, x) end)) as n from l),
thin as (select thread, count(*) as n from m where norm = '' or len(tokens) < 3 group by 1),
pubs as (select thread, count(distinct publisher) as publishers from m group by 1)
select thread, publishers, (coalesce(near.n, 0) + coalesce(thin.n, 0))::bigint as families, least(publishers, coalesce(near.n, 0) + coalesce(thin.n, 0))::bigint as sources
from pubs left join near using (thread) left join thin using (thread)""")
def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers and title families of each thread: the fewer of them are its independent sources."""
    rows = _titled(spark, sf_dir)
    pubs = rows.groupBy("thread").agg(F.countDistinct("publisher").alias("publishers"))
    return pubs.join(title_families(rows), "thread").select("thread", "publishers", "families", F.least("publishers", "families").alias("sources"))


#: Characters of a text in which a target may be named, and of its lead in which it must be.
BODY, LEAD = 20_000, 600
_LONG = "list_filter(string_split_regex(lower(text), '[^0-9a-z]+'), lambda w: len(w) >= 7 and regexp_matches(w, '^[a-z]+$'))"
_TARGETS = f"""tgt as (select item_id as target_id, (list_distinct_ordered)[1:2] as aliases, (list_distinct_ordered)[3] as ignored, case when item_id % 10 = 0 then 'src' || (item_id // 10) % 20 || '.example' end as domain
from (select item_id, list_filter({_LONG}, lambda w, i: list_position({_LONG}, w) = i) as list_distinct_ordered from benchmark))"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as targets: the first two long words are aliases, the third is to be ignored in titles, and some
    have an official domain."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^0-9a-z]+", -1), lambda w: (F.length(w) >= 7) & w.rlike("^[a-z]+$")))
    domain = F.when(F.col("item_id") % 10 == 0, F.concat(F.lit("src"), F.expr("cast((item_id div 10) % 20 as string)"), F.lit(".example")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target_id"), F.slice(words, 1, 2).alias("aliases"), F.get(words, F.lit(2)).alias("ignored"), domain.alias("domain"))


@query(f"""with {ARTICLES}, {_TARGETS}, a as (select target_id, unnest(aliases) as alias from tgt),
w as (select id, 0 as part, unnest(list_distinct(string_split_regex(lower(title), '[^0-9a-z]+'))) as alias from article union all
  select id, 1, unnest(list_distinct(string_split_regex(lower(substr(content, 1, {BODY})), '[^0-9a-z]+'))) from article union all
  select id, 2, unnest(list_distinct(string_split_regex(lower(substr(content, 1, {LEAD})), '[^0-9a-z]+'))) from article),
h as (select id, target_id, count(*) filter (part = 0) > 0 as in_title, count(distinct case when part = 1 then alias end) as n_body, count(*) filter (part = 2) > 0 as in_lead from w join a using (alias) group by 1, 2),
d as (select id, target_id, true as official from article join tgt on regexp_extract(url, '//([^/]*)', 1) = domain or regexp_extract(url, '//([^/]*)', 1) like '%.' || domain),
b as (select id, target_id, coalesce(official, false) as official, coalesce(in_title, false) as in_title, coalesce(n_body, 0)::bigint as n_body, coalesce(in_lead, false) as in_lead from h full join d using (id, target_id))
select b.*, official or (not coalesce(contains(lower(title), ignored), false) and (in_title or (n_body >= 2 and in_lead))) as matched from b join tgt using (target_id) join article using (id)""")
def target_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an article is about a target: by an official domain, else not if its title holds an ignored term, else by
    an alias in the title, else by two aliases in the body of which one stands in the lead.

    Words and domains meet aliases and domains by equal joins; only pairs that meet are judged."""
    rows, targets = articles(spark, sf_dir), _targets(spark, sf_dir)
    aliases = targets.select("target_id", F.explode("aliases").alias("alias"))
    words = lambda c: F.array_distinct(F.split(F.lower(c), "[^0-9a-z]+", -1))
    parts = [F.struct(F.lit(k).alias("part"), words(c).alias("words")) for k, c in enumerate((F.col("title"), F.substring("content", 1, BODY), F.substring("content", 1, LEAD)))]
    spoken = rows.select("id", F.explode(F.array(*parts)).alias("p")).select("id", "p.part", F.explode("p.words").alias("alias"))
    part = F.col("part")
    hits = spoken.join(aliases, "alias").groupBy("id", "target_id").agg(
        F.bool_or(part == 0).alias("in_title"), F.countDistinct(F.when(part == 1, F.col("alias"))).alias("n_body"), F.bool_or(part == 2).alias("in_lead"),
    )
    labels = F.split(T.host(F.col("url")), r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))
    hosts = rows.select("id", labels.alias("labels")).select("id", F.explode(above).alias("domain"))
    official = hosts.join(targets.where("domain is not null").select("target_id", "domain"), "domain").select("id", "target_id", F.lit(True).alias("official"))
    no = F.lit(False)
    both = hits.join(official, ["id", "target_id"], "full").select("id", "target_id", F.coalesce("official", no).alias("official"), F.coalesce("in_title", no).alias("in_title"), F.coalesce("n_body", F.lit(0)).alias("n_body"), F.coalesce("in_lead", no).alias("in_lead"))
    both = both.join(targets.select("target_id", "ignored"), "target_id").join(rows.select("id", F.lower("title").alias("low")), "id")
    ignored = F.coalesce(F.col("low").contains(F.col("ignored")), no)
    matched = F.col("official") | (~ignored & (F.col("in_title") | ((F.col("n_body") >= 2) & F.col("in_lead"))))
    return both.select("id", "target_id", "official", "in_title", "n_body", "in_lead", matched.alias("matched"))
