"""Rules of the desk: error kinds, cost categories, routes, gates, probe thresholds, vocabulary, profiles and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.functions import vectors as V
from sigloom.operators.probe import ADD_FLOOR, ADD_PRECISION, LEAST_FOUND, VETO_CEIL, VETO_RECALL, changes
from sigloom.plans import base, screen_queries
from sigloom.plans.base import query, table
from sigloom.plans.texts import _HOST, _PATH, _any
from sigloom.sources import cases
from sigloom.sources.bind import ARTICLES, THREADS, articles, members, threads

#: What an embedding's error says when it is fatal, and when it may be tried again.
FATAL = ("api key", "api_key", "unauthenticated", "permission", "401", "403", "invalid api", "not found", "invalid argument model")
TRANSIENT = ("429", "rate", "quota", "resource_exhausted", "exhausted", "timeout", "deadline", "unavailable", "503", "500", "internal")
ERRORS = [(-1, "401 Unauthenticated"), (-2, "API key not valid"), (-3, "429 quota"), (-4, "Deadline exceeded"), (-5, "content blocked"), (-6, None), (-7, "model not found; rate limited")]


@query(f"""with {cases.values("e", ERRORS, "id bigint, text string")}, a as (select * from e union all select event_id::bigint, 'HTTP ' || (400 + event_id % 110) || ' ' || event_type from events), l as (select id, lower(coalesce(text, '')) as m from a)
select id, case when {_any('m', FATAL)} then 'fatal' when {_any('m', TRANSIENT)} then 'transient' else 'item' end as kind from l""")
def embed_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an embedding's error ends the run, may be tried again, or is of one item only."""
    text = F.concat(F.lit("HTTP "), (400 + F.col("event_id") % 110).cast("string"), F.lit(" "), "event_type")
    rows = cases.literal(spark, ERRORS, "id bigint, text string").union(table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint"), text))
    low = F.lower(F.coalesce("text", F.lit("")))
    return rows.select("id", F.when(T.any_of(low, FATAL), "fatal").when(T.any_of(low, TRANSIENT), "transient").otherwise("item").alias("kind"))


#: How the names of actions begin, and what they are called on the bill.
CATEGORIES = (
    ("Embedding", "Embedding (向量)"), ("FactCheck", "Fusion (融合)"), ("TrendScan", "TrendScan (趋势)"), ("DailyBriefing", "DailyBriefing (简报)"),
    ("EventArbiter", "EventArbiter (事件仲裁)"), ("AlertSynthesis", "AlertSynthesis (告警合成)"), ("PortfolioPlan", "PortfolioPlan (规划)"),
)
ACTIONS = [(0, "Embedding batch"), (1, "FactCheck: a target"), (2, "TrendScan"), (3, "DailyBriefing"), (4, "EventArbiter"), (5, "AlertSynthesis"), (6, "PortfolioPlan: x"), (7, "VocabRefresh"), (8, ""), (9, None)]


@query(f"""with {cases.values("act", ACTIONS, "k bigint, action string")}, c as (select {"case " + " ".join(f"when starts_with(action, '{p}') then '{n}'" for p, n in CATEGORIES) + " else coalesce(nullif(action, ''), 'Other') end"} as category, floor(value)::bigint as tokens
  from events join act on event_id % 10 = k) select category, count(*) as calls, sum(tokens)::bigint as tokens from c group by 1""")
def usage_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens of each category of action."""
    actions = F.broadcast(cases.literal(spark, ACTIONS, "k bigint, action string"))  # ten rows
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 10).cast("bigint").alias("k"), F.floor("value").cast("bigint").alias("tokens")).join(actions, "k")
    named = F.coalesce(F.nullif("action", F.lit("")), F.lit("Other"))
    for prefix, name in reversed(CATEGORIES):
        named = F.when(F.col("action").startswith(prefix), name).otherwise(named)
    return rows.groupBy(named.alias("category")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


#: The service that makes feeds of profiles.
ROUTER = "https://rsshub.app"
#: Profiles and their routes, first match first; names on one host that are no profiles; ends of feeds.
ROUTES = (
    (r"space\.bilibili\.com/(\d+)", "/bilibili/user/video/"), (r"(?:twitter\.com|x\.com)/([^/]+)/?$", "/twitter/user/"), (r"weibo\.com/u/(\d+)", "/weibo/user/"), (r"youtube\.com/channel/([^/]+)", "/youtube/channel/"),
    (r"youtube\.com/(@[^/]+)", "/youtube/custom/"), (r"tiktok\.com/@+([^/@][^/]*)", "/tiktok/user/"), (r"xiaohongshu\.com/user/profile/([^/]+)", "/xiaohongshu/user/"),
)
NO_PROFILES = ("home", "explore", "notifications", "messages")
FEED_ENDS = (".xml", ".rss", ".atom")
PROFILES = [
    (-1, "https://space.bilibili.com/12345/video"), (-2, "https://x.com/someone/"), (-3, "https://x.com/home"), (-4, "https://x.com/someone/status/1"), (-5, "https://weibo.com/u/77"), (-6, "https://www.youtube.com/channel/UC9/videos"),
    (-7, "https://www.youtube.com/@maker"), (-8, "https://www.tiktok.com/@dancer/video/3"), (-9, "https://www.xiaohongshu.com/user/profile/5f?x=1"), (-10, ""), (-11, None), (-12, "https://example.org/Feed.XML?x=1"), (-13, "https://rsshub.app/any"),
]
_RESERVED = lambda p, r: f" and lower(regexp_extract(url, '{p}', 1)) not in {NO_PROFILES}" if r == "/twitter/user/" else ""
_ROUTED = " ".join(f"when regexp_extract(url, '{p}', 1) <> ''{_RESERVED(p, r)} then '{ROUTER}{r}' || regexp_extract(url, '{p}', 1)" for p, r in ROUTES)


@query(f"""with {cases.values("c", PROFILES, "id bigint, url string")}, a as (select * from c union all select page_id::bigint, url from pages)
select id, case {_ROUTED} else url end as route, coalesce({" or ".join(f"ends_with({_PATH.format(u='url')}, '{e}')" for e in FEED_ENDS)} or {_HOST.format(u='url')} = '{ROUTER.split("//")[1]}', false) as feed from a""")
def profile_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of a profile's address, else the address itself; and whether an address looks like a feed."""
    rows = cases.literal(spark, PROFILES, "id bigint, url string").union(table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint"), "url"))
    route = F.col("url")
    for pattern, at in reversed(ROUTES):
        name = F.regexp_extract("url", pattern, 1)
        is_profile = (name != "") & ~F.lower(name).isin(*NO_PROFILES) if at == "/twitter/user/" else name != ""
        route = F.when(is_profile, F.concat(F.lit(ROUTER + at), name)).otherwise(route)
    feed = T.host(F.col("url")) == ROUTER.split("//")[1]
    for end in FEED_ENDS:
        feed = feed | T.path(F.col("url")).endswith(end)
    return rows.select("id", route.alias("route"), F.coalesce(feed, F.lit(False)).alias("feed"))


ACCOUNTS = [
    (-1, "a", "https://a.example/1", "One story", "told once"), (-2, "a", "https://a.example/2", "One story", "told"), (-2, "b", "https://b.example/3", "One story", "twice"),
    (-3, "c", "https://c.example/4", "Новость", "одна"), (-4, "d", "https://d.example/1", "x", "y"), (-4, "d", "https://e.example/1", "x", "y"), (-5, "f", None, None, None),
]
ACCOUNT = "thread bigint, publisher string, url string, title string, content string"
_FOREIGN = "[\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}\\x{0400}-\\x{04ff}\\x{4e00}-\\x{9fff}]"


@query(f"""with {ARTICLES}, {cases.values("c", ACCOUNTS, ACCOUNT)}, m as (select * from c union all select id // 3, publisher, url, title, content from article)
select thread, count(distinct publisher) >= 2 or count(distinct {_HOST.format(u="coalesce(url, '')")}) >= 2 or bool_or(regexp_matches(coalesce(title, '') || ' ' || substr(coalesce(content, ''), 1, 300), '{_FOREIGN}')) as synthesise from m group by 1""")
def synthesis_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a thread has something to synthesise: several publishers or hosts, or an item in another language than
    that of narration (here English)."""
    rows = articles(spark, sf_dir).select(F.expr("id div 3").alias("thread"), "publisher", "url", "title", "content").union(cases.literal(spark, ACCOUNTS, ACCOUNT))
    spoken = T.language(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("content", F.lit("")), 1, 300)))
    several = rows.groupBy("thread").agg(F.countDistinct("publisher").alias("p"), F.countDistinct(T.host(F.col("url"))).alias("h"), F.bool_or(spoken != "en").alias("f"))
    return several.select("thread", ((F.col("p") >= 2) | (F.col("h") >= 2) | F.col("f")).alias("synthesise"))


@query("""with v as (select case when vec_id % 5 = 0 then embedding[1:8] else embedding end as v from embeddings), k as (select len(v) as n from v group by 1 order by count(*) desc, 1 limit 1),
p as (select unnest(range(len(v))) as i, unnest(v) as x from v, k where len(v) = n) select i::int as i, round(avg(x::double), 6) as mean from p group by 1""")
def modal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the vectors of the size that most have, the smaller size of a tie: what a probe centres by."""
    rows = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("v")).withColumn("n", F.size("v"))
    modal = F.broadcast(rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).select("n"))  # one row
    return V.mean_vector(rows.join(modal, "n"), "v").select(F.posexplode("mean").alias("i", "m")).select("i", F.round("m", 6).alias("mean"))


@query(f"""with s as (select lang as target, quality as y, round(1 / (1 + exp(-(n_chars - 1500) / 1500.0)), 4) as score from documents join labels using (doc_id)), g as (select target, score, count(*) as n, sum(y) as pos from s group by 1, 2),
c as (select *, sum(n) over d as seen, sum(pos) over d as tp, sum(pos) over u as below, sum(pos) over (partition by target) as p from g window d as (partition by target order by score desc), u as (partition by target order by score))
select target, sum(pos)::bigint as n_pos, sum(n - pos)::bigint as n_neg, least(greatest(coalesce(min(case when tp / seen >= {ADD_PRECISION} and tp >= {LEAST_FOUND} then score end), 1.01), {ADD_FLOOR}), 0.99)::double as add_threshold,
  greatest(least(coalesce(min(case when pos > 0 and below > greatest(0, floor((1 - {VETO_RECALL}) * p) - 1) then score end), 0), {VETO_CEIL}), 0)::double as veto_threshold from c group by 1""")
def probe_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from which each target's probe adds and up to which it vetoes.

    Scores are kept to four places and counted before any ranking, so a target has at most 10 001 rows however many
    labels it has; equal scores count together.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("target"), F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1500.0)), 4).alias("score"))
    counted = rows.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").groupBy("target", "score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    target = Window.partitionBy("target")
    down, up = target.orderBy(F.desc("score")), target.orderBy("score")
    walked = counted.select("*", F.sum("n").over(down).alias("seen"), F.sum("pos").over(down).alias("tp"), F.sum("pos").over(up).alias("below"), F.sum("pos").over(target).alias("p"))
    good = (F.col("tp") / F.col("seen") >= ADD_PRECISION) & (F.col("tp") >= LEAST_FOUND)
    kept = (F.col("pos") > 0) & (F.col("below") > F.greatest(F.lit(0), F.floor((1 - VETO_RECALL) * F.col("p")) - 1))
    found = walked.groupBy("target").agg(F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"), F.min(F.when(good, F.col("score"))).alias("a"), F.min(F.when(kept, F.col("score"))).alias("v"))
    add = F.least(F.greatest(F.coalesce("a", F.lit(1.01)), F.lit(ADD_FLOOR)), F.lit(0.99))
    veto = F.greatest(F.least(F.coalesce("v", F.lit(0.0)), F.lit(VETO_CEIL)), F.lit(0.0))
    return found.select("target", "n_pos", "n_neg", add.alias("add_threshold"), veto.alias("veto_threshold"))


PROBES = [(0, 0.9, 0.1), (1, 0.8, 0.2), (2, 0.99, 0.05), (3, 0.85, 0.0)]
PROBE = "target bigint, add_t double, veto_t double"


@query(f"""with {cases.values("probe", PROBES, PROBE)}, s as (select o_orderkey as thread_id, o_custkey % 5 as target, floor(o_totalprice::double % 1000) / 1000.0 as p from orders),
r as (select o_orderkey as thread_id, (o_custkey + case when o_orderkey % 5 = 0 then 1 else 0 end) % 5 as target, ['match', 'route', 'model', 'planned'][o_orderkey % 4 + 1] as source, case o_orderkey % 7 when 0 then true when 1 then false end as verdict from orders where o_orderkey % 3 <> 0),
j as (select thread_id, target, p, source, verdict, case when source is null and p >= add_t then 'added' when source is null then null when verdict is null and source in ('match', 'route') and p <= veto_t then 'vetoed' else 'scored' end as change
  from s join probe using (target) left join r using (thread_id, target))
select thread_id, target::bigint as target, change, p as score, coalesce(source, 'model') as source, case when change = 'vetoed' then false else verdict end as verdict from j where change is not null""")
def probe_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the probes change: relations that they add, those that they veto before any verdict, and new scores."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("double")
    scores = orders.select(F.col("o_orderkey").alias("thread_id"), (F.col("o_custkey") % 5).alias("target"), (F.floor(price % 1000) / 1000.0).alias("p"))
    moved = F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)
    source = F.get(F.array(*[F.lit(x) for x in ("match", "route", "model", "planned")]), (F.col("o_orderkey") % 4).cast("int"))
    verdict = F.when(F.col("o_orderkey") % 7 == 0, True).when(F.col("o_orderkey") % 7 == 1, False)
    relations = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("thread_id"), ((F.col("o_custkey") + moved) % 5).alias("target"), source.alias("source"), verdict.alias("verdict"))
    return changes(scores, cases.literal(spark, PROBES, PROBE), relations)


ALIASES = [("g", "Gemini 3.5"), ("g", "Gemini 4 Pro"), ("g", "gemini"), ("g", "Bard"), ("o", "GPT-5"), ("o", "GPT-4.1"), ("o", "o3"), ("c", "Opus 5"), ("c", None), ("c", "opus 4.5 max")]


@query(f"""with {cases.values("said", ALIASES, "target string, alias string")}, a as (select * from said union all select p_brand, p_name || ' ' || p_size || '.5' from part) select target, lower(trim(regexp_extract(alias, '^([^0-9]*)', 1))) as anchor, max(nullif(regexp_extract(alias, '([0-9]+(?:\\.[0-9]+)?)', 1), '')::double) as version from a where alias is not null group by 1, 2""")
def alias_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version that a target's aliases name for each product; null where they name none.  Parts are aliases of
    their brands beside the cases."""
    parts = table(spark, sf_dir, "part").select("p_brand", F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".5")))
    rows = cases.literal(spark, ALIASES, "target string, alias string").union(parts).where("alias is not null")
    version = F.nullif(F.regexp_extract("alias", r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    return rows.groupBy("target", F.lower(F.trim(F.regexp_extract("alias", "^([^0-9]*)", 1))).alias("anchor")).agg(F.max(version).alias("version"))


#: Words too general to watch; titles that a term needs, terms of a run, letters of a term.
GENERIC = ("ai", "model", "models", "news", "update", "google", "openai", "anthropic", "microsoft", "apple", "the", "new", "launch", "release", "test", "pro", "flash", "ultra", "api")
SUPPORT, MOST_TERMS, LEAST_LETTERS = 2, 6, 3
PROPOSED = [
    ("g", 1, '"Gemini 5"', "core"), ("g", 2, "Claude Opus 5.5", "context"), ("g", 3, "Pro", "core"), ("g", 4, "gemini 5", "core"), ("g", 5, "Nano Banana", "context"), ("g", 6, "Geminis", "core"), ("g", 7, "AB", "core"), ("g", 8, "模型竞赛", "context"),
    ("c", 1, "Gemini 5", "context"), ("c", 2, "Fable 2", "core"), ("c", 3, "fable", "core"), ("c", 4, "Once only", "core"), ("c", 5, "C++ tools", "context"),
]
KNOWN = [("g", "Gemini"), ("g", "Bard"), ("c", "Claude Opus"), ("c", "Sonnet"), ("c", "Gem")]
SEEN = [
    ("g", "Gemini 5 is near"), ("g", "GEMINI 5: what we know"), ("g", "gemini 5  is near"), ("g", "Nano Banana and xNano Bananas"), ("g", "A Nano Banana again; Pro Pro"), ("g", "Claude Opus 5.5 meets Gemini 5"), ("g", "新的模型竞赛"), ("g", "模型竞赛开始"),
    ("c", "Fable 2 and fable 20"), ("c", "Fable 2 is out"), ("c", "A fable"), ("c", "Once only"), ("c", "C++ tools for all"), ("c", "More C++ tools"), ("c", None),
]
_TERM_KEY = "regexp_replace(lower({t}), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]+', '', 'g')"


@query(f"""with {cases.values("prop", PROPOSED, "target string, place int, term string, scope string")}, {cases.values("known", KNOWN, "target string, alias string")}, {cases.values("seen0", SEEN, "target string, title string")}, {ARTICLES}, seen as (select * from seen0 union all select 'g', title || ' Gemini 5' from article),
t as (select target, min(trim(title)) as title from seen where trim(title) <> '' group by target, regexp_replace(lower(trim(title)), '\\s+', ' ', 'g')),
p as (select target, place, trim(term, ' "“”') as term, lower(trim(term, ' "“”')) as low, scope from prop),
s as (select p.*, (select count(*) from t where t.target = p.target and case when regexp_matches(term, '[A-Za-z0-9]') then regexp_matches(title, '(?i)(^|[^0-9A-Za-z])\\Q' || term || '\\E($|[^0-9A-Za-z])') else contains(lower(title), low) end) as support from p
  where length(term) >= {LEAST_LETTERS} and low not in {GENERIC}
  and not exists (select 1 from known k where k.target = p.target and (low = lower(alias) or (contains(low, lower(alias)) and length(low) - length(alias) <= 2)))
  and not exists (select 1 from known k where k.target <> p.target and length({_TERM_KEY.format(t='alias')}) >= 4 and contains({_TERM_KEY.format(t='term')}, {_TERM_KEY.format(t='alias')}))),
f as (select * from s where support >= {SUPPORT} qualify row_number() over (partition by target, low order by place) = 1)
select target, term, support, scope = 'core' as applied from f qualify row_number() over (partition by target order by place) <= {MOST_TERMS}""")
def vocab_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed terms that the titles bear out, at most six to a target, and whether they are applied or only suggested.

    A model proposes few terms to a target, so titles meet them by target; other targets' aliases are met by an equal
    join on the parts of a term's key.  Titles that differ in case and space count once; null ones don't count.
    The articles' titles stand beside the cases, about one target.
    """
    key = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af]+", "")
    term = F.trim("term", F.lit(' "“”'))
    terms = cases.literal(spark, PROPOSED, "target string, place int, term string, scope string").select("target", "place", term.alias("term"), F.lower(term).alias("low"), "scope")
    terms = terms.where((F.length("term") >= LEAST_LETTERS) & ~F.col("low").isin(*GENERIC))
    known = cases.literal(spark, KNOWN, "target string, alias string")
    own = terms.join(known, "target").where(F.col("low").contains(F.lower("alias")) & ((F.col("low") == F.lower("alias")) | (F.length("low") - F.length("alias") <= 2))).select("target", "place")
    k = F.col("key")
    spans = F.expr("flatten(transform(sequence(1, greatest(length(key), 1)), a -> transform(sequence(a, greatest(length(key), a)), b -> substring(key, a, b - a + 1))))")
    parts = terms.select("target", "place", key("term").alias("key")).where(F.length(k) >= 4).select("target", "place", F.explode(spans).alias("part"))
    others = known.select(F.col("target").alias("owner"), key("alias").alias("part")).where("length(part) >= 4")
    foreign = parts.join(others, "part").where("target <> owner").select("target", "place")
    terms = terms.join(own.union(foreign).distinct(), ["target", "place"], "left_anti")
    seen = articles(spark, sf_dir).select(F.lit("g"), F.concat("title", F.lit(" Gemini 5")))
    titles = cases.literal(spark, SEEN, "target string, title string").union(seen).select("target", F.trim("title").alias("title")).where("title <> ''")
    titles = titles.groupBy("target", F.regexp_replace(F.lower("title"), r"\s+", " ")).agg(F.min("title").alias("title")).select("target", "title")
    bounded = F.concat(F.lit(r"(?i)(?<![0-9A-Za-z])\Q"), "term", F.lit(r"\E(?![0-9A-Za-z])"))
    holds = F.when(F.col("term").rlike("[A-Za-z0-9]"), F.regexp_like("title", bounded)).otherwise(F.lower("title").contains(F.col("low")))
    support = terms.join(titles, "target").where(holds).groupBy("target", "place").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    first = terms.join(support, ["target", "place"]).groupBy("target", "low").agg(F.min_by(F.struct("place", "term", "support", "scope"), "place").alias("f")).select("target", "f.*")
    rank = F.row_number().over(Window.partitionBy("target").orderBy("place"))
    return first.withColumn("rank", rank).where(F.col("rank") <= MOST_TERMS).select("target", "term", "support", (F.col("scope") == "core").alias("applied"))


TRACKERS = [
    (1, "Gemini", '["Gemini", "https://g.example", " Bard "]', '{"topic": "models", "signals": [{"value": "release"}, {"value": ""}, {"kind": "x"}]}', '{"entities": ["Gemini", "GG"], "keep_keywords": ["nano"], "keywords": "one"}'),
    (2, "", "plain words", None, "{not json"), (3, None, "[]", "{}", ""), (4, "x", "7", '"text"', '{"entities": "solo", "signals": []}'), (5, "y", '["' + '", "'.join(f"t{i}" for i in range(25)) + '"]', None, None),
]
TRACKER = "id bigint, name string, target string, normalized_intent string, fetch_policy string"
#: Where a profile's JSON holds terms; terms of a profile.
TERM_KEYS, MOST_ANCHORS = ("topic", "entities", "keep_keywords", "keywords"), 20
_NO = "cast([] as varchar[])"
_PARTS = lambda v: (
    f"case when coalesce({v}, '') = '' then {_NO} when not json_valid({v}) then [{v}] when json_type({v}) = 'ARRAY' then json_extract_string({v}, '$[*]') when json_type({v}) = 'OBJECT' then list_concat("
    + ", ".join(f"case json_type({v}, '$.{k}') when 'ARRAY' then json_extract_string({v}, '$.{k}[*]') when 'VARCHAR' then [json_extract_string({v}, '$.{k}')] else {_NO} end" for k in TERM_KEYS)
    + f", list_filter(json_extract_string({v}, '$.signals[*].value'), lambda x: x <> '')) else {_NO} end"
)


@query(f"""with {cases.values("t0", TRACKERS, TRACKER)}, t as (select * from t0 union all select 1000 + event_id, event_type, props, null, '{{"entities": ["' || event_type || '", "' || user_id || '"]}}' from events), r as (select id, list_filter(list_transform(list_concat(case when coalesce(name, '') = '' then {_NO} else [name] end, {", ".join(_PARTS(c) for c in ("target", "normalized_intent", "fetch_policy"))}), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, 'http')) as l from t)
select id, (list_filter(l, lambda x, i: list_position(l, x) = i))[1:{MOST_ANCHORS}] as terms from r""")
def profile_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a target: its name and what its three JSON fields list, each once, no addresses, twenty at most.
    A field that isn't JSON is a term itself; other JSON than lists and objects gives none."""
    none = F.expr("cast(array() as array<string>)")

    def parts(name: str) -> Column:
        value, json = F.col(name), F.try_parse_json(F.col(name))
        kind = F.schema_of_variant(json)
        listed = [F.try_variant_get(json, f"$.{k}", "array<string>") for k in TERM_KEYS]
        single = [F.when(F.schema_of_variant(F.try_variant_get(json, f"$.{k}", "variant")) == "STRING", F.array(F.try_variant_get(json, f"$.{k}", "string"))) for k in TERM_KEYS]
        signals = F.transform(F.try_variant_get(json, "$.signals", "array<struct<value:string>>"), lambda s: s["value"])
        held = F.concat(*[F.coalesce(a, b, none) for a, b in zip(listed, single, strict=True)], F.coalesce(F.filter(signals, lambda s: s != ""), none))
        inside = F.when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(json, "$", "array<string>"), none)).when(kind.startswith("OBJECT"), held).otherwise(none)
        return F.when(F.coalesce(value, F.lit("")) == "", none).when(json.isNull(), F.array(value)).otherwise(inside)

    named = F.when(F.coalesce("name", F.lit("")) == "", none).otherwise(F.array("name"))
    raw = F.transform(F.concat(named, parts("target"), parts("normalized_intent"), parts("fetch_policy")), lambda t: F.trim(t))
    kept = F.array_distinct(F.filter(raw, lambda t: (t != "") & ~t.startswith("http")))
    policy = F.concat(F.lit('{"entities": ["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]}'))
    events = table(spark, sf_dir, "events").select(F.col("event_id") + 1000, "event_type", "props", F.lit(None).cast("string"), policy)
    return cases.literal(spark, TRACKERS, TRACKER).union(events).select("id", F.slice(kept, 1, MOST_ANCHORS).alias("terms"))


@query(f"""with {THREADS}, rg as (select thread_id, not bool_or(tier in ('primary', 'curated')) as rumor from member group by 1),
x as (select t.thread_id, first_seen, target_id, rumor, case when t.thread_id % 4 = 0 then t.thread_id // 4 end as line, row_number() over (partition by target_id order by t.thread_id) as i from thread t join rg on rg.thread_id = t.thread_id),
p as (select a.thread_id as a, b.thread_id as b, (a.thread_id + b.thread_id) % 3 as rel, a.first_seen <= b.first_seen as a_first, a.line as la, b.line as lb, a.rumor and b.rumor as rumor from x a join x b on a.target_id = b.target_id and a.i % 2 = 1 and b.i = a.i + 1 where (a.thread_id + b.thread_id) % 10 <> 0),
o as (select a, b, rel, rumor, case when a_first then a else b end as older, case when a_first then b else a end as younger, case when a_first then la else lb end as lo, case when a_first then lb else la end as ly from p),
s as (select *, lo is not null or ly is null as by_older, lo is not null or ly is not null or rumor as may from o)
select a, b, case rel when 0 then 'merged' when 1 then 'story' else 'none' end as verdict, case when rel = 0 then older end as keep, case when rel = 0 then younger end as gone,
  case when rel = 1 and may and (case when by_older then ly else lo end) is null then case when by_older then younger else older end end as linked,
  case when rel = 1 and may and (case when by_older then ly else lo end) is null then coalesce(case when by_older then lo else ly end, -(case when by_older then older else younger end)) end as storyline from s""")
def merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass over judged pairs does: of one event, the older thread stays; of one story, a thread without a
    storyline joins its kin's, which is born (negative, by the thread) only between threads of rumours.

    Pairs that were judged before are left out.  Pairs don't share threads here, so their order doesn't matter; no pair
    is left for a later pass.
    """
    grade = members(spark, sf_dir).groupBy("thread_id").agg((~F.bool_or(F.col("tier").isin("primary", "curated"))).alias("rumor"))
    line = F.when(F.col("thread_id") % 4 == 0, F.expr("thread_id div 4"))
    place = F.row_number().over(Window.partitionBy("target_id").orderBy("thread_id"))
    rows = threads(spark, sf_dir).join(grade, "thread_id").select("target_id", F.floor((place - 1) / 2).alias("pair"), F.struct("thread_id", "first_seen", "rumor", line.alias("line")).alias("t"))
    two = rows.groupBy("target_id", "pair").agg(F.min_by("t", "t.thread_id").alias("x"), F.max_by("t", "t.thread_id").alias("y")).where("x.thread_id <> y.thread_id")
    ids = F.col("x.thread_id") + F.col("y.thread_id")
    first = F.col("x.first_seen") <= F.col("y.first_seen")
    two = two.where(ids % 10 != 0).select(F.col("x.thread_id").alias("a"), F.col("y.thread_id").alias("b"), (ids % 3).alias("rel"), F.when(first, F.col("x")).otherwise(F.col("y")).alias("o"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("n"))
    by_older = F.col("o.line").isNotNull() | F.col("n.line").isNull()
    may = F.col("o.line").isNotNull() | F.col("n.line").isNotNull() | (F.col("o.rumor") & F.col("n.rumor"))
    kin, other = F.when(by_older, F.col("o")).otherwise(F.col("n")), F.when(by_older, F.col("n")).otherwise(F.col("o"))
    event, joins = F.col("rel") == 0, (F.col("rel") == 1) & may & other["line"].isNull()
    return two.select(
        "a", "b", F.when(event, "merged").when(F.col("rel") == 1, "story").otherwise("none").alias("verdict"), F.when(event, F.col("o.thread_id")).alias("keep"), F.when(event, F.col("n.thread_id")).alias("gone"),
        F.when(joins, other["thread_id"]).alias("linked"), F.when(joins, F.coalesce(kin["line"], -kin["thread_id"])).alias("storyline"),
    )


#: Words of a topic, the kind of its source, and the address, where {q} is what is asked.
REGISTRIES = (
    (("clinical trial", "clinicaltrials", "therapy", "therapies", "treatment", "drug", "disease", "syndrome", "疗法", "新药", "临床", "试验", "疾病", "病", "治疗", "渐冻", "als", "cancer", "癌", "alzheimer", "parkinson", "rare disease", "罕见病"),
     "registry", "https://clinicaltrials.gov/api/v2/studies?query.cond={q}&sort=LastUpdatePostDate:desc&pageSize=20"),
    (("cve", "vulnerability", "vulnerabilities", "exploit", "漏洞", "0day", "zero-day"), "rss", "https://nvd.nist.gov/feeds/xml/cve/misc/nvd-rss-analyzed.xml"),
    (("film festival", "影展", "电影节", "短片", "short film"), "page_monitor", "https://filmfreeway.com/festivals"),
    (("paper", "papers", "arxiv", "论文", "preprint", "预印本", "research"), "rss", "https://export.arxiv.org/api/query?search_query=all:{q}&sortBy=submittedDate&sortOrder=descending&max_results=25"),
    (("10-k", "8-k", "sec filing", "earnings", "财报", "上市公司", "ticker", "股票", "stock"), "rss", "https://www.sec.gov/cgi-bin/browse-edgar?action=getcurrent&type=8-K&output=atom"),
)
TOPICS = [(1, "A rare disease and its drug", "ALS & more"), (2, "zero-day exploit research", None), (3, "影展 短片", ""), (4, "gardens", "gardens"), (5, None, None), (6, " Earnings of a/b ~ c* ", None)]
_ASKED = "replace(url_encode(coalesce(nullif(en, ''), substr(trim(coalesce(text, '')), 1, 60))), '%2F', '/')"


@query(f"with {cases.values('t0', TOPICS, 'id bigint, text string, en string')}, {ARTICLES}, t as (select * from t0 union all select 100 + id, title || ' paper', null from article) " + " union all ".join(f"select id, '{kind}' as kind, replace('{url}', '{{q}}', {_ASKED}) as url from t where {_any('lower(text)', words)}" for words, kind, url in REGISTRIES))
def registry_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registries that a topic's words call for, and what they are asked; titles are topics beside the cases."""
    titles = articles(spark, sf_dir).select(F.col("id") + 100, F.concat("title", F.lit(" paper")), F.lit(None).cast("string"))
    rows = cases.literal(spark, TOPICS, "id bigint, text string, en string").union(titles)
    q = F.url_encode(F.coalesce(F.nullif("en", F.lit("")), F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 60)))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        q = F.replace(q, F.lit(old), F.lit(new))
    found = [F.when(T.any_of(F.lower("text"), words), F.struct(F.lit(kind).alias("kind"), F.replace(F.lit(url), F.lit("{q}"), q).alias("url"))) for words, kind, url in REGISTRIES]
    return rows.select("id", F.explode(F.array_compact(F.array(*found))).alias("r")).select("id", "r.*")


#: Names that are no accounts, on one site and anywhere; hosts that are no publishers; hosts of code.
RESERVED = ("i", "home", "search", "explore", "intent", "share", "hashtag", "settings", "messages", "notifications", "login", "signup", "compose")
NOISE_NAMES = ("gmail", "yahoo", "outlook", "hotmail", "icloud", "protonmail", "media", "everyone", "here", "channel", "username", "example", "user", "mention")
NOISE_HOSTS = (
    "news.google.com", "reddit.com", "ycombinator", "hnrss", "x.com", "twitter.com", "t.co", "youtube.com", "youtu.be", "github.com", "linkedin.com", "facebook.com", "instagram.com", "wikipedia.org", "google.com", "bing.com", "t.me",
    "discord.com", "discord.gg", "tiktok.com", "threads.net", "bsky.app", "mastodon.social", "nitter.", "xcancel.com", "arxiv.org",
)
CODE = ("github.com", "gitlab.com", "huggingface.co", "githubusercontent.com")
ACCOUNT_LINK = r"(?i)https?://(?:www\.|mobile\.)?(?:x\.com|twitter\.com)/([A-Za-z0-9_]{1,15})"
SAID = [
    (-1, "As @leaker posted", "see https://x.com/leaker/status/1 and https://twitter.com/home; mail me@gmail.com @gmail @ab @abc,@def", "https://www.paper.example/1"), (-2, "Release", "thanks @dev @other https://x.com/dev", "https://github.com/a/b"),
    (-3, None, "@start é@no @名字 @abcé @a_very_long_name_that_is_none .@dot /@slash", "https://localhost/1"), (-4, "x", None, None), (-5, "HTTPS://MOBILE.TWITTER.COM/Big_One", "", "https://nitter.net/a"),
]
SAYING = "id bigint, title string, content string, url string"
_BARE = "regexp_replace(" + _HOST.format(u="coalesce(url, '')") + ", '^www\\.', '')"


@query(f"""with {ARTICLES}, {cases.values("said", SAID, SAYING)}, a as (select * from said union all select id, title, content, url from article), t as (select id, coalesce(title, '') || chr(10) || coalesce(content, '') as t, {_BARE} as d from a),
l as (select id, unnest(regexp_extract_all(t, '{ACCOUNT_LINK}', 1)) as name from t), h as (select id, unnest(regexp_extract_all(t, '(?:^|[^\\pL\\pN_.@/])@([A-Za-z0-9_]{{3,15}}[\\pL\\pN_]*)', 1)) as name from t where not {_any('d', CODE)})
select distinct id, 'account' as kind, name from l where lower(name) not in {RESERVED + NOISE_NAMES} union
select distinct id, 'account', name from h where regexp_full_match(name, '[A-Za-z0-9_]{{3,15}}') and lower(name) not in {NOISE_NAMES} union
select id, 'domain', d from t where contains(d, '.') and not {_any('d', NOISE_HOSTS)}""")
def member_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that an item points at: accounts by link or, but for hosts of code, by name, and its publisher's host.
    Whole texts are read."""
    rows = articles(spark, sf_dir).select("id", "title", "content", "url").union(cases.literal(spark, SAID, SAYING))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = rows.select("id", text.alias("t"), F.regexp_replace(T.host(F.col("url")), r"^www\.", "").alias("d"))
    links = F.filter(F.regexp_extract_all("t", F.lit(ACCOUNT_LINK), F.lit(1)), lambda n: ~F.lower(n).isin(*RESERVED, *NOISE_NAMES))
    named = F.filter(F.regexp_extract_all("t", F.lit(r"(?<![\p{L}\p{N}_.@/])@([A-Za-z0-9_]{3,15})(?![\p{L}\p{N}_])"), F.lit(1)), lambda n: ~F.lower(n).isin(*NOISE_NAMES))
    none = F.expr("cast(array() as array<string>)")
    accounts = F.array_union(links, F.when(T.any_of(F.col("d"), CODE), none).otherwise(named))
    hosts = F.when(F.col("d").contains(".") & ~T.any_of(F.col("d"), NOISE_HOSTS), F.array("d")).otherwise(none)
    of = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    return rows.select("id", F.explode(F.concat(of("account", accounts), of("domain", hosts))).alias("m")).select("id", "m.*")


#: Items of a target's feed.
FEED = 20


@query(f"""with {ARTICLES}, dec as ({base.SQL["target_decisions"]}), f as (select target_id, article.id, row_number() over (partition by target_id order by created_at desc, article.id) as place from dec join article on article.id = dec.id where matched)
select target_id, id, place::int as place from f where place <= {FEED}""")
def target_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest articles about each target: the decisions as a filter of feeds."""
    matched = screen_queries.target_decisions(spark, sf_dir).where("matched").select("target_id", "id")
    rows = matched.join(articles(spark, sf_dir).select("id", "created_at"), "id")
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("created_at"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= FEED).select("target_id", "id", "place")
