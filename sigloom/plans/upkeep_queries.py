"""Pages, caches, ledgers, summaries and targets kept up to date, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.functions import vectors as V
from sigloom.operators.similarity import best_matches
from sigloom.operators.threads import material, rank, worth_summary
from sigloom.operators.titles import classes_of, near_classes
from sigloom.plans.base import query, table
from sigloom.plans.texts import _HOST, _NORM, _PATH, _SIGNALS, _any, _under
from sigloom.sources import cases
from sigloom.sources.bind import ARTICLES, MEMBERS, THREADS, articles, members, threads
from sigloom.sources.folders import new_folder

#: Where the ids of copies begin that are asked about too.
COPIES = 1_000_000_000_000
_UNIT = f"""e as (select vec_id, embedding::double[] as v from embeddings union all select vec_id + {COPIES}, list_transform(embedding::double[], lambda x: 3 * x) from embeddings where vec_id % 40 = 0),
u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as c from e where list_inner_product(v, v) > 0)"""


@query(f"""with {_UNIT}, s as (select a.vec_id, b.vec_id as other, round(list_inner_product(a.c, b.c), 9) as s from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by vec_id order by s desc, other desc) as place from s where s >= 0.9) select vec_id, other as duplicate_of, round(s, 5) as similarity from r where place = 1""")
def vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector of each asked one, from a cosine of 0.90 up; of equally near ones the latest.  Every
    fortieth vector is there again, three times as long."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    copies = vectors.where("vec_id % 40 = 0").select(F.col("vec_id") + COPIES, F.transform("v", lambda x: 3 * x))
    rows = vectors.union(copies).select((-F.col("vec_id")).alias("k"), "v")
    rows = rows.where(V.norm(F.col("v")) > 0).select("k", V.unit(F.col("v")).alias("v"))
    best = best_matches(rows.where("k % 20 = 0"), rows, "k", "v", 1, 0.9, digits=9)
    return best.select((-F.col("k")).alias("vec_id"), (-F.col("other")).alias("duplicate_of"), F.round("similarity", 5).alias("similarity"))


#: Days in which a summary of the same news spares another.
SPARED_DAYS = 7
_TITLED = f"""n as (select id, id % 2 = 0 and id % 14 <= {SPARED_DAYS} as recent, {_NORM.format(t='title')} as norm, {_SIGNALS} as signals from article),
w as (select *, list_filter(string_split(norm, ' '), lambda x: len(x) > 1) as words from n where norm <> ''), c as (select id, recent, signals, norm, list_distinct(words) as tokens from w where len(words) >= 3)"""


@query(f"""with {ARTICLES}, {_TITLED}, p as (select a.id, b.id as other, len(list_intersect(a.tokens, b.tokens)) as common, len(a.tokens) + len(b.tokens) as total, a.norm = b.norm as same
from c a join c b on a.id <> b.id and a.signals = b.signals and b.recent) select id, min(other) as duplicate_of from p where same or common >= 0.8 * (total - common) and common > 0 group by 1""")
def summarised_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads whose title is a near-duplicate of another thread's that was summarised within SPARED_DAYS, and the first
    such thread.  Even articles stand for summarised threads, id % 14 for the days since.

    Titles meet as classes: each class carries its two first recent members, as many as it takes to name one other than
    itself, so copies never meet in pairs.
    """
    rows = articles(spark, sf_dir).select("id", "title", ((F.col("id") % 2 == 0) & (F.col("id") % 14 <= SPARED_DAYS)).alias("recent"))
    named = rows.select("id", "recent", T.normalize_title(F.col("title")).alias("norm"), F.array_join(T.signal_tokens(F.col("title")), " ").alias("signals"))
    groups = named.where("norm <> ''").groupBy("norm", "signals")
    first = groups.agg(F.min("id").alias("class"), F.min(F.when(F.col("recent"), F.col("id"))).alias("r1"))
    members = named.join(first, ["norm", "signals"])
    second = members.where("recent and id > r1").groupBy("class").agg(F.min("id").alias("r2"))
    classes = classes_of(rows, [], "id")
    near = near_classes(classes, [], "id").select("a", "b")
    both = near.union(near.select("b", "a")).toDF("class", "near")
    beside = both.join(first.select(F.col("class").alias("near"), "r1"), "near").groupBy("class").agg(F.min("r1").alias("rn"))
    whole = classes.select(F.col("id").alias("class")).join(second, "class", "left").join(beside, "class", "left")
    own = F.when(F.col("r1") == F.col("id"), F.col("r2")).otherwise(F.col("r1"))
    found = members.join(whole, "class").select("id", F.least(own, F.col("rn")).alias("duplicate_of"))
    return found.where(F.col("duplicate_of").isNotNull())


#: How an extractive summary is laid out.
TITLE_LINE, CITED, FOUND_BY = "[TITLE: {}]", "**:material/menu_book: 摘要引用来源:**", "**:material/radar: 探测任务来源 (Tracker):**"
#: Links that a summary shows.
SHOWN = 8
_FIRST = f"r as (select *, row_number() over (partition by publisher order by id) as place, count(*) over (partition by publisher) as sources from article), m as (select * from r where place <= {SHOWN})"


def _cited(rows: DataFrame, key: str, order: str, shown: Column) -> DataFrame:
    """key, sources, first (the first row) and links (lines of the first SHOWN rows)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    top = rows.withColumn("place", place).where(F.col("place") <= SHOWN)  # a limit of each group before the shuffle
    lines = F.array_sort(F.collect_list(F.struct("place", shown.alias("line"))))
    cited = top.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("links"), F.min_by(F.struct("title", "content"), "place").alias("first"))
    return cited.join(rows.groupBy(key).agg(F.count("*").alias("sources")), key)


_SENTENCE = "trim(regexp_extract(content, '^[^.]*\\.([^.]*)', 1))"


@query(f"""with {ARTICLES}, {_FIRST} select publisher, '[TITLE: ' || max(title) filter (place = 1) || ']' || chr(10) || chr(10) || max(substr({_SENTENCE}, 1, 300)) filter (place = 1) || chr(10) || chr(10) || '---' || chr(10) || '{CITED}' || chr(10)
|| string_agg('- [' || title || '](' || url || ')', chr(10) order by place) || chr(10) || chr(10) || '<br>' || chr(10) || chr(10) || '{FOUND_BY} `' || publisher || '`' as summary from m group by 1""")
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a thread that needs no synthesis: its lead's title and sentence, SHOWN links, its target.
    Publishers stand for threads; a null title or text is shown as empty."""
    rows = articles(spark, sf_dir).select("id", "publisher", "url", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "content")))
    cited = _cited(rows, "publisher", "id", F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")")))
    sentence = F.substring(F.trim(F.regexp_extract("first.content", r"^[^.]*\.([^.]*)", 1)), 1, 300)
    before, after = TITLE_LINE.split("{}")
    parts = [F.lit(before), F.col("first.title"), F.lit(after + "\n\n"), sentence, F.lit(f"\n\n---\n{CITED}\n"), F.col("links"), F.lit(f"\n\n<br>\n\n{FOUND_BY} `"), F.col("publisher"), F.lit("`")]
    return cited.select("publisher", F.concat(*parts).alias("summary"))


@query(f"""with {ARTICLES}, {_FIRST} select publisher, max(sources) || ' sources reporting.' || chr(10) || chr(10) || '**Sources:**' || chr(10) || string_agg('- ' || coalesce(nullif(title, ''), url) || ' (' || url || ')', chr(10) order by place) as body from m group by 1""")
def alert_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of an alert where no model writes one: how many sources report, and the first SHOWN of them."""
    name = F.coalesce(F.nullif("title", F.lit("")), "url")
    cited = _cited(articles(spark, sf_dir), "publisher", "id", F.concat(F.lit("- "), name, F.lit(" ("), "url", F.lit(")")))
    return cited.select("publisher", F.concat(F.col("sources").cast("string"), F.lit(" sources reporting.\n\n**Sources:**\n"), "links").alias("body"))


#: Elements that never reach a reader; the first go with all they hold.
WITH_CONTENT, ALONE = ("script", "style", "iframe", "object"), ("link", "meta", "embed")
_CLEAN = "html"
for _name in WITH_CONTENT:
    _CLEAN = f"regexp_replace({_CLEAN}, '<{_name}\\b[^>]*>.*?</{_name}\\s*>', '', 'gis')"
_CLEAN = f"regexp_replace({_CLEAN}, '<(?:{'|'.join(ALONE)})\\b[^>]*>', '', 'gis')"


@query(f"select page_id, {_CLEAN} as html from pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts, styles, frames and the like."""
    clean = F.col("html")
    for name in WITH_CONTENT:
        clean = F.regexp_replace(clean, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    clean = F.regexp_replace(clean, rf"(?is)<(?:{'|'.join(ALONE)})\b[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", clean.alias("html"))


@query()
def monitor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a monitor compares of each page: its links and blocks of text, a line each, in order."""
    from sigloom.operators.pages import compared_lines

    return compared_lines(table(spark, sf_dir, "pages")).select("page_id", F.posexplode("lines").alias("no", "line"))


FEEDS = [
    (-1, "<rss><channel><item><title>One &amp; more</title><link>https://example.org/1</link></item><item><title>Two</title></item></channel></rss>"),
    (-2, '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="https://example.org/a"/></entry></feed>'), (-3, "<rss><channel/></rss>"), (-4, "not xml"), (-5, None),
]


@query()
def monitor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass of the monitors finds at each address, a feed's first entries or a page's lines: how many lines, and
    the digest that the next pass compares."""
    from sigloom.operators.pages import scanned

    feeds = cases.literal(spark, FEEDS, "page_id bigint, html string").select("page_id", F.lit(True).alias("feed"), "html")
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit(False).alias("feed"), "html").union(feeds)
    return scanned(rows).select("page_id", "feed", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("content_hash"))


#: What monitors keep, ignore and watch for: by conv_id % 4.
POLICIES = [(0, None, None, "none"), (1, " The ", None, "none"), (2, None, "and", "none"), (3, None, None, "whole_page_change")]
POLICY = "k bigint, keep string, ignored string, goal string"
_HAS = "contains(lower(array_to_string(added, ' ')), lower(trim({})))"


@query(f"""with {cases.values("policy", POLICIES, POLICY)}, v as (select conv_id, turn, text, string_split(text, '. ') as lines, lag(text) over w as before, coalesce(lag(string_split(text, '. ')) over w, []) as old, row_number() over w = 1 as opening
  from conversations window w as (partition by conv_id order by turn)),
d as (select conv_id, turn, opening, sha256(coalesce(text, '')) = sha256(coalesce(before, '')) as same, list_filter(lines, lambda x: not list_contains(old, x)) as added, list_filter(old, lambda x: not list_contains(lines, x)) as removed from v)
select conv_id, turn, case when opening then 'Tracking Started' when same then 'No Changes' when (len(removed) > 0 and len(added) = 0 and goal <> 'whole_page_change') or coalesce(not {_HAS.format('keep')}, false) or coalesce({_HAS.format('ignored')}, false)
then 'Update Ignored (Filtered)' else 'Update Detected' end as status from d join policy on conv_id % 4 = k""")
def page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of a monitored page does to its monitor, against the version before and the monitor's policy.
    Lines are compared as sets; keep and ignore words are looked for in the added lines."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.split("text", r"\. ", -1).alias("lines"))
    none = F.expr("cast(array() as array<string>)")
    rows = rows.select("*", F.lag("text").over(order).alias("before"), F.coalesce(F.lag("lines").over(order), none).alias("old"), (F.row_number().over(order) == 1).alias("opening"))
    added, removed = F.filter("lines", lambda x: ~F.array_contains("old", x)), F.filter("old", lambda x: ~F.array_contains("lines", x))
    policy = F.broadcast(cases.literal(spark, POLICIES, POLICY))  # four rows
    rows = rows.select("conv_id", "turn", "opening", added.alias("added"), removed.alias("removed"), (F.coalesce("text", F.lit("")) == F.coalesce("before", F.lit(""))).alias("same"), (F.col("conv_id") % 4).alias("k")).join(policy, "k")
    new = F.lower(F.array_join("added", " "))
    has = lambda word: F.contains(new, F.lower(F.trim(word)))
    deletion = (F.size("removed") > 0) & (F.size("added") == 0) & (F.col("goal") != "whole_page_change")
    ignored = deletion | F.coalesce(~has("keep"), F.lit(False)) | F.coalesce(has("ignored"), F.lit(False))
    status = F.when(F.col("opening"), "Tracking Started").when(F.col("same"), "No Changes").when(ignored, "Update Ignored (Filtered)").otherwise("Update Detected")
    return rows.select("conv_id", "turn", status.alias("status"))


@query("""with r as (select event_id, user_id, ts, json_extract_string(props, '$.k')::int as k, case event_type when 'view' then 304 when 'error' then 500 else 200 end as status from events),
a as (select *, case when status = 200 then 'b' || k % 3 end as body, case when status = 200 then case when k % 5 > 0 then 'e' || k % 3 else '' end end as etag from r),
b as (select *, last_value(body ignore nulls) over w as held, last_value(etag ignore nulls) over w as sent from a window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
select event_id, status, nullif(sent, '') as sent_etag, status = 200 and coalesce(body <> held, true) as changed, status = 304 or coalesce(body = held, false) as from_cache from b where status <> 500""")
def http_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of validators sends and learns with each answer of an address.  A 304 or a body of the digest held is
    no change; an error leaves the cache as it was and gives no row.  Users stand for addresses."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "view", 304).when(F.col("event_type") == "error", 500).otherwise(200)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", k.alias("k"), status.alias("status"))
    number = (F.col("k") % 3).cast("string")
    fresh = F.col("status") == 200
    rows = rows.select("*", F.when(fresh, F.concat(F.lit("b"), number)).alias("body"), F.when(fresh, F.when(F.col("k") % 5 > 0, F.concat(F.lit("e"), number)).otherwise("")).alias("etag"))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.last("body", True).over(before).alias("held"), F.last("etag", True).over(before).alias("sent"))
    same = F.col("body") == F.col("held")
    changed, cached = fresh & F.coalesce(~same, F.lit(True)), (F.col("status") == 304) | F.coalesce(same, F.lit(False))
    return rows.where("status <> 500").select("event_id", "status", F.nullif("sent", F.lit("")).alias("sent_etag"), changed.alias("changed"), cached.alias("from_cache"))


@query("""with p as (select p_brand as target, trim(p_type) as term, count(*) as support, count(*) % 2 = 1 as core from part where trim(p_type) <> '' group by 1, 2),
best as (select *, row_number() over (partition by lower(term) order by support desc, target, term) as place from p), kept as (select * from best where place = 1),
have as (select distinct p_brand as target, lower(trim(p_type)) as term from part where p_size = 1), known as (select distinct p_brand as target, lower(trim(p_type)) as term from part where p_size = 2)
select target, term, support, case when core then 'alias' else 'pending' end as became from kept k
where case when core then not exists (select 1 from have h where h.target = k.target and h.term = lower(k.term)) else not exists (select 1 from known h where h.target = k.target and h.term = lower(k.term)) end""")
def learn_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that targets learn.  A term that several ask for goes to the one with most support, to the first of equals.
    A core term becomes an alias unless the target has it; another becomes a pending suggestion unless it was suggested
    before, whatever came of it."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("target"), F.trim("p_type").alias("term"), "p_size")
    asked = rows.where("term <> ''").groupBy("target", "term").agg(F.count("*").alias("support")).withColumn("core", F.col("support") % 2 == 1)
    best = F.min_by(F.struct("target", "term", "support", "core"), F.struct((-F.col("support")).alias("s"), "target", "term"))
    kept = asked.groupBy(F.lower("term").alias("key")).agg(best.alias("b")).select("key", "b.*")
    of = lambda size: rows.where(F.col("p_size") == size).select("target", F.lower("term").alias("key")).distinct()
    aliases, suggested = kept.where("core").join(of(1), ["target", "key"], "left_anti"), kept.where("not core").join(of(2), ["target", "key"], "left_anti")
    became = lambda df, name: df.select("target", "term", "support", F.lit(name).alias("became"))
    return became(aliases, "alias").union(became(suggested, "pending"))


LEDGER = [
    (-1, "gemini", '{"model": "gemini-pro", "prompt_tokens": 12, "completion_tokens": 3, "total_tokens": 15}'), (-2, "gemini", '{"total_tokens": 9}'), (-3, "gemini", "{}"),
    (-4, "gemini", None), (-5, "gemini", "{not json"), (-6, "openai", '{"model": "", "prompt_tokens": 4}'), (-7, "openai", '{"model": "gpt-x"}'),
]
_COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens")


@query(f"""with {cases.values("l", LEDGER, "id bigint, provider string, usage string")}, a as (select * from l union all select event_id::bigint, 'p', case when event_id % 7 > 0 then '{{"model": "m' || event_id % 5 || '", "total_tokens": ' || floor(value)::bigint || '}}' end from events),
g as (select id, provider, case when json_valid(usage) then usage end as u from a) select id, coalesce(nullif(json_extract_string(u, '$.model'), ''), provider) as model, {", ".join(f"coalesce(json_extract_string(u, '$.{c}')::bigint, 0) as {c}" for c in _COUNTS)}
from g where len(json_keys(u)) > 0""")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that answers' usage adds to the ledger: under the model that the usage names, else the provider; missing
    counts are 0.  No usage, an empty or an unreadable one adds no row."""
    made = F.concat(F.lit('{"model": "m'), (F.col("event_id") % 5).cast("string"), F.lit('", "total_tokens": '), F.floor("value").cast("string"), F.lit("}"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint").alias("id"), F.lit("p").alias("provider"), F.when(F.col("event_id") % 7 > 0, made).alias("usage"))
    rows = cases.literal(spark, LEDGER, "id bigint, provider string, usage string").union(rows)
    read = rows.select("id", "provider", F.from_json("usage", "map<string,string>").alias("u")).where(F.size("u") > 0)
    counts = [F.coalesce(F.try_element_at("u", F.lit(c)), F.lit("0")).cast("bigint").alias(c) for c in _COUNTS]
    return read.select("id", F.coalesce(F.nullif(F.try_element_at("u", F.lit("model")), F.lit("")), "provider").alias("model"), *counts)


#: Plans that one pass of a back-fill may ask for.
PASS = 20


@query(f"""with t as (select c_custkey as id, c_custkey % 3 = 0 as has, c_custkey % 5 <> 0 as planned from customer), g as (select id from t where not has and planned order by id limit {PASS}), c as (select case when count(*) = {PASS} then max(id) end as last from g)
select id, case when c.last is not null and id > c.last then 'later' when has then 'kept' when planned then 'planned' else 'skipped' end as became from t, c""")
def profile_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over targets that lack aliases or official domains: the first PASS that get a plan are filled, those whose
    plan comes back empty are skipped, the rest wait for the next pass.  Filled ones are kept by it, so passes end."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), (key % 3 == 0).alias("has"), (key % 5 != 0).alias("planned"))
    last = rows.where("not has and planned").orderBy("id").limit(PASS).agg(F.when(F.count("*") == PASS, F.max("id")).alias("last"))  # one row
    became = F.when(F.col("last").isNotNull() & (F.col("id") > F.col("last")), "later").when(F.col("has"), "kept").when(F.col("planned"), "planned").otherwise("skipped")
    return rows.crossJoin(F.broadcast(last)).select("id", became.alias("became"))


#: The domains by which a login wall is put down to a platform, in order.
PLATFORMS = (("twitter", ("twitter.com", "x.com")), ("instagram", ("instagram.com",)), ("reddit", ("reddit.com",)), ("linkedin", ("linkedin.com",)), ("bilibili", ("bilibili.com",)), ("xiaohongshu", ("xiaohongshu.com",)))
AUTHS = [(1, "twitter", "Active"), (2, "twitter", "Active"), (3, "reddit", "Active"), (4, "linkedin", "Active"), (5, "bilibili", "Expired"), (6, "none", "Active")]
WALLS = [(3, "https://example.org/a"), (None, "https://x.com/someone"), (None, "https://example.org/login"), (99, "https://www.linkedin.com/in/a"), (None, "https://m.bilibili.com/v"), (0, "https://www.instagram.com/p"), (None, None)]
_PLATFORM = "case " + " ".join(f"when {' or '.join(f'''contains(url, '{d}')''' for d in domains)} then '{name}'" for name, domains in PLATFORMS) + " end"


@query(f"""with {cases.values("auth", AUTHS, "id bigint, platform string, status string")}, {cases.values("wall0", WALLS, "profile bigint, url string")}, wall as (select * from wall0 union all select case when contains(url, 'login') then page_id end, url from pages), p as (select nullif(profile, 0) as profile, {_PLATFORM} as platform from wall),
hit as (select distinct a.id from auth a join p on p.profile = a.id or (p.profile is null and p.platform = a.platform)) select id, platform, case when id in (select id from hit) then 'Expired' else status end as status, id in (select id from hit) as checked from auth""")
def auth_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins after the walls of a run: a wall expires the login that it names, or all of its address's platform."""
    auth = cases.literal(spark, AUTHS, "id bigint, platform string, status string")
    platform = F.lit(None).cast("string")
    for name, domains in reversed(PLATFORMS):
        platform = F.when(T.any_of(F.col("url"), domains), name).otherwise(platform)
    pages = table(spark, sf_dir, "pages").select(F.when(F.col("url").contains("login"), F.col("page_id")), "url")
    walls = cases.literal(spark, WALLS, "profile bigint, url string").union(pages).select(F.nullif("profile", F.lit(0)).alias("profile"), platform.alias("platform"))
    hit = walls.where("profile is not null").select(F.col("profile").alias("id")).union(auth.join(walls.where("profile is null"), "platform", "left_semi").select("id")).distinct()
    rows = auth.join(hit.withColumn("checked", F.lit(True)), "id", "left")
    return rows.select("id", "platform", F.when(F.col("checked"), "Expired").otherwise(F.col("status")).alias("status"), F.coalesce("checked", F.lit(False)).alias("checked"))


MODES = [(1, "pure_rss"), (2, "ai_fusion"), (3, None), (4, "other")]


@query(f"""with {cases.values("m0", MODES, "id bigint, mode string")}, m as (select * from m0 union all select 100 + c_custkey, case c_mktsegment when 'BUILDING' then 'pure_rss' when 'MACHINERY' then 'ai_fusion' when 'AUTOMOBILE' then null else lower(c_mktsegment) end from customer) select id, coalesce(mode, 'ai_fusion') as mode, coalesce(mode, 'ai_fusion') = 'pure_rss' as pure_rss from m""")
def app_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of the application: fusion unless it says otherwise; only pure_rss does without models."""
    mode = F.coalesce("mode", F.lit("ai_fusion"))
    segment = F.col("c_mktsegment")
    set_ = F.when(segment == "BUILDING", "pure_rss").when(segment == "MACHINERY", "ai_fusion").when(segment != "AUTOMOBILE", F.lower(segment))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey") + 100, set_)
    return cases.literal(spark, MODES, "id bigint, mode string").union(customers).select("id", mode.alias("mode"), (mode == "pure_rss").alias("pure_rss"))


TRACKED = [
    (1, "Rust", "HYBRID", '{"topic": "Rust language", "signals": [{"type": "keyword", "value": "rustc"}, {"type": "website", "value": "rust-lang.org"}]}', '{"keyword_strategy": "trusted_news_only"}'),
    (2, "Feed", "RSS_FEED", "https://example.org/feed.xml", '{"use_default_osint": true, "max_items_per_route": 30}'), (3, "Words", "KEYWORD_DISCOVERY", '["one", "two"]', '{"use_default_osint": true, "max_items_per_route": 25}'),
    (4, "Someone", "ACCOUNT", '{"handle": "x"}', "{bad"), (5, "Nobody", None, "", None), (6, "Bare", "HYBRID", '{"signals": []}', "{}"),
]
TRACK = "id bigint, name string, kind string, target string, policy string"
#: Kinds of intent by the source's.
INTENTS = (("HYBRID", "topic_discovery"), ("RSS_FEED", "single_feed_subscription"), ("KEYWORD_DISCOVERY", "keyword_discovery"))
_KINDS = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in INTENTS) + " else 'single_account_subscription' end"


@query(f"""with {cases.values("t0", TRACKED, TRACK)}, t as (select * from t0 union all select 100 + event_id, event_type, case event_type when 'view' then 'HYBRID' when 'click' then 'RSS_FEED' else 'KEYWORD_DISCOVERY' end, case event_type when 'view' then '{{"topic": "k", "signals": [{{"type": "keyword", "value": "' || user_id || '"}}]}}' when 'click' then 'https://' || user_id || '.example' else '["' || user_id || '"]' end, props from events), g as (select *, case when json_valid(target) then target end as t, case when json_valid(policy) then policy end as p from t)
select id, {_KINDS} as intent_type, coalesce(case when json_exists(t, '$.signals') then json_extract_string(t, '$.topic') end, name) as topic,
case when json_type(t) = 'ARRAY' then list_transform(t::varchar[], lambda x: 'keyword:' || x) when json_exists(t, '$.signals') then list_transform(json_extract(t, '$.signals[*]'), lambda x: json_extract_string(x, '$.type') || ':' || json_extract_string(x, '$.value'))
else ['website:' || target] end as signals, case when json_extract_string(p, '$.keyword_strategy') = 'trusted_news_only' then 'strict' when json_extract_string(p, '$.use_default_osint') = 'true' and coalesce(json_extract_string(p, '$.max_items_per_route')::int, 0) > 25 then 'broad' else 'balanced' end as profile from g""")
def target_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a target asks for in one form: kind, topic, signals (type:value) and how strict its policy is."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    asked = F.when(kind == "view", F.concat(F.lit('{"topic": "k", "signals": [{"type": "keyword", "value": "'), user, F.lit('"}]}')))
    asked = asked.when(kind == "click", F.concat(F.lit("https://"), user, F.lit(".example"))).otherwise(F.concat(F.lit('["'), user, F.lit('"]')))
    events = table(spark, sf_dir, "events").select(F.col("event_id") + 100, "event_type", F.when(kind == "view", "HYBRID").when(kind == "click", "RSS_FEED").otherwise("KEYWORD_DISCOVERY"), asked, "props")
    rows = cases.literal(spark, TRACKED, TRACK).union(events)
    kind = F.lit("single_account_subscription")
    for name, intent in reversed(INTENTS):
        kind = F.when(F.col("kind") == name, intent).otherwise(kind)
    signals = F.from_json(F.get_json_object("target", "$.signals"), "array<struct<type:string,value:string>>")
    words = F.from_json(F.when(F.trim("target").startswith("["), F.col("target")), "array<string>")
    said = F.coalesce(F.transform(words, lambda x: F.concat(F.lit("keyword:"), x)), F.transform(signals, lambda s: F.concat(s["type"], F.lit(":"), s["value"])), F.array(F.concat(F.lit("website:"), "target")))
    topic = F.coalesce(F.when(signals.isNotNull(), F.get_json_object("target", "$.topic")), "name")
    of = lambda c: F.get_json_object("policy", f"$.{c}")
    profile = F.when(of("keyword_strategy") == "trusted_news_only", "strict").when((of("use_default_osint") == "true") & (F.coalesce(of("max_items_per_route").cast("int"), F.lit(0)) > 25), "broad").otherwise("balanced")
    return rows.select("id", kind.alias("intent_type"), topic.alias("topic"), said.alias("signals"), profile.alias("profile"))


MONITORED = [(-1, "https://example.org/feed.xml", 30, '{"keep_keywords": ["a", "b"], "monitor_goal": "new_items"}'), (-2, "https://example.org/p", 60, '{"extract_selector": "#main"}'), (-3, "https://rsshub.app/x", 60, "{bad"), (-4, "", 5, '{"ignore_keywords": ["c"], "extract_selector": ""}')]
_FEED = f"(({_PATH.format(u='url')} like '%.xml' or {_PATH.format(u='url')} like '%.rss' or {_PATH.format(u='url')} like '%.atom') or {_HOST.format(u='url')} = 'rsshub.app')"
_WORDS = "coalesce(json_extract_string(p, '$.{}[*]'), [])"


@query(f"""with {cases.values("m", MONITORED, "id bigint, url string, minutes bigint, policy string")}, a as (select * from m union all select page_id, url, 60, null from pages), g as (select *, case when json_valid(policy) then policy end as p from a)
select id, case when {_FEED} then 'single_feed_subscription' else 'page_change_monitor' end as intent_type, url as target, case when coalesce(json_extract_string(p, '$.monitor_goal'), 'none') = 'none' and coalesce(json_extract_string(p, '$.extract_selector'), '') <> '' then 'article_change' else coalesce(json_extract_string(p, '$.monitor_goal'), 'none') end as goal,
{_WORDS.format('keep_keywords')} as keep, {_WORDS.format('ignore_keywords')} as ignored, minutes from g""")
def monitor_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a monitor asks for in one form: feed or page, goal, words to keep and to ignore, minutes between looks."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit(60).cast("bigint"), F.lit(None).cast("string"))
    rows = cases.literal(spark, MONITORED, "id bigint, url string, minutes bigint, policy string").union(pages)
    feed = T.host(F.col("url")) == "rsshub.app"
    for end in (".xml", ".rss", ".atom"):
        feed = feed | T.path(F.col("url")).endswith(end)
    of = lambda c: F.get_json_object("policy", f"$.{c}")
    words = lambda c: F.coalesce(F.from_json(of(c), "array<string>"), F.expr("cast(array() as array<string>)"))
    goal = F.coalesce(of("monitor_goal"), F.lit("none"))
    goal = F.when((goal == "none") & (F.coalesce(of("extract_selector"), F.lit("")) != ""), "article_change").otherwise(goal)
    return rows.select("id", F.when(feed, "single_feed_subscription").otherwise("page_change_monitor").alias("intent_type"), F.col("url").alias("target"), goal.alias("goal"), words("keep_keywords").alias("keep"), words("ignore_keywords").alias("ignored"), "minutes")


ENTRIES = [(-1, "Tue, 02 Jul 2024 17:04:00 GMT"), (-2, "02 Jul 2024 17:04:00 -0500"), (-3, "Mon, 1 Jan 2024 00:30:00 +0530"), (-4, ""), (-5, None), (-6, "yesterday"), (-7, "2024-07-02T17:04:00Z"), (-8, "2024-07-02T23:04:00+06:00")]
_MAIL = "try_strptime(regexp_replace(regexp_replace(dated, '^[A-Za-z]{3}, ', ''), ' (?:GMT|UTC|Z)$', ' +0000'), '%d %b %Y %H:%M:%S %z')"


@query(f"""with {cases.values("e", ENTRIES, "id bigint, dated string")}, a as (select * from e union all select event_id::bigint, strftime(ts, '%d %b %Y %H:%M:%S') || ' +0200' from events)
select id, (coalesce({_MAIL}, try_strptime(replace(dated, 'Z', '+00:00'), '%Y-%m-%dT%H:%M:%S%z')) at time zone 'UTC')::timestamp as published from a""")
def entry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant, in UTC, of a feed entry's date with its zone; null where none can be read, never the present."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("bigint"), F.concat(F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0200")))
    rows = cases.literal(spark, ENTRIES, "id bigint, dated string").union(rows)
    mail = F.regexp_replace(F.regexp_replace("dated", "^[A-Za-z]{3}, ", ""), " (?:GMT|UTC|Z)$", " +0000")
    read = F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("dated", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return rows.select("id", F.to_utc_timestamp(read, F.current_timezone()).cast("timestamp_ntz").alias("published"))


@query("select (i - 1)::int as i, count(*) as n, round(avg(v), 6) as mean from (select unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as v from embeddings) group by 1")
def state_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running sum of vectors, kept in a folder between passes: a pass reads the state, adds its batch and writes the
    next version beside it, so readers see a whole state whatever happens.  Here two passes, the halves of the table."""
    kept = new_folder(spark, "state")
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("half"), F.col("embedding").alias("v"))
    for version in (0, 1):
        batch = rows.where(F.col("half") == version)
        fresh = V.mean_vector(batch, "v").crossJoin(batch.agg(F.count("v").alias("n"))).select(F.posexplode("mean").alias("i", "mean"), "n").select("i", "n", (F.col("mean") * F.col("n")).alias("total"))
        if version:
            fresh = fresh.union(spark.read.parquet(f"{kept}/{version - 1}")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        fresh.write.parquet(f"{kept}/{version}")
    return spark.read.parquet(f"{kept}/1").select("i", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


@query("""with now as (select max(ts) as t from events), e as (select user_id as host, max(ts) filter (event_type = 'error') + interval '1 day' as until, max(ts) filter (event_type <> 'error') as good, count(*) as seen, count(*) filter (event_type = 'purchase') as served from events group by 1),
s as (select user_id as host, count(*) as streak from events join e on e.host = user_id where event_type = 'error' and coalesce(ts > good, true) group by 1)
select e.host, case when until > t then floor(epoch(until - t))::bigint end as cooling_seconds, coalesce(streak, 0) as error_streak, seen, served from e left join s using (host), now""")
def pacing_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's state at the last event: seconds that it still cools down (a day from its last error), errors since its
    last good answer, answers seen and served.  Two aggregations by host, the second after a join on the first."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), "ts", "event_type")
    bad = F.col("event_type") == "error"
    hosts = rows.groupBy("host").agg(
        (F.max(F.when(bad, F.col("ts"))) + F.expr("interval '1' day")).alias("until"), F.max(F.when(~bad, F.col("ts"))).alias("good"), F.count("*").alias("seen"), F.count_if(F.col("event_type") == "purchase").alias("served")
    )
    streaks = rows.where(bad).join(hosts.select("host", "good"), "host").where(F.coalesce(F.col("ts") > F.col("good"), F.lit(True))).groupBy("host").agg(F.count("*").alias("streak"))
    now = rows.agg(F.max("ts").alias("now"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = F.floor((micros("until") - micros("now")) / 1000000)
    found = hosts.join(streaks, "host", "left").crossJoin(F.broadcast(now))
    return found.select("host", F.when(F.col("until") > F.col("now"), left).alias("cooling_seconds"), F.coalesce("streak", F.lit(0)).alias("error_streak"), "seen", "served")


VERDICTS = [(-1, "[3, 5]", "[7]"), (-2, "[]", "[5]"), (-3, None, None), (-4, "{bad", "[5, 5]"), (-5, "[55]", "[]"), (-6, "5", "[1]")]
#: The target that is asked for.
ASKED = 5
_IN = "coalesce(list_contains(try_cast(case when json_valid({0}) then {0} end as bigint[]), {1}), false)"


@query(f"""with {cases.values("v", VERDICTS, "id bigint, relevant string, irrelevant string")}, a as (select * from v union all select o_orderkey, '[' || o_custkey % 10 || ', 11]', '[' || (o_custkey + 1) % 10 || ']' from orders)
select id, {_IN.format('relevant', ASKED)} as relevant, {_IN.format('irrelevant', ASKED)} as irrelevant from a where {_IN.format('relevant', ASKED)} or {_IN.format('irrelevant', ASKED)}""")
def target_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with a verdict on one target, by their lists of target ids in JSON; an unreadable list holds none."""
    text = lambda at: F.concat(F.lit("["), (at % 10).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(text(F.col("o_custkey")), F.lit(", 11]")), F.concat(text(F.col("o_custkey") + 1), F.lit("]")))
    rows = cases.literal(spark, VERDICTS, "id bigint, relevant string, irrelevant string").union(rows)
    holds = lambda c: F.coalesce(F.array_contains(F.from_json(F.when(F.trim(c).startswith("["), F.col(c)), "array<bigint>"), ASKED), F.lit(False))
    return rows.select("id", holds("relevant").alias("relevant"), holds("irrelevant").alias("irrelevant")).where("relevant or irrelevant")


@query("""with d as (select user_id, date_trunc('day', max(ts)) as start from events group by 1) select user_id, start, count(*) as calls, sum(floor(value)::bigint)::bigint as tokens from events join d using (user_id) where ts >= start group by 1, 2""")
def day_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each account spent since the start, in UTC, of its last day."""
    rows = table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.floor("value").cast("bigint").alias("tokens"))
    days = rows.groupBy("user_id", "day").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))  # as few as days
    last = days.groupBy("user_id").agg(F.max_by(F.struct("day", "calls", "tokens"), "day").alias("d"))
    return last.select("user_id", F.col("d.day").alias("start"), "d.calls", "d.tokens")


@query("""with r as (select o_custkey as run, l_returnflag = 'A' as saved, l_returnflag <> 'N' as fetched, l_linestatus = 'O' as delivered, l_quantity::bigint as items from lineitem join orders on o_orderkey = l_orderkey),
a as (select run, count(*) as routes, coalesce(sum(items) filter (saved), 0)::bigint as saved, bool_or(fetched) as reached, bool_or(fetched and delivered) as delivered from r group by 1)
select run, routes, saved, case when saved > 0 then 'SUCCESS' when reached then 'NO_NEW_ITEMS' else 'FAILED' end as status, case when saved > 0 or (reached and delivered) then null when reached then 'Routes reachable but returned 0 items' else 'No executable routes resolved' end as error from a""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a run over routes ends: it saved something, reached routes that had nothing new, or reached none."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run"))
    reached = F.col("l_returnflag") != "N"
    rows = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")
    runs = rows.groupBy("run").agg(
        F.count("*").alias("routes"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("bigint"))), F.lit(0)).alias("saved"), F.bool_or(reached).alias("reached"), F.bool_or(reached & (F.col("l_linestatus") == "O")).alias("delivered")
    )
    done = F.col("saved") > 0
    status = F.when(done, "SUCCESS").when(F.col("reached"), "NO_NEW_ITEMS").otherwise("FAILED")
    error = F.when(done | (F.col("reached") & F.col("delivered")), None).when(F.col("reached"), "Routes reachable but returned 0 items").otherwise("No executable routes resolved")
    return runs.select("run", "routes", "saved", status.alias("status"), error.alias("error"))


#: Fixed value: hosts whose items only firehoses deliver.
FIREHOSE_ITEMS = ("arxiv.org",)
STAMPED = [
    (-1, "https://deepmind.google/blog/new-model", "curated"), (-2, "https://arxiv.org/abs/2401.00001", "primary"), (-3, "https://export.arxiv.org/abs/1", "curated"), (-4, "https://www.nasa.gov/x", None), (-5, "https://example.org/x", None),
    (-6, "https://openai.com/customer-stories/a", "curated"), (-7, None, None), (-8, "https://openai.com/index/a", "aggregated"), (-9, "https://arxiv.org.example.org/", "primary"), (-10, "https://github.com/a/b", "curated"), (-11, "https://www.nasa.gov/careers/", None),
]
_FIRST_PARTY = f"({' or '.join(f'''h like '%{s}' ''' for s in T.FIRST_PARTY_SUFFIXES)} or {_under('h', T.FIRST_PARTY_DOMAINS)})"
_TRUSTED = f"{_FIRST_PARTY} and not {_any('p', T.MARKETING)} and not ({_under('h', T.CODE_HOSTS)} and not {_any('p', T.OFFICIAL_PATHS)})"


@query(f"""with {cases.values("s", STAMPED, "id bigint, url string, tier string")}, a as (select * from s union all select page_id, url, case page_id % 3 when 0 then 'curated' when 1 then 'primary' end from pages),
b as (select id, tier, {_HOST.format(u="coalesce(url, '')")} as h, {_PATH.format(u="coalesce(url, '')")} as p from a)
select id, case when tier is null and {_FIRST_PARTY} then 'primary' when tier is null then 'aggregated' when tier <> 'aggregated' and {_under('h', FIREHOSE_ITEMS)} then 'aggregated' when tier = 'curated' and {_TRUSTED} then 'primary' else tier end as tier from b""")
def restamped_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of stored articles put right: a missing one by the address's floor, what only firehoses deliver aggregated, a
    curated one primary where the first-party floor has since grown to hold it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "curated").when(F.col("page_id") % 3 == 1, "primary"))
    rows = cases.literal(spark, STAMPED, "id bigint, url string, tier string").union(pages)
    url, tier = F.col("url"), F.col("tier")
    fresh = F.when(T.first_party(url), "primary").otherwise("aggregated")
    new = F.when(tier.isNull(), fresh).when((tier != "aggregated") & T.under(T.host(url), FIREHOSE_ITEMS), "aggregated").when(tier == "curated", T.tier_of(url, tier)).otherwise(tier)
    return rows.select("id", new.alias("tier"))


@query(f"""with {MEMBERS}, a as (select thread_id, count(distinct publisher) as publishers, bool_or(tier = 'primary') as has, bool_or(no = 7) as unstamped from member group by 1),
t as (select *, case when thread_id % 3 = 0 then 'CONFIRMED' when publishers >= 2 then 'CORROBORATED' else 'LEAD' end as lifecycle from a)
select thread_id, case when lifecycle = 'CONFIRMED' and not has and not unstamped then case when publishers >= 2 then 'CORROBORATED' else 'LEAD' end else lifecycle end as lifecycle, lifecycle = 'CONFIRMED' and not has and not unstamped as demoted from t""")
def demoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads confirmed without a primary member fall to what their publishers earn; those with a member that has no
    stamp (here the seventh) are left alone."""
    rows = members(spark, sf_dir).groupBy("thread_id", "publisher").agg(F.bool_or(F.col("tier") == "primary").alias("has"), F.bool_or(F.col("no") == 7).alias("unstamped"))
    found = rows.groupBy("thread_id").agg(F.count("publisher").alias("publishers"), F.bool_or("has").alias("has"), F.bool_or("unstamped").alias("unstamped"))
    earned = F.when(F.col("publishers") >= 2, "CORROBORATED").otherwise("LEAD")
    lifecycle = F.when(F.col("thread_id") % 3 == 0, "CONFIRMED").otherwise(earned)
    found = found.withColumn("lifecycle", lifecycle).withColumn("demoted", (F.col("lifecycle") == "CONFIRMED") & ~F.col("has") & ~F.col("unstamped"))
    return found.select("thread_id", F.when(F.col("demoted"), earned).otherwise(F.col("lifecycle")).alias("lifecycle"), "demoted")


@query("""with s as (select user_id as source, arg_max(k, (ts, event_id)) as k, count(*) filter (event_type = 'error') as failures, count(*) filter (event_type = 'purchase') as good from (select *, json_extract_string(props, '$.k')::int % 3 as k from events) group by 1),
t as (select *, case k when 0 then 'RATE_LIMITED' when 1 then 'UNKNOWN_ERROR' else 'TIMEOUT' end as kind from s)
select source, kind, case when kind = 'RATE_LIMITED' or (kind = 'UNKNOWN_ERROR' and good = 0) then 0 else failures end as failures, kind = 'RATE_LIMITED' or (kind = 'UNKNOWN_ERROR' and good = 0) as released from t""")
def released_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose failures weren't their own start afresh: refused for a whole host, or never answered and failed for
    no known reason."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(
        F.max_by(k, F.struct("ts", "event_id")).alias("k"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("event_type") == "purchase").alias("good")
    )
    kind = F.when(F.col("k") == 0, "RATE_LIMITED").when(F.col("k") == 1, "UNKNOWN_ERROR").otherwise("TIMEOUT")
    released = (F.col("kind") == "RATE_LIMITED") | ((F.col("kind") == "UNKNOWN_ERROR") & (F.col("good") == 0))
    return rows.withColumn("kind", kind).select("source", "kind", F.when(released, 0).otherwise(F.col("failures")).alias("failures"), released.alias("released"))


#: Where the links that a summary cites begin and end.
ANNEX, BESIDE, LINK = "摘要引用来源", "重复/佐证来源", r"\]\((https?://[^)]+)\)"
_SUMMARY = f"'text [x](https://no.example/1) {ANNEX}' || case when m.page_id % 4 = 0 then '' else chr(10) || '- [one](' || m.url || ')' || chr(10) || '- [two](https://other.example/)' end || case when m.page_id % 5 = 0 then '' else ' {BESIDE} [three](' || coalesce(n.url, 'https://gone.example/') || ')' end"


@query(f"""with s as (select m.page_id // 2 as thread_id, {_SUMMARY} as summary from pages m left join pages n on n.page_id = m.page_id + 1 where m.page_id % 2 = 0),
c as (select thread_id, unnest(regexp_extract_all(split_part(substr(summary, position('{ANNEX}' in summary) + length('{ANNEX}')), '{BESIDE}', 1), '\\]\\((https?://[^)]+)\\)', 1)) as url from s)
select c.thread_id, list_sort(list(distinct page_id)) as cited from c join pages p on p.url = c.url and p.page_id // 2 = c.thread_id group by 1""")
def cited_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members that a summary cites, from the links of its annex: not those before it, nor those listed beside.  Pages
    come in threads of two; a thread whose annex links to none of its members has no row."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("page_id div 2").alias("thread_id"))
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    leads = pages.where("page_id % 2 = 0").join(after, "page_id", "left")
    links = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("\n- [one]("), "url", F.lit(")\n- [two](https://other.example/)")))
    beside = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit(f" {BESIDE} [three]("), F.coalesce("next", F.lit("https://gone.example/")), F.lit(")")))
    summary = F.concat(F.lit(f"text [x](https://no.example/1) {ANNEX}"), links, beside)
    annex = F.substring_index(F.element_at(F.split("summary", ANNEX, 2), 2), BESIDE, 1)
    cited = leads.select("thread_id", summary.alias("summary")).select("thread_id", F.explode(F.regexp_extract_all(annex, F.lit(LINK), F.lit(1))).alias("url"))
    return cited.join(pages, ["thread_id", "url"]).groupBy("thread_id").agg(F.sort_array(F.collect_set("page_id")).alias("cited"))


@query(f"""with {THREADS}, a as (select id, id % 3 = 0 as gated, id % 4 = 0 as processed from (select doc_id as id from documents))
select 'thread' as kind, thread_id as id, case when summarised then publishers end as fused_sources, case when summarised then lifecycle end as fused_lifecycle, null::boolean as processed from thread union all select 'article', id, null, null, processed or gated from a""")
def fused_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summarised threads get the snapshot of their last fusion from their present figures; gated articles are settled."""
    of = F.col("summarised")
    rows = threads(spark, sf_dir).select(F.lit("thread").alias("kind"), F.col("thread_id").alias("id"), F.when(of, F.col("publishers")).alias("fused_sources"), F.when(of, F.col("lifecycle")).alias("fused_lifecycle"), F.lit(None).cast("boolean").alias("processed"))
    settled = table(spark, sf_dir, "documents").select(F.lit("article"), "doc_id", F.lit(None).cast("bigint"), F.lit(None).cast("string"), (F.col("doc_id") % 4 == 0) | (F.col("doc_id") % 3 == 0))
    return rows.union(settled)


@query(f"""with {THREADS}, f as (select thread_id, bool_or(tier = 'primary') as p, bool_or(publisher % 7 = 0) as a from member group by 1),
g as (select t.*, p, a, thread_id % 4 as before, case lifecycle when 'CONFIRMED' then 2 when 'CORROBORATED' then 1 else 0 end > thread_id % 3 as risen from thread t join f using (thread_id)),
d as (select *, case when thread_id % 11 = 0 then 'no target' when thread_id % 13 = 0 then 'elsewhere' when summarised and not (risen or (publishers > before and (before = 0 or (publishers - before) / before >= 0.25))) then 'kept'
  when not (p or a or lifecycle = 'CONFIRMED' or high_attention or resonant or publishers >= 3) then 'gated' when not summarised and publishers < 2 then 'extractive' when summarised then 'updated' else 'fused' end as decision from g)
select thread_id, decision, case when decision in ('extractive', 'updated', 'fused') then publishers else before end as fused_sources from d""")
def fusion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass of fusion does with each thread, the first rule that holds: nobody's news, told on another thread, no
    material growth since its summary, not worth one, one account that is quoted, else a synthesis, new or updated; and
    the publishers that its last fusion saw from then on."""
    flags = members(spark, sf_dir).groupBy("thread_id").agg(F.bool_or(F.col("tier") == "primary").alias("p"), F.bool_or(F.col("publisher") % 7 == 0).alias("a"))
    before = F.col("thread_id") % 4
    grown = material(F.col("thread_id") % 3, rank(F.col("lifecycle")), before, F.col("publishers"))
    worth = worth_summary(F.col("p"), F.col("a"), F.col("lifecycle"), F.col("high_attention"), F.col("resonant"), F.col("publishers"))
    told = F.col("summarised")
    decision = F.when(F.col("thread_id") % 11 == 0, "no target").when(F.col("thread_id") % 13 == 0, "elsewhere").when(told & ~grown, "kept").when(worth == "none", "gated")
    decision = decision.when(~told & (F.col("publishers") < 2), "extractive").when(told, "updated").otherwise("fused")
    rows = threads(spark, sf_dir).join(flags, "thread_id").withColumn("decision", decision)
    return rows.select("thread_id", "decision", F.when(F.col("decision").isin("extractive", "updated", "fused"), F.col("publishers")).otherwise(before).alias("fused_sources"))
