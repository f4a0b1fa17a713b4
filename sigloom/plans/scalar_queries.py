"""Small rules of one row: times, lists in JSON, labels, summaries, sources, keys and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.functions import vectors as V
from sigloom.operators.threads import RESONANT, resonance
from sigloom.plans.base import query, table
from sigloom.plans.texts import _HOST
from sigloom.plans.vector_queries import _MEAN
from sigloom.sources import cases
from sigloom.sources.bind import ARTICLES, THREADS, articles, threads

TIMES = [(1, "2024-03-01T10:00:00+02:00"), (2, "2024-03-01T10:00:00Z"), (3, "2024-03-01T10:00:00"), (4, "2024-02-29T23:59:59-05:30"), (5, "not a time"), (6, None)]


@query(f"""with {cases.values("t0", TIMES, "id bigint, text string")}, t as (select * from t0 union all select 100 + event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case event_type when 'click' then '+02:00' when 'view' then 'Z' when 'error' then ' no' else '' end from events), z as (select id, text, case when regexp_matches(text, '(Z|[+-]\\d\\d:\\d\\d)$') then text else text || 'Z' end as zoned from t)
select id, timestamp '1970-01-01' + to_seconds(epoch(try_cast(zoned as timestamptz))::bigint) as "at" from z""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as written, with or without an offset, as UTC without one; what is no time is null."""
    offset = F.when(F.col("event_type") == "click", "+02:00").when(F.col("event_type") == "view", "Z").when(F.col("event_type") == "error", " no").otherwise("")
    events = table(spark, sf_dir, "events").select(F.col("event_id") + 100, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset))
    rows = cases.literal(spark, TIMES, "id bigint, text string").union(events)
    zoned = F.when(F.col("text").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.col("text")).otherwise(F.concat("text", F.lit("Z")))
    seconds = F.unix_seconds(zoned.try_cast("timestamp"))
    return rows.select("id", (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)).alias("at"))


@query("""with n as (select max(ts) as now from events), l as (select user_id, max(case when event_type = 'purchase' then ts end) as last from events group by 1)
select user_id, case when last is null then now - interval '1 day' else greatest(last, now - interval '3 days') end as start from l, n""")
def briefing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a briefing starts: at the last one, three days ago at most; a day ago if there was none."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"))
    rows = last.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))  # one row
    since = F.greatest("last", F.col("now") - F.expr("interval 3 days"))
    return rows.select("user_id", F.when(F.col("last").isNull(), F.col("now") - F.expr("interval 1 day")).otherwise(since).alias("start"))


LISTS = [(1, '["a", "b"]'), (2, "[]"), (3, "bad"), (4, None), (5, '["a"'), (6, ""), (7, '["x, y", "z"]')]


@query(f"""with {cases.values("t0", LISTS, "id bigint, text string")}, t as (select * from t0 union all select 100 + event_id, case event_type when 'error' then 'error' else '["' || event_type || '", "' || user_id || '"]' end from events) select id, case when json_valid(text) then from_json(text, '["VARCHAR"]') else cast([] as varchar[]) end as items from t""")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in JSON; what is none is empty."""
    written = F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]'))
    events = table(spark, sf_dir, "events").select(F.col("event_id") + 100, F.when(F.col("event_type") == "error", "error").otherwise(written))
    rows = cases.literal(spark, LISTS, "id bigint, text string").union(events)
    return rows.select("id", F.coalesce(F.from_json("text", "array<string>"), F.expr("cast(array() as array<string>)")).alias("items"))


@query("""with a as (select event_id, case event_id % 3 when 0 then 'FactCheck: ' || event_type || ' ' when 1 then event_type else 'FactCheck:  ' end as action from events)
select event_id, case when starts_with(action, 'FactCheck:') then coalesce(nullif(trim(substr(action, 11)), ''), 'unknown') end as target from a""")
def fact_check_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target that an action of the ledger names."""
    kind = F.col("event_id") % 3
    action = F.when(kind == 0, F.concat(F.lit("FactCheck: "), "event_type", F.lit(" "))).when(kind == 1, F.col("event_type")).otherwise("FactCheck:  ")
    rows = table(spark, sf_dir, "events").select("event_id", action.alias("action"))
    named = F.coalesce(F.nullif(F.trim(F.substring("action", 11, 1 << 30)), F.lit("")), F.lit("unknown"))
    return rows.select("event_id", F.when(F.col("action").startswith("FactCheck:"), named).alias("target"))


#: The names of the languages that narrate.
NARRATION = {"zh": "Chinese (简体中文)", "en": "English", "ko": "Korean (한국어)", "ja": "Japanese (日本語)", "ru": "Russian (Русский)"}


@query(f"select doc_id, case lower(lang) {' '.join(f'when {k!r} then {v!r}' for k, v in NARRATION.items())} else '{NARRATION['zh']}' end as label from documents")
def narration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of a text's language; Chinese where it has none."""
    names = F.create_map(*[F.lit(x) for pair in NARRATION.items() for x in pair])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(names, F.lower("lang")), F.lit(NARRATION["zh"])).alias("label"))


LINKS = [
    (1, "https://news.google.com/x", "Headline - The Register", None), (2, "https://news.google.com/x", "Headline without one", "aggregated"), (3, "https://www.theregister.com/a", "Headline - The Register", None), (4, "https://www.bing.com/n", "A – B — C Daily ", None),
    (5, "https://x.com/someone", "t", "curated"), (6, "https://blog.google/a", "t", "curated"), (7, "https://blog.google/a", "t", None), (8, "https://example.org/a", "t", "primary"), (9, "https://rsshub.app/a", "t", "aggregated"), (10, "https://old.reddit.com/r/a", "t - b c", "aggregated"),
]
LINK = "id bigint, url string, title string, tier string"
#: Hosts that show others' news; hosts of social media; parts of hosts that make feeds; kinds in their order.
AGGREGATORS = ("news.google.com", "google.com", "bing.com")
SOCIAL = ("x.com", "twitter.com", "reddit.com", "news.ycombinator.com", "weibo.com", "bilibili.com", "xiaohongshu.com", "instagram.com", "tiktok.com")
GENERATED = ("rsshub", "nitter", "news.google.com")
KINDS = ("first_party", "media", "generated_feed", "social")
_BARE = f"regexp_replace({_HOST.format(u='url')}, '^www\\.', '')"
_PARTY = " or ".join([*[f"h like '%{s}'" for s in T.FIRST_PARTY_SUFFIXES], *[f"h = '{d}' or h like '%.{d}'" for d in T.FIRST_PARTY_DOMAINS]])
_HAS = lambda names: " or ".join(f"contains(h, '{n}')" for n in names)


@query(f"""with {cases.values("link0", LINKS, LINK)}, {ARTICLES}, link as (select * from link0 union all select 100 + page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' - Some Paper', null from pages union all select 1000000 + id, 'https://news.google.com/' || id, title || ' - ' || publisher, tier from article), h as (select *, {_BARE} as h, trim(regexp_extract(title, '\\s+[-–—]\\s+([^-–—]{{2,42}})\\s*$', 1)) as named from link)
select id, case when ({" or ".join(f"h = '{a}' or h like '%.{a}'" for a in AGGREGATORS)}) and named <> '' then named else h end as shown,
  case when tier = 'primary' or (tier is null and ({_PARTY})) then 'first_party' when {_HAS(SOCIAL)} then 'social' when {_HAS(GENERATED)} then 'generated_feed' else 'media' end as kind from h""")
def shown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source to show for a link, and its kind."""
    bare = F.regexp_replace(T.host(F.col("url")), r"^www\.", "")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id") + 100, "url", F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" - Some Paper")), F.lit(None).cast("string"))
    news = articles(spark, sf_dir).select(F.col("id") + 1_000_000, F.concat(F.lit("https://news.google.com/"), F.col("id").cast("string")), F.concat("title", F.lit(" - "), "publisher"), "tier")
    rows = cases.literal(spark, LINKS, LINK).union(pages).union(news).withColumn("h", bare)
    named = F.trim(F.regexp_extract("title", r"\s+[-–—]\s+([^-–—]{2,42})\s*$", 1))
    party = (F.col("tier") == "primary") | (F.col("tier").isNull() & T.first_party(F.col("url")))
    kind = F.when(party, "first_party").when(T.any_of(F.col("h"), SOCIAL), "social").when(T.any_of(F.col("h"), GENERATED), "generated_feed").otherwise("media")
    return rows.select("id", F.when(T.under(F.col("h"), AGGREGATORS) & (named != ""), named).otherwise(F.col("h")).alias("shown"), kind.alias("kind"))


SUMMARIES = [
    (1, "[TITLE: A short head]\n\nThe body.\n\n---\nwhere it comes from", "default"), (2, "no title here", "a default title that is far longer than eighty characters, as the text of a post can be, and is cut"), (3, "[TITLE: only a head]", "d"), (4, None, "d"),
    (5, "[TITLE:   ]\n\nbody", "d"), (6, "[TITLE: x]\n\n  \n\n---\nannex", "d"),
]
SUMMARY = "id bigint, summary string, title string"


@query(f"""with {cases.values("s0", SUMMARIES, SUMMARY)}, {ARTICLES}, s as (select * from s0 union all select 100 + id, case tier when 'primary' then content else '[TITLE: ' || title || ']

' || content || '

---
' || url end, title from article), p as (select *, starts_with(coalesce(summary, ''), '[TITLE: ') and contains(summary, ']\n\n') as whole, string_split(summary, '\n\n---\n')[1] as head from s),
q as (select *, instr(head, ']\n\n') as cut from p),
r as (select *, case when starts_with(summary, '[TITLE:') and cut > 0 then trim(substr(head, 8, cut - 8)) end as t, case when starts_with(summary, '[TITLE:') and cut > 0 then trim(substr(head, cut + 3), ' \n') end as b from q)
select id, case when whole then substr(summary, 9, instr(summary, ']\n\n') - 9) when length(title) > 80 then substr(title, 1, 77) || '...' else title end as card_title,
  case when whole then substr(summary, instr(summary, ']\n\n') + 3) else summary end as card_body, case when t <> '' and b <> '' then t || '\n\n' || b end as previous from r""")
def summary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body of a stored summary, and its written part without what follows it."""
    written = F.concat(F.lit("[TITLE: "), "title", F.lit("]\n\n"), "content", F.lit("\n\n---\n"), "url")
    stored = articles(spark, sf_dir).select(F.col("id") + 100, F.when(F.col("tier") == "primary", F.col("content")).otherwise(written), "title")
    rows = cases.literal(spark, SUMMARIES, SUMMARY).union(stored)
    at = F.position(F.lit("]\n\n"), F.col("summary"))
    whole = F.coalesce(F.col("summary").startswith("[TITLE: ") & (at > 0), F.lit(False))
    title = F.when(whole, F.expr("substring(summary, 9, position(']\\n\\n', summary) - 9)")).when(F.length("title") > 80, F.concat(F.substring("title", 1, 77), F.lit("..."))).otherwise(F.col("title"))
    body = F.when(whole, F.substring("summary", at + 3, F.length("summary"))).otherwise(F.col("summary"))
    rows = rows.select("id", title.alias("card_title"), body.alias("card_body"), "summary", F.substring_index("summary", "\n\n---\n", 1).alias("head"))
    cut = F.position(F.lit("]\n\n"), F.col("head"))
    has = F.col("summary").startswith("[TITLE:") & (cut > 0)
    t, b = F.trim(F.substring("head", F.lit(8), cut - 8)), F.trim(F.substring("head", cut + 3, F.length("head")), F.lit(" \n"))
    return rows.select("id", "card_title", "card_body", F.when(has & (t != "") & (b != ""), F.concat(t, F.lit("\n\n"), b)).alias("previous"))


SCRIPTS = [(-1, "abc 한국 日本"), (-2, "漢字 と かな"), (-3, "カタカナ"), (-4, "plain"), (-5, None), (-6, "x 文")]


@query(f"""with {cases.values("c", SCRIPTS, "doc_id bigint, text string")}, a as (select * from c union all select doc_id, text from documents), f as (select doc_id, regexp_extract(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}\\x{{4e00}}-\\x{{9fff}}]') as ch from a)
select doc_id, case when ch between chr(12352) and chr(12543) then 'ja' when ch between chr(44032) and chr(55215) then 'ko' when ch <> '' then 'zh' else 'en' end as narration from f""")
def narration_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of narration: that of the first letter whose script tells one."""
    rows = cases.literal(spark, SCRIPTS, "doc_id bigint, text string").union(table(spark, sf_dir, "documents").select("doc_id", "text"))
    first = F.regexp_extract("text", "[\\u3040-\\u30ff\\uac00-\\ud7af\\u4e00-\\u9fff]", 0)
    rows = rows.select("doc_id", first.alias("ch"))
    return rows.select("doc_id", F.when(F.col("ch").rlike("[\\u3040-\\u30ff]"), "ja").when(F.col("ch").rlike("[\\uac00-\\ud7af]"), "ko").when(F.col("ch") != "", "zh").otherwise("en").alias("narration"))


@query(f"""with {ARTICLES} select id, list_sort(list_distinct(regexp_extract_all(lower(title), '[0-9a-z一-鿿]+'))) as tokens, regexp_replace(lower(title), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]+', '', 'g') as key from article""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's tokens of a title, and the key by which terms are compared."""
    low = F.lower("title")
    key = F.regexp_replace(low, "[^0-9a-z\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af]+", "")
    return articles(spark, sf_dir).select("id", F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit("[0-9a-z一-鿿]+"), F.lit(0)))).alias("tokens"), key.alias("key"))


@query("select page_id, round(3 + ('0x' || substr(sha256(url), 1, 8))::bigint / 4294967295.0 * (12 - 3), 6)::double as delay from pages")
def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delay of 3 to 12 seconds that the address sets."""
    share = F.conv(F.substring(F.sha2("url", 256), 1, 8), 16, 10).cast("bigint") / 4294967295.0
    return table(spark, sf_dir, "pages").select("page_id", F.round(3 + share * (12 - 3), 6).alias("delay"))


VECTORS = [(1, "[1, 2.5, -3e-1]"), (2, ""), (3, "[]x"), (4, "[1, , 2]"), (5, "{}"), (6, "[1, 2"), (7, None), (8, "[]"), (9, " [0.5] ")]
_NUMBER = r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
STRICT = rf"^\s*\[\s*({_NUMBER}(\s*,\s*{_NUMBER})*)?\s*\]\s*$"


@query(f"""with {cases.values("t0", VECTORS, "id bigint, text string")}, t as (select * from t0 union all select 1000 + l_orderkey * 10 + l_linenumber, '[' || l_orderkey || case l_returnflag when 'A' then ', ' when 'R' then ',, ' else ' ,-' end || l_linenumber || '.5]' from lineitem) select id, regexp_matches(coalesce(text, ''), '{STRICT}') as valid, case when regexp_matches(coalesce(text, ''), '{STRICT}') then from_json(text, '["DOUBLE"]') end as vector from t""")
def vector_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in JSON, read strictly: what isn't a list of numbers is marked and has no vector."""
    between = F.when(F.col("l_returnflag") == "A", ", ").when(F.col("l_returnflag") == "R", ",, ").otherwise(" ,-")
    lines = table(spark, sf_dir, "lineitem").select(1000 + F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.concat(F.lit("["), F.col("l_orderkey").cast("string"), between, F.col("l_linenumber").cast("string"), F.lit(".5]")))
    rows = cases.literal(spark, VECTORS, "id bigint, text string").union(lines)
    valid = F.coalesce("text", F.lit("")).rlike(STRICT)
    return rows.select("id", valid.alias("valid"), F.when(valid, F.from_json("text", "array<double>")).alias("vector"))


@query("""with l as (select conv_id, turn, string_split(text, ' ') as l from conversations) select conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as lines from l""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a text, each where it first stands."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ", -1)), " ").alias("lines"))


@query(f"""with {ARTICLES}, t as (select publisher, title || ' ' || substr(content, 1, 300) as t from article)
select publisher, bool_or(regexp_matches(t, '[\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}\\x{{0400}}-\\x{{04ff}}\\x{{4e00}}-\\x{{9fff}}]')) as foreign_, not bool_and(regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]')) as needs_translation from t group by 1""")
def needs_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any item of a source is in another language than English, and whether any is in another than Chinese."""
    language = T.language(F.concat("title", F.lit(" "), F.substring("content", 1, 300)))
    rows = articles(spark, sf_dir).select("publisher", language.alias("l"))
    return rows.groupBy("publisher").agg(F.bool_or(F.col("l") != "en").alias("foreign_"), F.bool_or(F.col("l") != "zh").alias("needs_translation"))


@query("select r_name as collection, n_name as preset, row_number() over (partition by r_regionkey order by n_nationkey)::int as place from region join nation on n_regionkey = r_regionkey")
def collection_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets of each collection in their order."""
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("collection"))
    return table(spark, sf_dir, "nation").withColumn("place", place).join(names, "n_regionkey").select("collection", F.col("n_name").alias("preset"), "place")


@query(f"""with h as (select page_id, {_BARE} as h from pages), w as (select distinct h as d from h where page_id % 10 = 0)
select page_id, h as host from h where not exists (select 1 from w where d = h or h like '%.' || d or d like '%.' || h)""")
def unwatched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host is no watched one, nor above or below one: anti-joins on the names above each host."""
    host = F.regexp_replace(T.host(F.col("url")), r"^www\.", "")
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    watched = rows.where("page_id % 10 = 0").select(F.col("host").alias("d")).distinct()

    def above(name: str) -> Column:
        labels = F.split(name, r"\.", -1)
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))

    below = rows.select("page_id", above("host").alias("d")).join(watched, "d", "left_semi").select("page_id")
    over = watched.select(above("d").alias("host")).distinct()
    return rows.join(below.distinct(), "page_id", "left_anti").join(over, "host", "left_anti").select("page_id", "host")


@query(f"""with {THREADS}, a as (select max(l_shipdate) as now from lineitem), r as (select thread_id, resonant, thread_id % 7 as stored, case when publishers <= 1 then 0 else publishers / greatest(epoch(now - first_seen) / 3600.0, 0.5) end as score
  from thread, a where last_update >= now - interval '14 days' or resonant)
select thread_id, round(score, 6)::double as score, score >= 2 as flag from r where (score >= 2) <> resonant or abs(score - stored) > 0.01""")
def resonance_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads whose resonance, worked out anew, is to be written: the flag changes or the score moves."""
    now = F.broadcast(table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("now")))  # one row
    rows = threads(spark, sf_dir).crossJoin(now).where((F.col("last_update") >= F.col("now") - F.expr("interval 14 days")) | F.col("resonant"))
    hours = F.expr("timestampdiff(microsecond, first_seen, now)") / 3.6e9
    rows = rows.select("thread_id", "resonant", (F.col("thread_id") % 7).alias("stored"), resonance(F.col("publishers"), hours).alias("s"))
    flag = F.col("s") >= RESONANT
    return rows.where((flag != F.col("resonant")) | (F.abs(F.col("s") - F.col("stored")) > 0.01)).select("thread_id", F.round("s", 6).alias("score"), flag.alias("flag"))


@query(f"""with {_MEAN}, f as (select vec_id, list_transform(list_zip(embedding, mean), lambda z: z[1]::double - z[2]) as c from embeddings, mu), g as (select vec_id, list_transform(c, lambda x: x / (sqrt(list_inner_product(c, c)) + 1e-9)) as x from f)
select vec_id, round(x[1], 6) as first, round(x[len(x)], 6) as last, round(sqrt(list_inner_product(x, x)), 6) as norm from g""")
def probe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a probe sees of a vector: its distance from the mean, of length one but for a guard against zero."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    rows = rows.crossJoin(F.broadcast(V.mean_vector(rows, "v"))).select("vec_id", V.features(F.col("v"), F.col("mean")).alias("x"))
    return rows.select("vec_id", F.round(F.get("x", F.lit(0)), 6).alias("first"), F.round(F.element_at("x", -1), 6).alias("last"), F.round(V.norm(F.col("x")), 6).alias("norm"))


@query(f"with {ARTICLES} select id, regexp_replace(title, '[\\x00-\\x1F]', ' ', 'g') as title, url, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as published from article")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as a feed and read from it again: title, link and date by path."""
    clean = F.regexp_replace("title", r"[\x00-\x1F]", " ")
    escaped = F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    dated = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    xml = F.concat(F.lit("<rss><channel><item><title>"), escaped, F.lit("</title><link>"), "url", F.lit("</link><pubDate>"), dated, F.lit("</pubDate></item></channel></rss>"))
    rows = articles(spark, sf_dir).select("id", xml.alias("xml"))
    at = lambda name: F.xpath_string("xml", F.lit(f"/rss/channel/item/{name}"))
    return rows.select("id", at("title").alias("title"), at("link").alias("url"), at("pubDate").alias("published"))
