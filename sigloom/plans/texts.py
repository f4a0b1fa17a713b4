"""Titles, sources, screens, redaction and small scalar rules over articles and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.plans.base import query, table
from sigloom.sources.bind import ARTICLES, articles

_NORM = "trim(regexp_replace(regexp_replace(trim(lower({t})), '\\s+[-|–—]\\s+[^-|–—]{{2,40}}$', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}_一-鿿]+', ' ', 'g'))"


@query(f"with {ARTICLES} select id, {_NORM.format(t='title')} as norm from article")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("id", T.normalize_title(F.col("title")).alias("norm"))


@query(f"with {ARTICLES} select id, list_filter(string_split({_NORM.format(t='title')}, ' '), lambda w: len(w) > 1) as tokens from article")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("id", T.title_tokens(F.col("title")).alias("tokens"))


_SIGNALS = f"array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(title), '{T.VERSION}'), regexp_extract_all(lower(title), '{T.DATEISH}')))), ' ')"


@query(f"""with {ARTICLES}, n as (select id, {_NORM.format(t='title')} as norm, {_SIGNALS} as signals from article),
d as (select min(id) as id, norm, signals from n where norm <> '' group by norm, signals),
t as (select id, signals, list_distinct(list_filter(string_split(norm, ' '), lambda w: len(w) > 1)) as tokens from d where len(list_filter(string_split(norm, ' '), lambda w: len(w) > 1)) >= 3)
select a.id as a, b.id as b, round(len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))), 6)::double as similarity
from t a join t b on a.id < b.id and a.signals = b.signals where len(list_intersect(a.tokens, b.tokens)) >= 0.8 * (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) and len(list_intersect(a.tokens, b.tokens)) > 0""")
def near_dup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different titles of 0.8 and more, equal titles being one class.  Titles meet in the shared token that
    is rarest by the prefix rule: of n tokens, the n - ceil(0.8 n) + 1 rarest suffice to meet any partner."""
    from sigloom.operators.titles import near_titles

    return near_titles(articles(spark, sf_dir))


@query(f"with {ARTICLES} select id, case when publisher = '' then 'unknown' else lower(publisher || '.example') end as publisher from article")
def publisher_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("id", T.publisher(F.col("url"), F.col("title")).alias("publisher"))


_HOST = "lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
_PATH = "lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1))"


def _any(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"


def _under(column: str, names: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"{column} = '{n}' or {column} like '%.{n}'" for n in names) + ")"


_TIERS = f"""with p as (select page_id, url, {_HOST.format(u='url')} as h, {_PATH.format(u='url')} as p, case when page_id % 3 = 0 then 'aggregated' else 'curated' end as base from pages)
select page_id, case when base = 'aggregated' then 'aggregated' when ({" or ".join(f"h like '%{s}'" for s in T.FIRST_PARTY_SUFFIXES)} or {_under('h', T.FIRST_PARTY_DOMAINS)})
  and not {_any('p', T.MARKETING)} and not ({_under('h', T.CODE_HOSTS)} and not {_any('p', T.OFFICIAL_PATHS)}) then 'primary' else 'curated' end as tier from p"""


@query(_TIERS)
def source_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("page_id") % 3 == 0, "aggregated").otherwise("curated")
    return table(spark, sf_dir, "pages").select("page_id", T.tier_of(F.col("url"), base).alias("tier"))


@query(f"select page_id, {_HOST.format(u='url')} as host, {_PATH.format(u='url')} as path from pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"), T.path(F.col("url")).alias("path"))


@query(f"select page_id, {_HOST.format(u='url')} || {_PATH.format(u='url')} as key, md5(url) as fingerprint, sha256(html) as page_hash, 'thr_' || substr(sha256('local:' || page_id), 1, 8) as public_id from pages")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route key, URL fingerprint, page hash and public id."""
    key = F.concat(T.host(F.col("url")), T.path(F.col("url")))
    public = F.concat(F.lit("thr_"), F.substring(F.sha2(F.concat(F.lit("local:"), F.col("page_id").cast("string")), 256), 1, 8))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("key"), F.md5("url").alias("fingerprint"), F.sha2("html", 256).alias("page_hash"), public.alias("public_id"))


@query(f"""with {ARTICLES} select id, regexp_matches(title, '{T.MARKET_TAG.replace("(?i)", "(?i)")}') or regexp_matches(title, '{T.HAVE_WANT}') as promotional,
length(trim(content)) < 80 and (trim(title) = '' or regexp_matches(title, '{T.VERSION_ONLY}')) as contentless,
contains(lower(title || ' ' || content), 'gemini') or contains(lower(title || ' ' || content), 'grok') as ambiguous,
tier = 'aggregated' and not contains(lower(title || ' ' || content), 'the') as no_keyword,
contains(lower(title || ' ' || content), 'idiot') as ignored from article""")
def screen_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which screens an article fails."""
    both = F.lower(F.concat_ws(" ", "title", "content"))
    return articles(spark, sf_dir).select(
        "id", T.promotional(F.col("title")).alias("promotional"), T.contentless(F.col("title"), F.col("content")).alias("contentless"), T.any_of(both, T.AMBIGUOUS).alias("ambiguous"),
        ((F.col("tier") == "aggregated") & ~both.contains("the")).alias("no_keyword"), both.contains("idiot").alias("ignored"),
    )


@query("""select doc_id, case when regexp_matches(text, '[\\x{3040}-\\x{30ff}]') then 'ja' when regexp_matches(text, '[\\x{ac00}-\\x{d7af}]') then 'ko' when regexp_matches(text, '[\\x{0400}-\\x{04ff}]') then 'ru'
when regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') then 'zh' else 'en' end as script_language from documents""")
def language_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("script_language"))


@query(f"""with e as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b', '[email]', 'g'),
'{T.COORDINATES}', '[location]', 'g'), '{T.NATIONAL_ID}', '[id]', 'g') as t from documents)
select doc_id, len(t) as n_chars, len(t) - len(replace(t, '[email]', '')) as email_chars, len(t) - len(replace(t, '[id]', '')) as id_chars from e""")
def pii_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the redaction of addresses, coordinates and ids changes a text."""
    t = F.coalesce("text", F.lit(""))
    for pattern, mark in ((T.EMAIL, "[email]"), (T.COORDINATES, "[location]"), (T.NATIONAL_ID, "[id]")):
        t = F.regexp_replace(t, pattern, mark)
    left = lambda mark: (F.length("t") - F.length(F.replace(F.col("t"), F.lit(mark), F.lit("")))).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n_chars"), left("[email]").alias("email_chars"), left("[id]").alias("id_chars"))


@query()
def pii_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text redacted, phone numbers too (the pattern looks behind, which DuckDB's expressions can't)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_pii(F.col("text")), 256).alias("clean_sha256"), (T.clean_pii(F.col("text")) != F.col("text")).alias("changed"))


@query("""with p as (select page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as head, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as p from pages)
select page_id, case when coalesce(url, '') = '' then '' else head || case when length(p) > 30 then substr(p, 1, 15) || '...' || right(p, 15) else p end end as shown from p""")
def desensitize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.desensitize_url(F.col("url")).alias("shown"))


_ERRORS = "case " + " ".join(f"when {_any('m', hints)} then '{name}'" for name, hints in T.ERROR_HINTS) + " else 'UNKNOWN_ERROR' end"


@query(f"with e as (select event_id, lower('HTTP ' || (400 + event_id % 110) || ' ' || event_type || case event_id % 4 when 0 then ' timed out' when 1 then ' malformed xml' when 2 then ' captcha' else '' end) as m from events) select event_id, {_ERRORS} as error_class from e")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("event_id") % 4 == 0, " timed out").when(F.col("event_id") % 4 == 1, " malformed xml").when(F.col("event_id") % 4 == 2, " captcha").otherwise("")
    message = F.concat(F.lit("HTTP "), (400 + F.col("event_id") % 110).cast("string"), F.lit(" "), "event_type", tail)
    return table(spark, sf_dir, "events").select("event_id", T.error_class(message).alias("error_class"))


@query(f"with {ARTICLES} select id, title || chr(10) || substr(content, 1, 2000) as embed_text, greatest(1, length(content) // 4)::bigint as tokens from article")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of an article, and an estimate of its tokens."""
    return articles(spark, sf_dir).select("id", F.concat("title", F.lit("\n"), F.substring("content", 1, 2000)).alias("embed_text"), F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("bigint").alias("tokens"))


@query("select page_id, regexp_matches(lower(substr(html, 1, 500)), '<rss|<feed') as feed, regexp_matches(html, '(?i)<link[^>]+rel=.alternate') as has_alternate from pages")
def feed_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page is a feed or names one."""
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.substring("html", 1, 500)).rlike("<rss|<feed").alias("feed"), F.col("html").rlike("(?i)<link[^>]+rel=.alternate").alias("has_alternate"))


@query("select page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) as title from pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))


@query(f"with {ARTICLES} select id, replace(replace(replace('<item><title>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title></item>', chr(10), ' '), chr(13), ' '), chr(9), ' ') as item from article")
def xml_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a generated feed, escaped."""
    safe = F.col("title")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(mark), F.lit(name))
    return articles(spark, sf_dir).select("id", F.translate(F.concat(F.lit("<item><title>"), safe, F.lit("</title></item>")), "\n\r\t", "   ").alias("item"))


@query("select doc_id, list_sort(list_distinct(regexp_extract_all(text, '@[A-Za-z0-9_]{3,15}'))) as handles, list_sort(list_distinct(regexp_extract_all(lower(text), 'v?\\d+(?:\\.\\d+)+'))) as versions from documents")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles and versions that a text mentions."""
    found = lambda c, p: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0))))
    return table(spark, sf_dir, "documents").select("doc_id", found(F.col("text"), "@[A-Za-z0-9_]{3,15}").alias("handles"), found(F.lower("text"), T.VERSION).alias("versions"))


@query("select doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]{12,}'))) as tokens from documents")
def long_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct long words of a text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]{12,}"), F.lit(0)))).alias("tokens"))


@query("select event_id, 300 + mod(cast(event_id as bigint), 7) as lo, least(300 * power(2, event_id % 6), 3600)::bigint as cooldown, greatest(1, length(props) // 4)::bigint as tokens from events")
def cooldown_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cooldown doubles from 300 to 3600 seconds."""
    return table(spark, sf_dir, "events").select("event_id", (300 + F.col("event_id") % 7).alias("lo"), F.least(300 * F.pow(F.lit(2), F.col("event_id") % 6), F.lit(3600)).cast("bigint").alias("cooldown"), F.greatest(F.lit(1), F.floor(F.length("props") / 4)).cast("bigint").alias("tokens"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, date_trunc('day', ts)::timestamp as day_start, case when hour(ts) >= 23 or hour(ts) < 7 then true else false end as quiet, event_type in ('purchase', 'signup') as paid from events")
def clock_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text, the day's start, quiet hours past midnight and the category of an action."""
    quiet = (F.hour("ts") >= 23) | (F.hour("ts") < 7)
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day_start"), quiet.alias("quiet"), F.col("event_type").isin("purchase", "signup").alias("paid"))
