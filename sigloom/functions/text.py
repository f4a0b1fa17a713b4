"""Titles, URLs, provenance, screens and redaction as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that decide results.
PUBLISHER_SUFFIX = r"\s+[-|–—]\s+[^-|–—]{2,40}$"
VERSION = r"v?\d+(?:\.\d+)+"
DATEISH = r"\b(?:20\d\d|q[1-4]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)\b|\d{1,2}月|\d{4}年"
NEAR_TITLE, LEAST_TOKENS = 0.8, 3
FIRST_PARTY_SUFFIXES = (".gov", ".gov.cn", ".gov.uk", ".mil", ".edu")
FIRST_PARTY_DOMAINS = (
    "github.com", "github.io", "openai.com", "anthropic.com", "blog.google", "ai.googleblog.com", "developer.apple.com", "apple.com", "microsoft.com", "nvidia.com", "sec.gov", "fda.gov", "who.int",
    "clinicaltrials.gov", "europa.eu", "deepmind.google", "mistral.ai", "x.ai", "claude.com", "ai.meta.com", "engineering.fb.com", "research.facebook.com", "huggingface.co", "github.blog",
)
MARKETING = ("/customer-stories", "/customers/", "/case-stud", "/testimonial", "/global-affairs", "/policy/", "/opinion", "/editorial", "/careers", "/jobs", "/events/", "/webinar", "/pricing")
CODE_HOSTS = ("github.com", "github.io", "gitlab.com", "huggingface.co")
OFFICIAL_PATHS = ("/releases", "/tags", "/changelog", "/blog", "/security/advisories")
FIREHOSES = ("export.arxiv.org/", "rss.arxiv.org/", "arxiv.org/a/", "arxiv.org/list/", "hnrss.org/frontpage", "hnrss.org/newest", "hnrss.org/best", "github.com/trending", "news.ycombinator.com/rss")
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
COORDINATES = r"[-+]?\d{1,3}\.\d{3,},\s*[-+]?\d{1,3}\.\d{3,}"
NATIONAL_ID = r"\b\d{17}[\dXx]\b"
PHONE = r"(?<!\d)(?:\+?\d{1,3}[\s-]?)?(?:1[3-9]\d{9}|\d{3}[\s-]\d{3,4}[\s-]\d{4})(?!\d)"
ERROR_HINTS = (
    ("CAPABILITY_UNAVAILABLE", ("browsers are not installed", "executable doesn't exist", "playwright install", "browsertype.launch")),
    ("RATE_LIMITED", ("429", "rate limit", "too many requests", "quota")),
    ("CAPTCHA_REQUIRED", ("captcha", "challenge", "cloudflare", "verify you are human")),
    ("NETWORK_ERROR", ("timeout", "timed out", "connection", "dns", "ssl", "eof", "reset", "refused", "unreachable", "getaddrinfo", "net::", "proxy")),
    ("SOURCE_UNAVAILABLE", ("403", "404", "410", "500", "502", "503", "504", "gone", "forbidden", "not found")),
    ("RSS_PARSE_FAILED", ("bozo", "not well-formed", "syntax error", "xml", "malformed", "no parseable feed", "parse")),
)
MARKET_TAG = r"(?i)^\s*[\[(]\s*(offer|wts|wtb|wtt|selling|sell|for\s*sale|giveaway|promo|discount|deal)\s*[\])]"
HAVE_WANT = r"(?i)\[\s*h\s*\][^\[]*\[\s*w\s*\]|\[\s*w\s*\][^\[]*\[\s*h\s*\]"
VERSION_ONLY = r"(?i)^\s*(?:release\s+)?v?\d+(?:\.\d+){1,3}(?:[-.][\w.]+)?\s*$"
LEAST_BODY = 80
AMBIGUOUS = ("gemini", "grok")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def normalize_title(title: Column) -> Column:
    """Small letters, without the publisher at the end and without marks."""
    low = F.regexp_replace(F.trim(F.lower(F.coalesce(title, F.lit("")))), PUBLISHER_SUFFIX, "")
    return F.trim(F.regexp_replace(low, r"(?U)[^\w一-鿿]+", " "))


def title_tokens(title: Column) -> Column:
    """Words of more than a letter, repeats kept."""
    return F.filter(F.split(normalize_title(title), " "), lambda w: F.length(w) > 1)


def signal_tokens(title: Column) -> Column:
    """Versions and dates of the raw title, each once."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(VERSION), F.lit(0)), F.regexp_extract_all(low, F.lit(DATEISH), F.lit(0)))))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when(common == 0, 0.0).otherwise(common / F.size(F.array_union(a, b)))


def host(url: Column) -> Column:
    """The host and port of a URL in small letters; the text itself if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1))


def under(domain: Column, names: tuple[str, ...]) -> Column:
    """Whether a host is one of these domains or below one."""
    found = F.lit(False)
    for name in names:
        found = found | (domain == name) | domain.endswith("." + name)
    return found


def first_party(url: Column) -> Column:
    at = host(url)
    suffix = F.lit(False)
    for end in FIRST_PARTY_SUFFIXES:
        suffix = suffix | at.endswith(end)
    return suffix | under(at, FIRST_PARTY_DOMAINS)


def untrusted_code_host(url: Column) -> Column:
    return under(host(url), CODE_HOSTS) & ~any_of(path(url), OFFICIAL_PATHS)


def tier_of(url: Column, base: Column) -> Column:
    """An aggregated item stays so; a first party's announcement is primary; else curated."""
    primary = first_party(url) & ~any_of(path(url), MARKETING) & ~untrusted_code_host(url)
    return F.when(base == "aggregated", "aggregated").when(primary, "primary").otherwise("curated")


def firehose(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "https?://", ""), r"^([^w]*?)www\.", "$1")
    found = F.lit(False)
    for name in FIREHOSES:
        found = found | bare.startswith(name) | bare.contains("/" + name)
    return found


def publisher(url: Column, title: Column) -> Column:
    """Who published an item: a search's hit by the end of its title, a forum as one, else the host."""
    at = host(url)
    named = F.lower(F.trim(F.regexp_extract(F.coalesce(title, F.lit("")), r"\s[\-–—]\s([^\-–—]{2,60})$", 1)))
    return (
        F.when(at.contains("news.google.com"), F.when(named != "", named).otherwise("news.google.com"))
        .when(at.contains("reddit.com"), "reddit.com")
        .when(at.contains("ycombinator") | at.contains("hnrss"), "news.ycombinator.com")
        .when(at == "", "unknown")
        .otherwise(at)
    )


def language(text: Column) -> Column:
    """The language that a text's script tells: kana, hangul, Cyrillic, Han, else English."""
    return F.when(text.rlike("[\\u3040-\\u30ff]"), "ja").when(text.rlike("[\\uac00-\\ud7af]"), "ko").when(text.rlike("[\\u0400-\\u04ff]"), "ru").when(text.rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en")


def clean_pii(text: Column) -> Column:
    """Addresses, coordinates, ids and phone numbers out, in this order."""
    out = F.coalesce(text, F.lit(""))
    for pattern, mark in ((EMAIL, "[email]"), (COORDINATES, "[location]"), (NATIONAL_ID, "[id]"), (PHONE, "[phone]")):
        out = F.regexp_replace(out, pattern, mark)
    return out


def desensitize_url(url: Column) -> Column:
    """Scheme, host and path, whose middle goes if it is long."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    short = F.when(F.length(p) > 30, F.concat(F.substring(p, 1, 15), F.lit("..."), F.right(p, F.lit(15)))).otherwise(p)
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), short))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit("UNKNOWN_ERROR")
    for name, hints in reversed(ERROR_HINTS):
        out = F.when(any_of(low, hints), name).otherwise(out)
    return out


def promotional(title: Column) -> Column:
    return title.rlike(MARKET_TAG) | title.rlike(HAVE_WANT)


def contentless(title: Column, content: Column) -> Column:
    return (F.length(F.trim(content)) < LEAST_BODY) & ((F.trim(title) == "") | title.rlike(VERSION_ONLY))
