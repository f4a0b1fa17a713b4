"""Editorial screens of items that no trusted source stands for, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions import text as T

# Patterns and word lists that decide results.
SUBREDDIT = r"/r/([A-Za-z0-9_]+)"
PROMO_WORDS = (
    "discount", "discounts", "offer", "offers", "deal", "deals",
    "coupon", "coupons", "promo", "promos", "cheap", "giveaway", "giveaways",
    "freebie", "freebies", "sale", "sales", "marketplace", "selling",
    "forsale", "flipping", "resell", "reselling",
)
PROMO_SUBSTRINGS = (
    "discount", "coupon", "giveaway", "forsale", "cheap", "promo",
    "subscriptionsharing", "accountsharing", "sharingaccount",
    "subscriptionshare", "accountshare",
)
SELF_LAUNCH = (
    r"(?i)\b(?:i|we)\s+(?:just\s+|finally\s+)?(?:built|made|created|launched|shipped|released|open[- ]?sourced|wrote|developed)\b"
    r"|^\s*(?:just\s+)?(?:built|made|created|launched|shipped|released|open[- ]?sourced)\s+(?:my|our|a|an|this)\b"
    r"|\bshow\s+hn\b"
    r"|\b(?:my|our)\s+(?:new\s+|first\s+|latest\s+)?(?:app|tool|project|extension|plugin|saas|startup|side[- ]project|library|package|bot|script|website)\b"
)
VENDOR_EVENT = (
    r"(?i)\b(?:released?|releases|launch(?:e[sd])?|announce[sd]?|introduc(?:e[sd]|ing)|ships?|shipped|drops?|dropped|deprecat\w*|discontinu\w*|price[sd]?|pricing|"
    r"outage|incident|down|lawsuit|sues?|sued|acquir\w*|funding|benchmark\w*|vulnerab\w*|security|leak\w*|nerf\w*|rate.?limit\w*|supports?|available|adds?\s+support|now\s+on)\b"
)
VENDOR_TOKEN = r"(?i)\b(?:openai|anthropic|google|deepmind|xai|mistral|meta|microsoft|nvidia|claude|gpt|chatgpt|codex|gemini|grok|sonnet|opus|haiku|llama|sora|dall-?e)\b"
DISAMBIGUATORS = (
    "google", "deepmind", "alphabet", "bard", "vertex", "aistudio", "ai studio",
    "xai", "x.ai", "musk", "openai", "anthropic", "claude", "chatgpt", "gpt",
    "llm", "model", "api", "token", "benchmark", "prompt", "ai ", " ai", "a.i.",
    "flash", "pro", "ultra", "sonnet", "opus", "colossus", "grokipedia",
    "multimodal", "inference", "context window", "fine-tun", "open source",
    "release", "launch", "update", "version", "agent", "chatbot", "assistant",
)
HOUSEKEEPING = r"(?i)welcome to r/|introduce yourself|read this first|start here\b|^\s*\[?(?:meta|mod\s*post|announcement)\]?\s*[:\]]"
RECURRING = r"(?i)\bdaily (?:rng|prompt|thread|discussion|astrology|horoscope|chat)\b|\b(?:daily|weekly|monthly)\s+\w+\s+thread\b|\bhoroscope\b|\bastrology\b"
JOBS = r"(?i)\bjobs?\s+hiring\b|\bhiring\s+(?:now|asap)\b|\bwork\s+from\s+home\b|\bremote\s+jobs?\b|\bnow\s+hiring\b|\breferral\s+(?:link|code)\b|\binvite\s+code\b|\buse\s+my\s+link\b|\bgrab\s+\d+\s*[⚡🎁]"


def subreddit(url: Column) -> Column:
    """The subreddit of a URL; empty if it has none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?i)" + SUBREDDIT, 1)


def promotional(title: Column, url: Column) -> Column:
    """Market tags, have-and-want posts, and subreddits whose name, cut at capitals, digits and _, says trade."""
    sub = subreddit(url)
    parts = F.split(F.lower(F.regexp_replace(sub, "([a-z])([A-Z])", "$1_$2")), r"[_\d]+", -1)
    trade = F.arrays_overlap(parts, F.array(*map(F.lit, PROMO_WORDS)))
    return T.promotional(F.coalesce(title, F.lit(""))) | trade | T.any_of(F.lower(sub), PROMO_SUBSTRINGS)


def self_launch(title: Column) -> Column:
    """First-person launches, but for those that report an event of a vendor that they name."""
    news = title.rlike(VENDOR_EVENT) & title.rlike(VENDOR_TOKEN)
    return title.rlike(SELF_LAUNCH) & ~news


def low_value_profile(title: Column, content: Column, url: Column) -> Column:
    """Posts on a personal page that launch something or say nothing."""
    return F.lower(subreddit(url)).startswith("u_") & (self_launch(title) | T.contentless(title, content))


def ambiguous(title: Column, content: Column) -> Column:
    """A term of several meanings with nothing beside it that tells which."""
    both = F.lower(F.concat(title, F.lit(" "), content))
    return T.any_of(both, T.AMBIGUOUS) & ~T.any_of(both, DISAMBIGUATORS)


def housekeeping(title: Column) -> Column:
    """Posts about a forum, posts that recur by schedule, job and referral posts."""
    return title.rlike(HOUSEKEEPING) | title.rlike(RECURRING) | title.rlike(JOBS)


def too_old(age_days: Column, max_days: Column) -> Column:
    """Whole days above the limit; 0 sets no limit, and an unknown age passes."""
    return F.coalesce((max_days > 0) & (age_days > max_days), F.lit(False))


def screened(tier: Column, url: Column) -> Column:
    """Whether the screens apply: not to primary and curated sources, but for what anyone may publish on a code host."""
    return ~F.coalesce(tier.isin("primary", "curated"), F.lit(False)) | T.untrusted_code_host(url)
