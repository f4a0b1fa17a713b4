"""Targets named by phrases and in scripts without blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.aliases import BODY, HAN, LEAD, LEAST, WITHOUT_BLANKS, alias_hits
from sigloom.plans.base import query, table
from sigloom.sources import cases
from sigloom.sources.bind import ARTICLES, articles

NAMES = [(-1, "Claude Opus"), (-1, "GPT-5"), (-1, "ai"), (-2, "模型"), (-2, "病"), (-2, "かな"), (-3, "C++"), (-3, " Opus "), (-4, "x"), (-4, None)]
NAMED = [
    (-1, "claude opus 5 is out", ""), (-2, "Claude  Opus", "the claude opus and GPT-5."), (-3, "xclaude opus", "claude opus1 gpt-5 " + "a" * 700 + " Opus"), (-4, "新模型发布", "病"), (-5, None, None), (-6, "C++ and c++x", "C++, opus"), (-7, "AI", "x" * 595 + " gpt-5 claude opus"),
    (-8, "t", "y" * 19_996 + " gpt-5 Claude Opus"), (-9, "ひらがな かな", "カナ"), (-10, "OPUS", "模型 模型かな"),
]
_ALIASES = """al as (select target_id, lower(trim(alias)) as alias from names union select item_id, lower(w[1] || ' ' || w[2]) from (select item_id, regexp_extract_all(text, '[A-Za-zÀ-ÿ]+') as w from benchmark) where len(w) >= 2
  union select item_id, lower(w[5] || ' ' || w[6] || ' ' || w[7]) from (select item_id, regexp_extract_all(text, '[A-Za-zÀ-ÿ]+') as w from benchmark) where len(w) >= 7),
ok as (select * from al where alias is not null and (length(alias) >= {least} or regexp_matches(alias, '{han}')))"""
_IN = "(contains({t}, alias) and (regexp_matches(alias, '" + WITHOUT_BLANKS + "') or regexp_matches({t}, '(^|[^0-9a-z])\\Q' || alias || '\\E($|[^0-9a-z])')))"


@query(f"""with {ARTICLES}, {cases.values("names", NAMES, "target_id bigint, alias string")}, {cases.values("named", NAMED, "id bigint, title string, content string")}, {_ALIASES.format(least=LEAST, han=HAN)},
a as (select id, lower(coalesce(title, '')) as t, lower(substr(coalesce(content, ''), 1, {BODY})) as b, lower(substr(coalesce(content, ''), 1, {LEAD})) as l from (select id, title, content from article union all select * from named)),
h as (select id, target_id, alias, {_IN.format(t='t')} as t, {_IN.format(t='b')} as b, {_IN.format(t='l')} as l from a join ok on contains(t, alias) or contains(b, alias))
select id, target_id, bool_or(t) as in_title, count(*) filter (b) as n_body, bool_or(l) as in_lead, bool_or(t) or (count(*) filter (b) >= 2 and bool_or(l)) as matched from h where t or b or l group by 1, 2""")
def alias_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which articles name which targets, by phrases of the benchmark's items and by the cases: in the title, or twice in
    the body and once in its lead."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    phrase = lambda first, last: items.where(F.size("w") >= last).select("item_id", F.array_join(F.slice("w", first, last - first + 1), " "))
    names = cases.literal(spark, NAMES, "target_id bigint, alias string").union(phrase(1, 2)).union(phrase(5, 7))
    rows = articles(spark, sf_dir).select("id", "title", "content").union(cases.literal(spark, NAMED, "id bigint, title string, content string"))
    found = alias_hits(rows, names)
    return found.withColumn("matched", F.col("in_title") | ((F.col("n_body") >= 2) & F.col("in_lead")))
