"""Near-duplicate titles without comparing all pairs, and the families that they form in a thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.sources.folders import ready_checkpoints


def classes_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, signals, tokens and the first ``order`` of every class of titles that are the same item: equal normalised
    titles with the same versions and dates in the raw title.  Titles of fewer than LEAST_TOKENS words are in none."""
    titled = rows.select(*keys, order, T.normalize_title(F.col("title")).alias("norm"), F.array_join(T.signal_tokens(F.col("title")), " ").alias("signals"))
    first = titled.where("norm <> ''").groupBy(*keys, "norm", "signals").agg(F.min(order).alias(order))
    words = F.filter(F.split("norm", " "), lambda w: F.length(w) > 1)
    return first.withColumn("words", words).where(F.size("words") >= T.LEAST_TOKENS).select(*keys, "signals", order, F.array_distinct("words").alias("tokens"))


def near_classes(classes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, a, b (a before b) and similarity of classes whose token sets have a Jaccard of NEAR_TITLE or more and whose
    versions and dates agree.

    Classes meet by the prefix rule over tokens ordered by rarity: two sets that similar share one of the rarest
    n - ceil(0.8 n) + 1 tokens of each, so common words bring nobody together.
    """
    named = [*keys, order]
    tokens = classes.select(*named, "signals", F.explode("tokens").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(rarity, "token")
    ordered = F.array_sort(F.collect_list(F.struct("df", "token")))
    sets = ranked.groupBy(*named, "signals").agg(F.transform(ordered, lambda t: t["token"]).alias("tokens"))
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - F.ceil(T.NEAR_TITLE * F.size("tokens") - 1e-9).cast("int") + 1)
    met = sets.select(*named, "signals", "tokens", F.explode(prefix).alias("key"))
    side = lambda x: met.select(*keys, "signals", "key", F.col(order).alias(x), F.col("tokens").alias(f"t{x}"))
    pairs = side("a").join(side("b"), [*keys, "signals", "key"])
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.size("ta") >= T.NEAR_TITLE * F.size("tb")) & (F.size("tb") >= T.NEAR_TITLE * F.size("ta")))
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - common
    near = pairs.where((common >= T.NEAR_TITLE * union) & (common > 0))
    return near.select(*keys, "a", "b", F.round(common / union, 6).alias("similarity")).distinct()


def near_titles(articles: DataFrame) -> DataFrame:
    """a, b, similarity for classes of titles (by their first id) that are near-duplicates."""
    return near_classes(classes_of(articles, [], "id"), [], "id")


def title_families(rows: DataFrame) -> DataFrame:
    """rows (thread, no, title) -> thread, families: titles in their order, each a new family unless it is a
    near-duplicate of an earlier family's first.

    A class begins a family once all its earlier near-duplicates are known not to, and is none once one of them does:
    rounds of joins over the near pairs alone, as many as the longest chain of near-duplicates.  Titles that are too
    short to be told apart are families of their own.
    """
    ready_checkpoints(rows.sparkSession)
    classes = classes_of(rows, ["thread"], "no").select("thread", "signals", "no", "tokens").checkpoint()
    pairs = near_classes(classes, ["thread"], "no").select("thread", "a", "b").checkpoint()
    states = classes.select("thread", F.col("no").alias("b")).join(pairs.select("thread", "b").distinct().withColumn("met", F.lit(True)), ["thread", "b"], "left")
    states = states.select("thread", "b", F.when(F.col("met").isNull(), True).alias("begins")).checkpoint()
    while not states.where("begins is null").isEmpty():
        earlier = pairs.join(states.select("thread", F.col("b").alias("a"), "begins"), ["thread", "a"])
        known = earlier.groupBy("thread", "b").agg(F.bool_or("begins").alias("any"), F.bool_or(F.col("begins").isNull()).alias("waits"))
        decided = F.when(F.col("begins").isNotNull(), F.col("begins")).when(F.col("any"), False).when(~F.col("waits"), True)
        states = states.join(known, ["thread", "b"], "left").select("thread", "b", decided.alias("begins")).checkpoint()
    words = F.filter(F.split(T.normalize_title(F.col("title")), " "), lambda w: F.length(w) > 1)
    thin = rows.where(F.size(words) < T.LEAST_TOKENS).select("thread", F.lit(True).alias("begins"))
    return states.select("thread", "begins").union(thin).groupBy("thread").agg(F.count_if("begins").alias("families"))
