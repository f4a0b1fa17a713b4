"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The index holds (term, document, position) of every corpus token that is a benchmark word.  Each window of a benchmark
item is sought by its rarest term: the term's list, moved by the term's offset, is intersected with the moved list of
the next rarest.  What remains names a document, an item and the place where the item would begin; the document's words
are then compared there, and runs of at least a window give the hits.

Documents are compared with one item at a time, so what a task holds is a text, an item and its places, however many
items a text holds; only places of runs are then put together by document.  Where the documents with candidates are few
by count (BROADCAST_DOCS), their keys go to the documents; where they are many, both are dealt by key.  The results are
the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.folds import let, running_max
from sigloom.llm.store import keep

WINDOW = 10
#: What separates words, and the letters made small.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark terms that are sent to all tasks; more of them are joined by a shuffle.
BROADCAST_TERMS = 500_000
#: Windows of benchmark items, by their rarest terms, that are sent to all tasks; more of them are joined by a shuffle.
BROADCAST_MARKS = 500_000
#: Documents with candidates, or hits of documents, that are sent to all tasks; more of them are joined by a shuffle.
BROADCAST_DOCS = 200_000


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), SEPARATORS, -1), "")


def terms_of(items: DataFrame) -> DataFrame:
    """term and tid of every distinct word of ``items`` (words)."""
    return items.select(F.explode("words").alias("term")).distinct().withColumn("tid", F.xxhash64("term"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """tid, k, pos of every token of ``docs`` (k, text) that is one of ``terms``, kept in the shared folder."""
    tokens = docs.select("k", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return keep(tokens.join(F.broadcast(terms) if small else terms, "term").select("tid", "k", "pos"), "postings")


def anchors(items: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """item, o1, t1, o2, t2: offsets and terms of the two rarest words of each window that the corpus may hold."""
    frequency = postings.groupBy("tid").agg(F.count("*").alias("df"))
    places = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("o", "term"))
    places = places.withColumn("tid", F.xxhash64("term")).join(frequency, "tid", "left")
    width = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("o") - width + 1), F.least(F.col("o"), F.col("n") - width))
    windows = places.select("item", F.explode(starts).alias("s"), F.struct(F.coalesce("df", F.lit(0)).alias("df"), "o", "tid").alias("p"))
    rarest = windows.groupBy("item", "s").agg(F.slice(F.array_sort(F.collect_list("p")), 1, 2).alias("r"))
    one, two = F.col("r")[0], F.coalesce(F.try_element_at("r", F.lit(2)), F.col("r")[0])
    found = rarest.where(one["df"] > 0)
    return found.select("item", one["o"].alias("o1"), one["tid"].alias("t1"), two["o"].alias("o2"), two["tid"].alias("t2")).distinct()


def candidates(postings: DataFrame, marks: DataFrame) -> DataFrame:
    """k, item, at: places where an item may begin, from the intersection of the two moved lists."""
    # Few windows go to all postings; many are joined by a shuffle whose hot terms Spark splits.
    sent = F.broadcast(marks) if marks.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS else marks
    first = postings.select("k", "pos", F.col("tid").alias("t1")).join(sent, "t1")
    first = first.select("k", "item", (F.col("pos") - F.col("o1")).alias("at"), F.col("t2").alias("tid"), (F.col("pos") - F.col("o1") + F.col("o2")).alias("pos")).distinct()
    second = postings.join(marks.select(F.col("t2").alias("tid")).distinct(), "tid", "left_semi")
    return first.join(second, ["k", "pos", "tid"], "left_semi").select("k", "item", "at").distinct()


_RUNS = "array<struct<s:int,e:int>>"


def _runs(words: Column, item: Column, at: Column, window: int) -> Column:
    """Stretches of the document's words that agree with the item's, laid at a place, and hold a window at least."""
    size, n = F.size(words), F.size(item)
    width = F.least(F.lit(window), n)

    def step(state: Column, o: Column) -> Column:
        place = at + o
        same = (o < n) & (place >= 0) & (place < size) & F.coalesce(F.get(words, place) == F.get(item, o), F.lit(False))
        ends = ~same & (state["run"] >= width)
        out = F.when(ends, F.concat(state["out"], F.array(F.struct((place - state["run"]).alias("s"), place.alias("e"))))).otherwise(state["out"])
        return F.struct(F.when(same, state["run"] + 1).otherwise(0).alias("run"), out.alias("out"))

    start = F.struct(F.lit(0).alias("run"), F.expr(f"cast(array() as {_RUNS})").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), n), start, step, lambda state: state["out"])


def _merged(runs: Column) -> Column:
    """The same places by stretches that don't meet: a stretch begins where a run begins beyond all runs before it."""

    def joined(both: Column) -> Column:
        runs, reach = both["runs"], both["reach"]
        begins = F.filter(F.transform(runs, lambda r, k: F.when((k == 0) | (r["s"] > F.get(reach, k - 1)), r["s"])), lambda s: s.isNotNull())
        ends = F.filter(F.transform(reach, lambda e, k: F.when((k == F.size(runs) - 1) | (F.get(runs, k + 1)["s"] > e), e.cast("int"))), lambda e: e.isNotNull())
        return F.zip_with(begins, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    in_order = lambda runs: F.struct(runs.alias("runs"), running_max(F.transform(runs, lambda r: r["e"].cast("bigint"))).alias("reach"))
    found = let(let(F.array_sort(runs), in_order), joined)
    return F.when(F.size(runs) > 0, found).otherwise(F.expr(f"cast(array() as {_RUNS})"))


def _covered(runs: Column) -> Column:
    """The number of words inside any stretch."""

    def step(state: Column, run: Column) -> Column:
        more = F.greatest(F.lit(0), run["e"] - F.greatest(run["s"], state["end"]))
        return F.struct(F.greatest(state["end"], run["e"]).alias("end"), (state["total"] + more).alias("total"))

    return F.aggregate(F.array_sort(runs), F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), step, lambda s: s["total"])


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS


def keys_of_row() -> tuple[Column, Column]:
    """Two independent fingerprints of a row: the index is by the first, and what is found goes back to rows by both."""
    return F.xxhash64("row.doc_id", "row.text"), F.xxhash64(F.lit("again"), "row.text", "row.doc_id")


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every row of ``docs``: row, a struct of all its columns, words, item_ids (as strings, sorted) and runs (s, e)
    of hit words, which don't meet.

    Items are the rows of ``benchmark`` (item_id, text); those that share an id count once.  Items without words or
    with a null id are left out; null texts have no words; an empty benchmark gives no hits.
    """
    items = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = keep(items.withColumn("item", F.xxhash64("item_id", "words")).distinct(), "items")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one, two = keys_of_row()
    keyed = keyed.withColumn("k", one).withColumn("k2", two)
    postings = build_index(keyed.select("k", "row.text"), terms_of(items))
    marks = keep(anchors(items, postings, window), "anchors")
    # One row for a document and an item, with the places where the item may begin.
    found = keep(candidates(postings, marks).groupBy("k", "item").agg(F.collect_list("at").alias("places")), "candidates")
    asked = found.select("k").distinct()
    # Rows that share the first fingerprint by chance share candidates; each text is then compared by itself.
    texts = keyed.select("k", "k2", "row.text").join(F.broadcast(asked) if _few(asked) else asked, "k", "left_semi").distinct()
    # Words are found once for a text, below the join, and not again for each of its items.
    both = texts.select("k", "k2", words_of(F.col("text")).alias("words")).join(found, "k").join(items.withColumnRenamed("words", "sought"), "item")
    runs = F.flatten(F.transform("places", lambda at: _runs(F.col("words"), F.col("sought"), at, window)))
    hits = both.select("k", "k2", F.col("item_id").cast("string").alias("item_id"), _merged(runs).alias("runs")).where(F.size("runs") > 0)
    by_doc = hits.groupBy("k", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), _merged(F.flatten(F.collect_list("runs"))).alias("hit"))
    by_doc = keep(by_doc, "hits")
    own = keyed.join(F.broadcast(by_doc) if _few(by_doc) else by_doc, ["k", "k2"], "left")
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    return own.select("row", words_of(F.col("row.text")).alias("words"), F.coalesce("ids", none("array<string>")).alias("item_ids"), F.coalesce("hit", none(_RUNS)).alias("runs"))


def proximity(postings: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """pair, k, near: documents of ``postings`` where the terms t1 and t2 of ``pairs`` stand at most ``slop`` words
    apart, and the number of places of t1 that they do.  Places meet by stretches of ``slop`` words."""
    size = max(1, slop)
    one = postings.join(pairs.select("pair", F.col("t1").alias("tid")), "tid").select("pair", "k", F.col("pos").alias("p1"), F.expr(f"explode(sequence(pos div {size} - 1, pos div {size} + 1))").alias("cell"))
    two = postings.join(pairs.select("pair", F.col("t2").alias("tid")), "tid").select("pair", "k", F.col("pos").alias("p2"), F.expr(f"pos div {size}").alias("cell"))
    near = one.join(two.groupBy("pair", "k", "cell").agg(F.sort_array(F.collect_set("p2")).alias("places")), ["pair", "k", "cell"])
    near = near.where(F.exists("places", lambda p: (p != F.col("p1")) & (F.abs(p - F.col("p1")) <= slop)))
    return near.groupBy("pair", "k").agg(F.countDistinct("p1").alias("near"))


def phrases(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """phrase, k, at: exact places of each phrase (phrase, words) in the indexed documents, by lists alone."""
    terms = wanted.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("o", "term"))
    moved = terms.withColumn("tid", F.xxhash64("term")).join(postings, "tid").withColumn("at", F.col("pos") - F.col("o"))
    return moved.groupBy("phrase", "n", "k", "at").agg(F.count("*").alias("found")).where("found = n").select("phrase", "k", "at")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_passages(docs.select("doc_id", "text"), benchmark)
    n_hit = _covered(F.col("runs")).cast("bigint")
    return found.select(
        "row.doc_id", F.size("words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LETTERS = f"'{UPPER}', '{SMALL}'"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
starts as (select item_id, w, least({WINDOW}, len(w)) as n, unnest(range(0, len(w) - least({WINDOW}, len(w)) + 1)) as s from b where len(w) > 0),
item_windows as (select distinct item_id, n, array_to_string(w[s + 1 : s + n], ' ') as win from starts),
doc_starts as (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as s from d, (select distinct n from item_windows) where len(w) >= n),
hits as (select doc_id, s, i.n, item_id from doc_starts x join item_windows i on i.n = x.n and i.win = array_to_string(x.w[s + 1 : s + x.n], ' ')),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join named using (doc_id)
"""
