"""Means, centred similarity, gates and the hashing embedding.

Pairs of vectors are found block by block: each block of rows is one group, and a group compares itself with one other
block, so no join of all rows with all rows is planned and every block pair is a task of its own size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import vectors as V
from sigloom.operators.hashing import hash_embeddings
from sigloom.operators.similarity import best_matches, similar
from sigloom.plans.base import query, sent, table

_MEAN = """mu as (select list(m order by i) as mean from (select i, avg(v::double) as m from (select unnest(range(1, len(embedding) + 1)) as i, unnest(embedding) as v from embeddings) group by i))"""
_CENTRED = f"""{_MEAN}, cen as (select vec_id, label, list_transform(list_zip(embedding, mean), lambda z: z[1]::double - z[2]) as c from embeddings, mu),
u as (select vec_id, label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) as c from cen)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    mean = F.broadcast(V.mean_vector(rows, "v"))  # one row, as long as a vector
    return rows.crossJoin(mean).select("vec_id", "label", V.unit(V.centred(F.col("v"), F.col("mean"))).alias("c"))


@query(f"with {_MEAN} select (i - 1)::int as i, round(mean[i], 6) as mean from (select mean, unnest(range(1, len(mean) + 1)) as i from mu)")
def corpus_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mean_vector(_vectors(spark, sf_dir), "v").select(F.posexplode("mean").alias("i", "m")).select("i", F.round("m", 6).alias("mean"))


@query("select label, (i - 1)::int as i, round(avg(v::double), 6) as mean from (select label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding) as v from embeddings) group by 1, 2")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroid of each label."""
    return V.mean_vector(_vectors(spark, sf_dir), "v", "label").select("label", F.posexplode("mean").alias("i", "m")).select("label", "i", F.round("m", 6).alias("mean"))


@query(f"with {_CENTRED} select a.vec_id as a, b.vec_id as b, round(list_inner_product(a.c, b.c), 5) as similarity from u a join u b on a.vec_id < b.vec_id where list_inner_product(a.c, b.c) >= 0.35")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of centred cosine 0.35 and more."""
    return similar(_centred(spark, sf_dir), "vec_id", "c", 0.35).select("a", "b", F.round("similarity", 5).alias("similarity"))


_ASK = f"with {_CENTRED}, s as (select a.vec_id, b.vec_id as other, list_inner_product(a.c, b.c) as s from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)"


@query(f"{_ASK}, r as (select *, row_number() over (partition by vec_id order by s desc, other) as place from s where s >= 0.05) select vec_id, other, place::int as place, round(s, 5) as similarity from r where place <= 3")
def centred_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of each asked vector, from 0.05 up."""
    rows = _centred(spark, sf_dir)
    return best_matches(rows.where("vec_id % 20 = 0"), rows, "vec_id", "c", 3, 0.05).select("vec_id", "other", "place", F.round("similarity", 5).alias("similarity"))


@query(f"{_ASK}, r as (select *, row_number() over (partition by vec_id order by s desc, other) as place from s) select vec_id, case when s >= 0.18 then other end as thread, round(s, 5) as similarity from r where place = 1 and s > 0")
def nearest_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest thread of each asked vector, if it reaches 0.18."""
    rows = _centred(spark, sf_dir)
    best = best_matches(rows.where("vec_id % 20 = 0"), rows, "vec_id", "c", 1, 1e-12)
    return best.select("vec_id", F.when(F.col("similarity") >= 0.18, F.col("other")).alias("thread"), F.round("similarity", 5).alias("similarity"))


_PROFILE = f"""with {_CENTRED}, prof as (select label, c from (select *, row_number() over (partition by label order by vec_id) as place from u) where place <= 3),
s as (select u.vec_id, u.label, max(list_inner_product(u.c, p.c)) as relevance from u join prof p on p.label = u.label group by 1, 2)"""


@query(f"{_PROFILE} select vec_id, round(relevance, 5) as relevance, relevance < 0.05 as gated from s")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the three profile vectors of its label; below 0.05 it is gated."""
    rows = _centred(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    profile = rows.withColumn("place", place).where("place <= 3").groupBy("label").agg(F.collect_list("c").alias("profile"))  # three to a label
    best = F.array_max(F.transform("profile", lambda p: V.dot(F.col("c"), p)))
    scored = rows.join(sent(profile), "label").select("vec_id", best.alias("r"))
    return scored.select("vec_id", F.round("r", 5).alias("relevance"), (F.col("r") < 0.05).alias("gated"))


@query("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-zA-Z\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7a3}]+')) as w from documents), h as (select doc_id, md5(w) as h from t),
s as (select doc_id, ('0x' || substr(h, 31, 2))::int as bucket, sum(case when ('0x' || substr(h, 30, 1))::int % 2 = 1 then 1 else -1 end)::bigint as weight from h group by 1, 2),
n as (select doc_id, sqrt(sum(weight * weight)) as n from s group by 1)
select doc_id, bucket, weight, round(case when n > 0 then weight / n else 0 end, 6) as x from s join n using (doc_id)""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed sums of word hashes in 256 places, and the vector of length one that they make."""
    return hash_embeddings(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "bucket", "weight", F.round("x", 6).alias("x"))


_COSINE = "list_inner_product(a.embedding::double[], p.embedding::double[]) / nullif(sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(p.embedding::double[], p.embedding::double[])), 0)"


@query(f"""with prof as (select * from (select *, row_number() over (partition by label order by vec_id) as place from embeddings) where place <= 3)
select a.vec_id, round(greatest(0, coalesce(max({_COSINE}), 0)), 5) as best from embeddings a left join prof p on p.label = a.label and p.vec_id <> a.vec_id group by 1""")
def best_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest cosine of each vector against the other profile vectors of its label; never below 0."""
    rows = _vectors(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    profile = rows.withColumn("place", place).where("place <= 3").groupBy("label").agg(F.collect_list(F.struct("vec_id", "v")).alias("refs"))  # three to a label
    others = F.filter("refs", lambda r: r["vec_id"] != F.col("vec_id"))
    best = F.array_max(F.transform(others, lambda r: V.cosine(F.col("v"), r["v"])))
    return rows.join(sent(profile), "label", "left").select("vec_id", F.round(F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0))), 5).alias("best"))


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 5) as norm, len(embedding)::int as size from embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("v")), 5).alias("norm"), F.size("v").alias("size"))


@query("select event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) as p from events")
def sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(1 / (1 + F.exp(-(F.col("value") - 50) / 10)), 6).alias("p"))


@query("""with s as (select doc_id, quality as y, n_chars::double as score from labels join documents using (doc_id)), g as (select score, count(*) as n, count(*) filter (y = 1) as pos from s group by 1),
r as (select *, sum(n) over (order by score) - n + (n + 1) / 2.0 as mid from g)
select round((sum(mid * pos) - (select count(*) from s where y = 1) * ((select count(*) from s where y = 1) + 1) / 2.0) / ((select count(*) from s where y = 1) * (select count(*) from s where y = 0)), 6)::double as auc from r""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that a label 1 has the higher score, ties counting half: by ranks of the distinct scores.

    Scores are dealt out by range; a part's ranks start from the sums of the parts before it, so no task ranks all.
    """
    from sigloom.operators.ranking import rank_sum_auc

    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"))
    return rank_sum_auc(rows).select(F.round("auc", 6).alias("auc"))
