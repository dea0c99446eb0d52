"""The queries of this subpackage on the test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm import (
    jaccard, language, mixing, neighbours, periodic, phrases, pieces, secrets, sharding, simhash, substrings, topk, toxicity,
)
from docfields.llm.common import remainder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = toxicity.learn(docs, labels.where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, network).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(remainder("doc_id", 4) != 2))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample, and what it gives when it is decoded again."""
    return pieces.sample_pieces(table(spark, sf_dir, "documents"), decode=True)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodic.cycled))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scans": op2_secret_scans,
    "op3_repeats": op3_repeats,
    "op4_language_id": op4_language_id,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_sharding": op7_sharding,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_jaccard_join": op13_jaccard_join,
}

# Phrases of k words, as text: a piece's words from every place on.
_GRAMS = "\n union all ".join(
    "select lang, " + " || ' ' || ".join(f"w[i{f' + {j}' if j else ''}]" for j in range(k)) + f" as g, {k} as size, "
    + (" || ' ' || ".join(f"w[i{f' + {j}' if j else ''}]" for j in range(k - 1)) or "null") + " as head, "
    + (" || ' ' || ".join(f"w[i + {j}]" for j in range(1, k)) or "null") + f" as tail from placed where i + {k - 1} <= len(w)" for k in (1, 2, 3, 4))

ORACLE: dict[str, str] = {
    "op12_collocations": f"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\\x0A-\\x0D]')) as piece
            from documents
        ), split as materialized (
            select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from pieces
        ), placed as materialized (select lang, w, unnest(range(1, len(w) + 1)) as i from split),
        f as materialized (
            select lang, g, size, any_value(head) as head, any_value(tail) as tail, count(*) as a from ({_GRAMS})
            group by lang, g, size having count(*) >= 30
        ),
        n as (select lang, cast(sum(len(w)) as bigint) as n from split group by lang),
        c as (select *, string_split(g, ' ') as w from f where size > 1),
        held as materialized (
            select lang, g, max(a) as longer from (
                select lang, head as g, a from f where size > 2 union all select lang, tail, a from f where size > 2) group by lang, g
        ),
        cuts as (
            select c.lang, c.g, c.a, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:size], ' ') as y
            from (select *, unnest(range(1, size)) as k from c) c
        ),
        scored as (
            select t.lang, t.g, t.a, k, p.a as l, q.a as r, cast(2000000 * t.a::hugeint // (p.a + q.a) as bigint) as score
            from cuts t join f p on p.lang = t.lang and p.g = t.x join f q on q.lang = t.lang and q.g = t.y
        ), best as (
            select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1
        ), ranked as (
            select best.lang, row_number() over (partition by best.lang order by score desc, best.a desc, best.g) as rank,
                   best.g as phrase, best.a, l, r, score
            from best left join held h on h.lang = best.lang and h.g = best.g
            where coalesce(100 * h.longer < 80 * best.a, true)
        )
        select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000""",
    # The k-th best score cuts off; every query meets every row but its own.
    "op8_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as w
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
            from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
        ), r as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s
        )
        select query_id, rank, vec_id, score from r where rank <= 20""",
    # Counts: how many of the Poisson distribution's sums are at most the document's hashed number.
    "op10_mixing": """
        with n as (select source, count(*) as n from documents group by source),
        t as (select sum(n) as all_rows, sum(pow(n, 0.5)) as all_weights from n),
        r as (select source, all_rows * pow(n, 0.5) / all_weights / n as rate from n, t),
        p as (
            select source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (
                partition by source order by k) as below
            from (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 40) as bigint) + 1)) as k
                  from r)
        ),
        s as (select source, any_value(rate) as rate, list(below) as sums from p group by source),
        c as (
            select d.*, s.rate, len(list_filter(s.sums, lambda x: x <= cast(
                '0x' || substr(md5('20240:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint)
                / 4503599627370496.0)) as copies
            from documents d join s on d.source is not distinct from s.source
        ),
        e as (select * exclude (copies), cast(unnest(range(1, copies + 1)) as int) as copy_no from c)
        select * replace (round(rate, 6) as rate), cast('0x' || substr(md5('20241:' || coalesce(
            cast(doc_id as varchar), 'null') || ':' || cast(copy_no as varchar)), 1, 15) as bigint) as mix_key
        from e""",
    # Shared shingles of every two documents that have one in common, and all that links reach.
    "op13_jaccard_join": """
        with recursive split as materialized (
            select doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
            from documents
        ), s as materialized (
            select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
            from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from split where len(w) > 0)
        ), n as materialized (select doc_id, count(*) as n from s group by doc_id),
        shared as materialized (
            select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
        ), links as materialized (
            select u, v from shared join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)
        ), reached(u, v) as (
            select doc_id, doc_id from n union select r.u, l.v from reached r join links l on l.u = r.v
        ), least as (select u, min(v) as component_id from reached group by u)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id
        from documents d left join n on n.doc_id = d.doc_id left join least on u = d.doc_id""",
}
