"""Queries of answer measures, ranking measures, aggregation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions import metrics as m
from ragframe.operators import evaluation as ev
from ragframe.operators import retrieval as r
from ragframe.plans.registry import query, sql_norm, sql_tokens, table
from ragframe.plans.retrieval_queries import _DVEC, _HYBRID, _LISTS, _TURNS, _WORDS, dense_hits, dvec, turns, word_hits
from ragframe.session import settled


def answered(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).filter("answer is not null")


@query("exact_token_prf", f"""with {_TURNS}, t as (select * from turns where answer is not null), a as (select conv_id, turn, unnest({sql_tokens("question")}) as w from t), b as (select conv_id, turn, unnest({sql_tokens("answer")}) as w from t),
ac as (select conv_id, turn, w, count(*) as c from a group by all), bc as (select conv_id, turn, w, count(*) as c from b group by all),
s as (select conv_id, turn, sum(least(ac.c, bc.c)) as ov from ac join bc using (conv_id, turn, w) group by all), na as (select conv_id, turn, sum(c) as n from ac group by all), nb as (select conv_id, turn, sum(c) as n from bc group by all),
x as (select t.conv_id, t.turn, ({sql_norm("question")} = {sql_norm("answer")})::double as em, coalesce(ov, 0) as ov, coalesce(na.n, 0) as na, coalesce(nb.n, 0) as nb from t left join s using (conv_id, turn) left join na using (conv_id, turn) left join nb using (conv_id, turn)),
y as (select *, case when na = 0 and nb = 0 then 1.0 when nb = 0 then 0.0 else ov / nb::double end as p, case when na = 0 and nb = 0 then 1.0 when na = 0 then 0.0 else ov / na::double end as r from x)
select conv_id, turn, em as exact_match, round(p, 4) as token_precision, round(r, 4) as token_recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as token_f1 from y""")
def exact_token_prf(spark: SparkSession, sf: str) -> DataFrame:
    t = answered(spark, sf).withColumn("k", F.struct("conv_id", "turn"))
    s = ev.token_prf(t, "k", "question", "answer")
    return t.select("k", m.exact_match(F.col("question"), F.col("answer")).alias("exact_match")).join(s, "k").select("k.conv_id", "k.turn", "exact_match", "token_precision", "token_recall", "token_f1")


@query("char_similarity")
def char_similarity(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.operators.similarity import char_ratio

    return char_ratio(answered(spark, sf), "question", "answer").select("conv_id", "turn", F.round("ratio", 4).alias("char_similarity"))


@query("keyword_coverage", f"""with {_TURNS} select conv_id, turn, case when len(k) = 0 then 1.0 else round(len(list_filter(k, lambda x: contains(n, x))) / len(k)::double, 4) end as coverage
from (select conv_id, turn, list_filter({sql_tokens("question")}, lambda x: length(x) > 4) as k, {sql_norm("answer")} as n from turns where answer is not null)""")
def keyword_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.functions.text import norm_match, tokens

    keys = F.filter(tokens(F.col("question")), lambda x: F.length(x) > 4)
    return answered(spark, sf).withColumn("k", keys).withColumn("n", norm_match(F.col("answer"))).select("conv_id", "turn", F.round(m.coverage(F.col("k"), F.col("n")), 4).alias("coverage"))


_REF = " or ".join(f"contains({sql_norm('answer')}, '{p}')" for p in m.REFUSALS)


@query("refusal_flags", f"with {_TURNS} select conv_id, turn, ({_REF}) as refused from (select conv_id, turn, case when turn % 3 = 0 then answer || ' Chưa tìm thấy, chắc chắn: không có thông tin.' else answer end as answer from turns where answer is not null)")
def refusal_flags(spark: SparkSession, sf: str) -> DataFrame:
    a = F.when(F.col("turn") % 3 == 0, F.concat("answer", F.lit(" Chưa tìm thấy, chắc chắn: không có thông tin."))).otherwise(F.col("answer"))
    return answered(spark, sf).select("conv_id", "turn", m.is_refusal(a).alias("refused"))


_CLAIMS = rf"list_filter(list_transform(string_split_regex(answer, '[.!?\n;]+'), lambda x: trim(x, ' -' || chr(9))), lambda x: len({sql_tokens('x')}) >= 3)"


@query("claim_split", f"with {_TURNS} select conv_id, turn, len(c)::bigint as n_claims, array_to_string(c, '|') as claims from (select conv_id, turn, {_CLAIMS} as c from turns where answer is not null)")
def claim_split(spark: SparkSession, sf: str) -> DataFrame:
    c = m.claims(F.col("answer"))
    return answered(spark, sf).select("conv_id", "turn", F.size(c).cast("long").alias("n_claims"), F.array_join(c, "|").alias("claims"))


@query("faithfulness", f"""with {_TURNS}, c as (select conv_id, turn, answer, {_CLAIMS} as c, list_distinct({sql_tokens("question")}) as q from turns where answer is not null),
s as (select conv_id, turn, len(c) as n, trim(answer) = '' as blank, len(list_filter(c, lambda x: len(list_intersect(list_distinct({sql_tokens("x")}), q)) / len(list_distinct({sql_tokens("x")}))::double >= 0.55)) as ok from c)
select conv_id, turn, f as faithfulness, round(1 - f, 4) as hallucination_rate from (select conv_id, turn, case when n = 0 then case when blank then 1.0 else 0.0 end else round(ok / n::double, 4) end as f from s)""")
def faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    from ragframe.operators.similarity import supported_share

    return supported_share(answered(spark, sf), "answer", "question").select("conv_id", "turn", "faithfulness", F.round(1 - F.col("faithfulness"), 4).alias("hallucination_rate"))


_RELS = f"""{_DVEC}, {_WORDS}, {_LISTS}, {_HYBRID}, sys as (select 'dense' as system, query_id, doc_id, rank from dense union all select 'sparse', query_id, doc_id, rank from sparse union all select 'hybrid', query_id, doc_id, rank from hybrid),
rel as (select system || ':' || query_id as query_id, system, rank, case when a.label = b.label then 1.0 when (a.label + b.label) % 3 = 0 then 0.5 else 0.0 end as rel from sys join v a on a.doc_id = sys.query_id join v b on b.doc_id = sys.doc_id)"""


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Graded relevance of the three systems' lists: equal labels 1, some others a half."""
    dense, sparse = settled(dense_hits(spark, sf)), settled(word_hits(spark, sf))  # a few rows for each query, used by three systems
    x = dense.withColumn("system", F.lit("dense")).unionByName(sparse.withColumn("system", F.lit("sparse"))).unionByName(r.hybrid(dense, sparse).withColumn("system", F.lit("hybrid")))
    v = dvec(spark, sf)
    a, b = v.select(F.col("doc_id").alias("query_id"), F.col("label").alias("la")), v.select("doc_id", F.col("label").alias("lb"))
    rel = F.when(F.col("la") == F.col("lb"), 1.0).when((F.col("la") + F.col("lb")) % 3 == 0, 0.5).otherwise(0.0)
    return x.join(a, "query_id").join(b, "doc_id").select(F.concat("system", F.lit(":"), F.col("query_id").cast("string")).alias("query_id"), "system", "rank", rel.alias("rel"))


_AT = ", ".join(f"coalesce(sum(rel) filter (where rank <= {k}), 0) / {k} as p{k}, least(1, coalesce(sum(rel) filter (where rank <= {k}), 0) / 2.0) as r{k}, coalesce(max(case when rank <= {k} and rel >= 0.55 then 1.0 else 0.0 end), 0) as h{k}, sum(case when rank <= {k} then rel / log2(rank + 1) else 0 end) as d{k}, sum(case when ideal <= {k} then rel / log2(ideal + 1) else 0 end) as i{k}" for k in (1, 3, 5))
_OUT = ", ".join(f"round(p{k}, 4) as precision_at_{k}, round(r{k}, 4) as recall_at_{k}, round(case when p{k} + r{k} > 0 then 2 * p{k} * r{k} / (p{k} + r{k}) else 0 end, 4) as f1_at_{k}, h{k} as hit_rate_at_{k}, round(case when i{k} > 0 then d{k} / i{k} when sr = 0 then 1 else 0 end, 4) as ndcg_at_{k}" for k in (1, 3, 5))
_RANKING = f"""{_RELS}, o as (select *, sum(rel) over (partition by query_id order by rank rows unbounded preceding) / rank as p, row_number() over (partition by query_id order by rel desc, rank) as ideal from rel),
agg as (select query_id, system, {_AT}, sum(rel) as sr, max(rel / rank) as mrr, least(1, sum(case when rel > 0 then p * rel else 0 end) / 2.0) as ap from o group by all),
scores as (select query_id, system, {_OUT}, round(mrr, 4) as mrr, round(ap, 4) as map from agg)"""


def ranking(spark: SparkSession, sf: str) -> DataFrame:
    h = ranked(spark, sf)
    totals = h.select("query_id").distinct().withColumn("total", F.lit(2.0))
    return ev.ranking_scores(h, totals)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each system and query with the blended score."""
    r = ranking(spark, sf)
    v = m.overall(F.col("recall_at_3"), F.col("map"), F.col("mrr"), F.col("precision_at_3"))
    return r.select(F.split("query_id", ":")[0].alias("system"), F.split("query_id", ":")[1].cast("long").alias("example_id"), F.round(v, 4).alias("overall"), "mrr", "precision_at_3")


_SCORED = f"{_RANKING}, sc as (select system, split_part(query_id, ':', 2)::bigint as example_id, round(0.25 * recall_at_3 + 0.35 * map + 0.25 * mrr + 0.15 * precision_at_3, 4) as overall, mrr, precision_at_3 from scores)"


@query("prec_recall_f1_at_k", f"with {_RANKING} select query_id, " + ", ".join(f"{n}_at_{k}" for k in (1, 3, 5) for n in ("precision", "recall", "f1")) + " from scores")
def prec_recall_f1_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return ranking(spark, sf).select("query_id", *[f"{n}_at_{k}" for k in (1, 3, 5) for n in ("precision", "recall", "f1")])


@query("hit_mrr", f"with {_RANKING} select query_id, hit_rate_at_3, mrr from scores")
def hit_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return ranking(spark, sf).select("query_id", "hit_rate_at_3", "mrr")


@query("average_precision", f'with {_RANKING} select query_id, "map" from scores')
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return ranking(spark, sf).select("query_id", "map")


@query("ndcg", f"with {_RANKING} select query_id, ndcg_at_3, ndcg_at_5 from scores")
def ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return ranking(spark, sf).select("query_id", "ndcg_at_3", "ndcg_at_5")


@query("overall_blend", f"with {_SCORED} select system, example_id, overall from sc")
def overall_blend(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("system", "example_id", "overall")


_BUCKET = "case example_id % 3 when 0 then 'dense_shared' when 1 then 'graph' else 'neutral' end"


@query("system_summary", f"with {_SCORED} select system, {_BUCKET} as bucket, round(avg(overall), 6) as overall, round(avg(mrr), 6) as mrr, count(*)::bigint as n from sc group by grouping sets ((system), (system, {_BUCKET}))")
def system_summary(spark: SparkSession, sf: str) -> DataFrame:
    b = F.element_at(F.array(F.lit("dense_shared"), F.lit("graph"), F.lit("neutral")), (F.col("example_id") % 3 + 1).cast("int"))
    s = scored(spark, sf).withColumn("bucket", b)
    return s.groupingSets([[F.col("system")], [F.col("system"), F.col("bucket")]], "system", "bucket").agg(F.round(F.avg("overall"), 6).alias("overall"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count(F.lit(1)).alias("n"))


@query("topic_extremes", f"""with {_SCORED}, t as (select example_id % 7 as topic, round(avg(overall), 4) as score from sc group by 1), r as (select *, row_number() over (order by score desc, topic) as best, row_number() over (order by score, topic) as worst from t)
select topic::bigint as topic, score, best::bigint as best, worst::bigint as worst from r where best <= 3 or worst <= 3""")
def topic_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return ev.extremes(scored(spark, sf).withColumn("topic", F.col("example_id") % 7), "topic", "overall")


@query("latency_budget", "select event_type, count(*)::bigint as n, round(avg(case when value > 50 then 1.0 else 0.0 end), 4) as violation_rate from events group by 1")
def latency_budget(spark: SparkSession, sf: str) -> DataFrame:
    late = F.when(F.col("value") > 50, 1.0).otherwise(0.0)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(late), 4).alias("violation_rate"))


@query("align_check", f"with {_SCORED}, e as (select distinct example_id from sc), s as (select distinct system from sc) select s.system, count(e.example_id)::bigint as expected, count(sc.example_id)::bigint as found from s cross join e left join sc on sc.system = s.system and sc.example_id = e.example_id group by 1")
def align_check(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    n = s.agg(F.count_distinct("example_id").alias("expected"))
    return s.groupBy("system").agg(F.count_distinct("example_id").alias("found")).join(F.broadcast(n), F.lit(True)).select("system", "expected", "found")


_IDX = "(('0x' || substr(md5('42-' || r || '-' || i), 1, 8))::bigint)"


def _ci(rows: str) -> str:
    return f"""b as (select *, row_number() over (partition by g order by o) - 1 as idx from ({rows})), n as (select g, count(*) as n, avg(x) as mean from b group by 1),
dr as (select g, r, i, {_IDX} % n as idx from n, range(2000) a(r), range(1000) c(i) where i < n), ms as (select g, r, avg(x) as m from dr join b using (g, idx) group by all),
k as (select *, row_number() over (partition by g order by m) as k from ms), e as (select g, max(m) filter (where k = 50) as low, max(m) filter (where k = 1950) as high from k group by 1)
select g, round(mean, 4) as mean, round(low, 4) as low, round(high, 4) as high, case when round(low, 4) > 0 or round(high, 4) < 0 then 'stable' else 'overlap_zero' end as label from n join e using (g)"""


@query("bootstrap_ci", f"with {_SCORED}, " + _ci("select system as g, example_id as o, overall as x from sc"))
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return ev.bootstrap_ci(scored(spark, sf).withColumnRenamed("system", "g"), "g", "overall", "example_id")


_PAIRS = "pairs as (select a.system || '-' || b.system as g, a.example_id as o, round(a.overall - b.overall, 4) as x from sc a join sc b on a.example_id = b.example_id and a.system < b.system)"


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    b = s.select(F.col("system").alias("sb"), "example_id", F.col("overall").alias("ob"))
    return s.join(b, "example_id").filter("system < sb").select(F.concat_ws("-", "system", "sb").alias("g"), F.col("example_id").alias("o"), F.round(F.col("overall") - F.col("ob"), 4).alias("x"))


@query("bootstrap_diff", f"with {_SCORED}, {_PAIRS}, " + _ci("select g, o, x from pairs"))
def bootstrap_diff(spark: SparkSession, sf: str) -> DataFrame:
    return ev.bootstrap_ci(diffs(spark, sf), "g", "x", "o")


@query("permutation_p", f"""with {_SCORED}, {_PAIRS}, b as (select *, row_number() over (partition by g order by o) - 1 as i from pairs), s as (select g, abs(avg(x)) as seen from b group by 1),
f as (select g, r, abs(avg(case when {_IDX} % 2 = 1 then x else -x end)) as m from b, range(5000) a(r) group by all)
select g, round((count(*) filter (where m >= seen - 1e-12) + 1) / 5001.0, 4) as p from f join s using (g) group by 1""")
def permutation_p(spark: SparkSession, sf: str) -> DataFrame:
    return ev.permutation_p(diffs(spark, sf), "g", "x", "o")


@query("pairwise_win", f"with {_SCORED}, {_PAIRS} select g, round(avg((x > 0)::int), 4) as win_rate, count(*)::bigint as n from pairs group by 1")
def pairwise_win(spark: SparkSession, sf: str) -> DataFrame:
    return diffs(spark, sf).groupBy("g").agg(F.round(F.avg((F.col("x") > 0).cast("int")), 4).alias("win_rate"), F.count(F.lit(1)).alias("n"))


@query("repeated_study", f"with {_SCORED}, r as (select system, example_id % 3 as run, avg(overall) as m from sc group by all) select system, count(*)::bigint as runs, round(avg(m), 4) as mean, round(stddev_pop(m), 4) as std from r group by 1")
def repeated_study(spark: SparkSession, sf: str) -> DataFrame:
    runs = scored(spark, sf).groupBy("system", (F.col("example_id") % 3).alias("run")).agg(F.avg("overall").alias("m"))
    return runs.groupBy("system").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_pop("m"), 4).alias("std"))


@query("tune_select", f"with {_SCORED}, c as (select system, 'c' || (example_id % 4) as candidate, round(avg(overall), 4) as mean from sc group by all) select system, candidate, mean from c qualify row_number() over (partition by system order by mean desc, candidate) = 1")
def tune_select(spark: SparkSession, sf: str) -> DataFrame:
    c = scored(spark, sf).groupBy("system", F.concat(F.lit("c"), (F.col("example_id") % 4).cast("string")).alias("candidate")).agg(F.round(F.avg("overall"), 4).alias("mean"))
    return ev.best(c, "system", "mean", "candidate")


@query("comparison_rank", f"""with {_SCORED}, s as (select system, round(avg(overall), 4) as overall from sc group by 1) select system, row_number() over (order by overall desc, system) as place, overall,
'| ' || system || ' | ' || format('{{:.4f}}', overall) || ' |' as row, repeat('#', round_even(least(1, greatest(0, overall)) * 24, 0)::int) || repeat('.', 24 - round_even(least(1, greatest(0, overall)) * 24, 0)::int) as bar from s""")
def comparison_rank(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    s = scored(spark, sf).groupBy("system").agg(m.mean_of_scores(F.col("overall")).alias("overall"))
    place = F.row_number().over(Window.orderBy(F.desc("overall"), "system")).cast("long")  # a row for each system
    return s.select("system", place.alias("place"), "overall", F.format_string("| %s | %.4f |", "system", "overall").alias("row"), m.bar(F.col("overall")).alias("bar"))


@query("kappa", """with t as (select quality::varchar as a, toxic::varchar as b, count(*) as c from labels where quality is not null and toxic is not null group by all), n as (select sum(c) as n, sum(case when a = b then c else 0 end) as same from t),
e as (select sum(x.c * y.c)::double as x from (select a, sum(c) as c from t group by 1) x join (select b, sum(c) as c from t group by 1) y on x.a = y.b)
select n::bigint as n, round(same / n::double, 4) as agreement, round((same / n::double - x / (n::double * n)) / (1 - x / (n::double * n)), 4) as kappa from n, e""")
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return ev.kappa(table(spark, sf, "labels"), "quality", "toxic")


@query("annotation_packet", rf"""with {_TURNS} select conv_id, turn, question, answer as model_answer, '[1] ' || substr(replace(answer, chr(10), ' '), 1, 280) as source_preview, '' as answer_correctness from turns where answer is not null""")
def annotation_packet(spark: SparkSession, sf: str) -> DataFrame:
    p = F.concat(F.lit("[1] "), F.substring(F.replace("answer", F.lit("\n"), F.lit(" ")), 1, 280))
    return answered(spark, sf).select("conv_id", "turn", "question", F.col("answer").alias("model_answer"), p.alias("source_preview"), F.lit("").alias("answer_correctness"))


_TOPIC = "case when source in ('src0', 'src1', 'src2') then 'dense_shared' when source in ('src3', 'src4') then 'graph' else 'neutral' end"


@query("dataset_assemble", f"select doc_id::varchar as id, {_TOPIC} as bucket, case when quality = 1 then 'dev' when quality = 0 then 'held_out_test' else 'all' end as split from documents left join labels using (doc_id)")
def dataset_assemble(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    bucket = F.when(F.col("source").isin("src0", "src1", "src2"), "dense_shared").when(F.col("source").isin("src3", "src4"), "graph").otherwise("neutral")
    split = F.when(F.col("quality") == 1, "dev").when(F.col("quality") == 0, "held_out_test").otherwise("all")
    return d.select(F.col("doc_id").cast("string").alias("id"), bucket.alias("bucket"), split.alias("split"))


@query("metric_means", f"with {_SCORED} select 'all' as split, round(avg(overall), 4) as overall, round(avg(mrr), 4) as mrr from sc")
def metric_means(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).agg(F.lit("all").alias("split"), F.round(F.avg("overall"), 4).alias("overall"), F.round(F.avg("mrr"), 4).alias("mrr"))
