"""Queries on answer texts, grading and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import answers as an
from tallyframe.functions import stats as st
from tallyframe.operators import grading as gr
from tallyframe.plans.base_sql import T
from tallyframe.plans.registry import query
from tallyframe.sources import adapters as ad

r6 = st.r6
MATH = F.lit


@query("extract_last_number", f"WITH {T} SELECT item, idx, CASE kind WHEN 5 THEN NULL WHEN 6 THEN '2' WHEN 7 THEN q || '.50' ELSE CAST(q AS VARCHAR) END AS answer FROM a")
def extract_last_number(spark, d):
    return ad.traces(spark, d).select("item", "idx", an.last_number_col(F.col("text")).alias("answer"))


@query("extract_answer", f"WITH {T} SELECT item, idx, answer FROM a")
def extract_answer(spark, d):
    return ad.traces(spark, d).select("item", "idx", an.extract_col(F.col("text"), F.lit("math")).alias("answer"))


@query("normalize_answer", f"WITH {T} SELECT item, idx, coalesce(norm, '') AS norm FROM a")
def normalize_answer(spark, d):
    t = ad.traces(spark, d).withColumn("answer", an.extract_col(F.col("text"), F.lit("math")))
    return t.select("item", "idx", an.normalize_col(F.col("answer"), F.lit("math")).alias("norm"))


@query("answers_equivalent", f"WITH {T} SELECT item, idx, coalesce(norm = gold, false) AS ok FROM a")
def answers_equivalent(spark, d):
    return gr.grade_traces(ad.traces(spark, d)).select("item", "idx", "ok")


_CLASSES = f"{T}, b AS (SELECT item, idx, answer, gold, norm, coalesce(norm, '<unparsed>') AS cls FROM a)"


@query("canonical_classes", f"WITH {_CLASSES} SELECT item, string_agg(cls, '|' ORDER BY idx) AS classes FROM b GROUP BY item")
def canonical_classes(spark, d):
    t = ad.traces(spark, d).withColumn("answer", an.extract_col(F.col("text"), F.lit("math")))
    per = t.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("idx", "answer"))).alias("xs"))
    return per.select("item", F.array_join(an.classes_col(F.col("xs.answer"), F.lit("math")), "|").alias("classes"))


_VOTES = f"""{_CLASSES}, v AS (SELECT item, cls, count(*) AS n, min(idx) AS f, arg_min(answer, idx) AS answer FROM b WHERE cls <> '<unparsed>' GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, f) AS rn, lead(n) OVER (PARTITION BY item ORDER BY n DESC, f) AS nxt FROM v)"""


@query("majority_vote", f"WITH {_VOTES} SELECT item, w.answer, CAST(coalesce(n, 0) AS BIGINT) AS votes, CAST(coalesce(nxt, 0) AS BIGINT) AS second, coalesce(n = nxt, false) AS tie FROM (SELECT DISTINCT item FROM b) LEFT JOIN (SELECT * FROM w WHERE rn = 1) w USING (item)")
def majority_vote(spark, d):
    t = ad.traces(spark, d).withColumn("answer", an.extract_col(F.col("text"), F.lit("math")))
    per = t.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("idx", "answer"))).alias("xs"))
    got = gr.with_vote(per.select("item", F.col("xs.answer").alias("answers")), "answers", F.lit("math"), out="v")
    return got.select("item", "v.answer", "v.votes", "v.second", "v.tie")


_GRADED = f"""{_VOTES}, gd AS (SELECT item, count(*) AS n_samples_graded, count(*) FILTER (cls = gold) AS n_correct_samples, arg_min(cls, idx) = min(gold) AS is_correct, count(*) FILTER (cls = '<unparsed>') AS fails,
  min(gold) AS gold FROM b GROUP BY item), vt AS (SELECT item, answer AS vote_answer, cls AS vote_class FROM w WHERE rn = 1)"""


@query("grade_records", f"WITH {_GRADED} SELECT item, n_samples_graded, n_correct_samples, is_correct, vote_answer, coalesce(vote_class = gold, false) AS vote_correct FROM gd LEFT JOIN vt USING (item)")
def grade_records(spark, d):
    return gr.grade_records(ad.traces(spark, d), ["item"]).select("item", "n_samples_graded", "n_correct_samples", "is_correct", "vote_answer", "vote_correct")


_STORED = """z AS (SELECT o_orderkey AS uid, o_orderkey % 4 AS kind, o_custkey % 7 AS p, o_custkey % 5 AS g, o_orderstatus = 'P' AS errored, o_orderkey % 11 = 0 AS cut, o_orderkey % 3 = 0 AS unnamed FROM orders),
y AS (SELECT *, CASE kind WHEN 0 THEN CAST(p AS VARCHAR) WHEN 1 THEN chr(CAST(65 + p % 4 AS INT)) WHEN 2 THEN CASE WHEN p % 2 = 0 THEN 'True' ELSE 'False' END ELSE 'word' || p END AS a,
  CASE kind WHEN 0 THEN CAST(g AS VARCHAR) WHEN 1 THEN chr(CAST(65 + g % 4 AS INT)) WHEN 2 THEN CASE WHEN g % 2 = 0 THEN 'True' ELSE 'False' END ELSE 'word' || g END AS b FROM z)"""


@query("grade_stored_records", f"""WITH {_STORED} SELECT uid, CASE WHEN cut THEN concat_ws('|', b, b, a) ELSE concat_ws('|', a, b, a) END AS answers, CAST(3 AS BIGINT) AS n_samples_graded,
  CAST(CASE WHEN a = b THEN 3 WHEN cut THEN 2 ELSE 1 END AS BIGINT) AS n_correct_samples, CASE WHEN cut THEN b ELSE a END AS vote_answer, cut OR a = b AS vote_correct,
  CASE WHEN NOT unnamed THEN b WHEN NOT errored AND NOT cut THEN a END AS pred_answer, NOT errored AND coalesce(CASE WHEN NOT unnamed THEN true WHEN NOT cut THEN a = b END, false) AS is_correct, b AS gold_normalized FROM y""")
def grade_stored_records(spark, d):
    return gr.grade_stored(ad.stored_records(spark, d)).select(
        "uid", F.array_join("sample_answers", "|").alias("answers"), "n_samples_graded", "n_correct_samples", "vote_answer", "vote_correct", "pred_answer", "is_correct", "gold_normalized"
    )


@query("grading_summary", f"""WITH {_GRADED} SELECT count(*) AS n_total, count(*) FILTER (is_correct) AS n_correct, round(avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(CASE WHEN vote_class = gold THEN 1.0 ELSE 0.0 END), 6) AS vote_accuracy, CAST(sum(fails) AS BIGINT) AS extraction_failures, round(sum(fails) / CAST(sum(n_samples_graded) AS DOUBLE), 6) AS failure_rate
FROM gd LEFT JOIN vt USING (item)""")
def grading_summary(spark, d):
    return gr.summary(gr.grade_records(ad.traces(spark, d), ["item"]))


@query("extractor_agreement", f"""WITH {T}, x AS (SELECT kind, norm, CASE kind WHEN 5 THEN NULL WHEN 6 THEN norm WHEN 7 THEN q || '.5' ELSE CAST(q AS VARCHAR) END AS alt FROM a)
SELECT kind, count(*) AS n, round(avg(CASE WHEN norm IS NOT DISTINCT FROM alt THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(CASE WHEN norm IS NULL THEN 1.0 ELSE 0.0 END), 6) AS primary_failure,
  round(avg(CASE WHEN alt IS NULL THEN 1.0 ELSE 0.0 END), 6) AS alternate_failure FROM x GROUP BY kind""")
def extractor_agreement(spark, d):
    k = F.lit("math")
    t = ad.traces(spark, d).withColumn("p", an.extract_col(F.col("text"), k)).withColumn("q", an.extract_col(F.col("text"), k, alternate=True))
    t = t.withColumn("same", F.when(F.col("p").isNull() | F.col("q").isNull(), F.col("p").isNull() & F.col("q").isNull()).otherwise(an.equivalent_col(F.col("p"), F.col("q"), k)))
    return t.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("same").cast("int"))).alias("agreement"), r6(F.avg(F.col("p").isNull().cast("int"))).alias("primary_failure"), r6(F.avg(F.col("q").isNull().cast("int"))).alias("alternate_failure")
    )


@query("integer_gold_only", f"WITH {T} SELECT kind, count(*) AS n FROM a WHERE norm IS NOT NULL AND norm NOT LIKE '%.%' GROUP BY kind")
def integer_gold_only(spark, d):
    k = F.lit("math")
    t = ad.traces(spark, d).withColumn("answer", an.extract_col(F.col("text"), k)).withColumn("norm", an.normalize_col(F.col("answer"), k))
    return t.where(F.col("norm").rlike(r"^-?\d+$")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_MARK = an.CUT_MARK.replace("\n", "")
_N = 200 + len(an.CUT_MARK)


@query("trace_policy_truncate", f"""SELECT doc_id, CASE WHEN length(text) <= {_N} THEN length(text) ELSE {_N} END AS n,
  md5(CASE WHEN length(text) <= {_N} THEN text ELSE left(text, 100) || chr(10) || '{_MARK}' || chr(10) || right(text, 100) END) AS digest FROM documents""")
def trace_policy_truncate(spark, d):
    t = ad.table(spark, d, "documents").select("doc_id", an.shorten(F.col("text"), 100).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("stop_sequence_trim", """SELECT doc_id, md5(CASE WHEN p IS NULL THEN text ELSE left(text, p - 1) END) AS digest, p IS NOT NULL AS cut
FROM (SELECT doc_id, text, least(nullif(instr(text, '. T'), 0), nullif(instr(text, chr(10) || 'A'), 0), nullif(instr(text, '###'), 0)) AS p FROM documents)""")
def stop_sequence_trim(spark, d):
    t = ad.table(spark, d, "documents").select("doc_id", an.stop_at(F.col("text"), [". T", "\nA", "###"]).alias("s"))
    return t.select("doc_id", F.md5(F.col("s.text").cast("binary")).alias("digest"), F.col("s.cut").alias("cut"))


@query("approx_tokens", "SELECT doc_id, CAST(CASE WHEN length(text) > 0 THEN greatest(1, ceil(length(text) / 4.0)) ELSE 0 END AS BIGINT) AS tokens FROM documents")
def approx_tokens(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", an.approx_tokens(F.col("text")).alias("tokens"))


@query("chat_render", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id")
def chat_render(spark, d):
    per = ad.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return per.select("conv_id", F.md5(text.cast("binary")).alias("digest"), F.size("xs").cast("long").alias("turns"))
