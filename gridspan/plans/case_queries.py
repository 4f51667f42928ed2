"""Queries of catalogues, schedules, reports and parsing: cases from ``orders``, ``customer`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.functions import parse
from gridspan.operators import losses, metrics, ordering, reductions, report, schedules, selection
from gridspan.plans.catalogue import arrays, beside, query, rounded, table
from gridspan.sources import logs

V = F.col


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) SELECT c_custkey FROM r WHERE (k BETWEEN 10 AND 59 OR c_custkey = 90 OR k = 100) AND c_custkey <> 20 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def subset_selectors(spark, sf_dir):
    listed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(V("o_custkey").cast("string").alias("name"))
    return selection.select_cases(table(spark, sf_dir, "customer"), "c_custkey", ["10:60", "90", 100, "~20", "~listed.txt"], {"listed.txt": listed})


@query("WITH d AS (SELECT DISTINCT c_custkey, ((c_custkey + 3 * 7919) % 2147483648 * 1103515245 + 12345) % 2147483648 AS draw FROM customer), p AS (SELECT c_custkey, row_number() OVER (ORDER BY draw, c_custkey) - 1 AS place FROM d) SELECT c_custkey FROM p WHERE place < 40")
def sample_cases(spark, sf_dir):
    return selection.sample_cases(table(spark, sf_dir, "customer"), "c_custkey", 40, 3)


@query("WITH w AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_orderkey) - 1 AS k FROM w) SELECT l_orderkey, n, (CASE WHEN k // 4 % 2 = 0 THEN k % 4 ELSE 3 - k % 4 END)::INT AS worker FROM p")
def case_workers(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return selection.dealt(w, "l_orderkey", "n", 4)


@query("WITH m AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), e AS (SELECT r.range AS r, n * r.range // 7 AS a, n * (r.range + 1) // 7 AS b FROM range(7) r, (SELECT max(n) AS n FROM m)), t AS (SELECT *, max(b - a) OVER () AS most FROM e) SELECT m.o_orderkey, t.r::INT AS shard, k >= t.a + 0 AND k >= t.b AS padding FROM m JOIN t ON k >= t.a AND k < t.b UNION ALL SELECT m.o_orderkey, t.r::INT, true FROM m JOIN t ON k >= t.a AND k < t.a + (t.most - (t.b - t.a))")
def case_shards(spark, sf_dir):
    return selection.shards(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("WITH f AS (SELECT c_mktsegment, min(c_custkey) AS f FROM customer GROUP BY 1) SELECT c_custkey, (SELECT count(*) FROM f g WHERE g.f < f.f)::BIGINT AS index FROM customer JOIN f USING (c_mktsegment)")
def dense_index(spark, sf_dir):
    return selection.dense_index(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_custkey"]).select("c_custkey", "index")


@query("WITH a AS (SELECT DISTINCT user_id, CASE event_type WHEN 'click' THEN 'CT' WHEN 'view' THEN 'SEG' ELSE event_type END AS grp FROM events WHERE event_type <> 'error') SELECT grp, count(*) AS cases FROM a GROUP BY grp")
def group_aliases(spark, sf_dir):
    present = table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", V("event_type").alias("grp")).distinct()
    return selection.aliased(present, "user_id", "grp", {"click": "CT", "view": "SEG"})[0].groupBy("grp").agg(F.count("*").alias("cases"))


@query("WITH s AS (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'error') SELECT user_id FROM s WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def common_by_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda k: e.where(V("event_type") == k).select("user_id")
    return selection.common_by_flags([("a", of("click")), ("a", of("error")), ("i", of("purchase"))], "user_id")


@query("SELECT o_orderpriority, list_transform([max(o_orderkey % 9 + 1), max(o_orderkey % 7 + 3)], lambda x: x::INT)[1] AS z, max(o_orderkey % 7 + 3)::INT AS y FROM orders GROUP BY 1")
def worst_shape(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.array((V("o_orderkey") % 9 + 1).cast("int"), (V("o_orderkey") % 7 + 3).cast("int")).alias("shape"))
    return selection.worst_shape(o, ["o_orderpriority"], "shape").select("o_orderpriority", F.get("shape", F.lit(0)).alias("z"), F.get("shape", F.lit(1)).alias("y"))


@query("SELECT event_id, round(1e-5 + (1 - 1e-5) * (1 + cos(pi() * event_id / 100)) / 2, 6) AS cosine, round(least(1, (event_id + 1) / 11.0), 6) AS warm, round(0.01 * (1 - least(event_id, 1000) / 1000.0) ** 0.9, 8) AS poly FROM events")
def schedules_by_step(spark, sf_dir):
    s = V("event_id")
    return rounded(table(spark, sf_dir, "events").select("event_id", schedules.cosine_annealing(s).alias("cosine"), schedules.warmup(s).alias("warm"), schedules.polynomial(s, 0.01, 1000).alias("poly")), cosine=6, warm=6, poly=8)


@query("WITH e AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), g AS (SELECT *, max(CASE WHEN best IS NULL OR value < best THEN k END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM e), s AS (SELECT user_id, min(event_id) FILTER (WHERE k - last >= 8) AS stop_step FROM g GROUP BY 1) SELECT e.user_id, s.stop_step, round(min(e.value), 4) AS best FROM events e JOIN s ON s.user_id = e.user_id AND (s.stop_step IS NULL OR e.event_id <= s.stop_step) GROUP BY ALL")
def early_stop(spark, sf_dir):
    return rounded(schedules.early_stop(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 8))


@query("WITH n AS (SELECT DISTINCT event_type || CASE WHEN user_id % 3 = 0 THEN '_loss' WHEN user_id % 3 = 1 THEN '_Dice' ELSE '_hd95' END AS metric FROM events) SELECT metric, CASE WHEN metric LIKE '%Dice' THEN 'max' ELSE 'min' END AS direction, CASE WHEN metric LIKE '%Dice' THEN 'heuristic:max' ELSE 'heuristic:min' END AS source FROM n")
def metric_directions(spark, sf_dir):
    kind = F.when(V("user_id") % 3 == 0, "_loss").when(V("user_id") % 3 == 1, "_Dice").otherwise("_hd95")
    names = table(spark, sf_dir, "events").select(F.concat("event_type", kind).alias("metric")).distinct()
    return names.select("metric", report.direction(V("metric")).alias("d")).select("metric", "d.*")


@query("WITH r AS (SELECT event_type || '_loss' AS metric, user_id AS run, round(avg(value), 6) AS score, max(ts) AS ts FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score, ts DESC, run) AS place FROM r) SELECT metric, run, round(score, 4) AS score, 'min' AS direction, place::INT AS place FROM p WHERE place <= 4")
def scoreboard(spark, sf_dir):
    from gridspan.plans.catalogue import half_up

    runs = table(spark, sf_dir, "events").groupBy(F.concat("event_type", F.lit("_loss")).alias("metric"), V("user_id").alias("run")).agg(half_up(F.avg("value"), 6).alias("score"), F.max("ts").alias("ts"))
    return rounded(report.scoreboard(runs, "metric", "run", "score", "ts", 4).drop("ts"))


@query("WITH c AS (SELECT event_type, user_id % 4 AS part, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type || ':' || part AS metric, round(v, 4) AS value FROM c UNION ALL SELECT event_type, round(avg(v), 4) FROM c GROUP BY event_type")
def metric_components(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type", (V("user_id") % 4).cast("string").alias("part")).agg(F.avg("value").alias("v"))
    return rounded(report.with_components(c, [], "event_type", "part", "v"))


@query("WITH l AS (SELECT DISTINCT event_type AS k FROM events UNION ALL SELECT DISTINCT event_type || ':' || user_id % 4 FROM events UNION ALL SELECT 'other:x') SELECT k FROM l WHERE k NOT LIKE '%:%' OR k = 'other:x'")
def report_top_level(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keys = e.select(V("event_type").alias("k")).distinct().union(e.select(F.concat_ws(":", "event_type", (V("user_id") % 4).cast("string"))).distinct()).union(e.sparkSession.range(1).select(F.lit("other:x")))
    return report.top_level(keys, "k")


@query("WITH k AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL) SELECT * FROM k")
def latest_values(spark, sf_dir):
    return report.latest(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id")


@query("WITH s AS (SELECT c_nationkey AS nation, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY nation) AS share FROM s) SELECT label, count(*) AS cases, round(avg(share), 5) AS mean_share FROM t GROUP BY label")
def label_presence(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(V("c_nationkey").alias("nation"), V("c_mktsegment").alias("label"))
    return rounded(report.label_presence(c, "nation", "label"), 5)


@query("WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, count(v) AS count FROM s GROUP BY vec_id")
def case_statistics(spark, sf_dir):
    return rounded(report.case_statistics(arrays(spark, sf_dir), ["vec_id"], "v"))


@query("WITH s AS (SELECT label, unnest(range(3))::INT AS position, unnest(embedding[1:3])::DOUBLE AS v FROM embeddings) SELECT label, position, round(max(v), 4) AS max, round(min(v), 4) AS min, round(stddev_pop(v), 4) AS std, round(avg(v), 4) AS mean FROM s GROUP BY ALL")
def element_statistics(spark, sf_dir):
    return rounded(report.element_statistics(arrays(spark, sf_dir).withColumn("v", F.slice("v", 1, 3)), ["label"], "v"))


@query("WITH a AS (SELECT event_type AS path, avg(value) AS v FROM events WHERE user_id % 2 = 0 AND event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS path, avg(value) AS v FROM events WHERE (user_id % 2 = 1 OR event_type = 'click') AND event_type <> 'error' GROUP BY 1) SELECT coalesce(a.path, b.path) AS path, a.path IS NOT NULL AS in_a, b.path IS NOT NULL AS in_b FROM a FULL JOIN b ON a.path = b.path WHERE a.v IS DISTINCT FROM b.v")
def config_differences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda where: e.where(where).groupBy(V("event_type").alias("path")).agg(F.avg("value").alias("v"))
    d = report.config_differences(side("user_id % 2 = 0 and event_type <> 'view'"), side("(user_id % 2 = 1 or event_type = 'click') and event_type <> 'error'"), "path", "v")
    return d.select("path", V("a").isNotNull().alias("in_a"), V("b").isNotNull().alias("in_b"))


@query("WITH s AS (SELECT label, vec_id AS member, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT label, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS n FROM s) SELECT label, round(coalesce(stddev_samp(n), 0), 4) AS uncertainty FROM l GROUP BY label")
def displacement_uncertainty(spark, sf_dir):
    e = arrays(spark, sf_dir).select("label", V("vec_id").alias("member"), *[F.get("v", F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    return rounded(reductions.uncertainty(e, ["label"], "member", ["x", "y", "z"]))


@query("WITH s AS (SELECT label, vec_id % 3 AS copy, unnest(range(64)) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings), i AS (SELECT label, copy, x, quantile_disc(v, 0.5) AS v FROM s GROUP BY ALL) SELECT label, x::INT AS x, round(avg(v), 4) AS v FROM i GROUP BY ALL")
def ensemble_nested(spark, sf_dir):
    m = arrays(spark, sf_dir).select("label", (V("vec_id") % 3).alias("copy"), F.posexplode("v").alias("x", "v"))
    return rounded(reductions.nested(m, ["label", "x"], "copy", "v", "median", "mean"))


@query("SELECT event_type, round(sum(value * (user_id % 5)), 3) AS loss FROM events GROUP BY event_type")
def loss_by_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("w", (V("user_id") % 5).cast("double"))
    return rounded(losses.loss_by_group(e, [], "event_type", "w", "value"), 3)


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, round(avg(value), 4) AS value FROM r WHERE k <= 20 GROUP BY user_id HAVING count(*) = 20")
def formatted_losses(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("w", F.lit(1.0))
    return rounded(losses.formatted_losses(e, ["user_id"], "event_id", "w", "value", 20).drop("weight"))


@query("WITH s AS (SELECT vec_id % 5 AS grp, unnest(embedding)::DOUBLE AS v, vec_id FROM embeddings), k AS (SELECT grp, vec_id, var_samp(v) AS s FROM s GROUP BY ALL) SELECT grp::INT AS grp, round(avg(s), 4) AS variance FROM k GROUP BY grp")
def channel_variance(spark, sf_dir):
    return rounded(metrics.mean_variance(arrays(spark, sf_dir).withColumn("grp", (V("vec_id") % 5).cast("int")), ["grp"], V("v")))


@query("SELECT user_id, round(quantile_cont(value, 0.1), 4) AS low, round(quantile_cont(value, 0.9), 4) AS high FROM events GROUP BY user_id")
def exact_quantiles(spark, sf_dir):
    return rounded(ordering.quantiles(table(spark, sf_dir, "events"), ["user_id"], "value", [0.1, 0.9], ["low", "high"]))


@query("WITH t AS (SELECT event_id, (event_id % 50)::VARCHAR || CASE event_id % 4 WHEN 0 THEN 'GB' WHEN 1 THEN ' GiB' WHEN 2 THEN 'mb' ELSE '' END AS s FROM events) SELECT event_id, ((event_id % 50) * CASE WHEN event_id % 4 = 2 THEN 1048576 ELSE 1073741824 END)::BIGINT AS bytes, round((event_id % 50) / 100.0, 4) AS part FROM t")
def parse_sizes(spark, sf_dir):
    n = (V("event_id") % 50).cast("string")
    unit = F.when(V("event_id") % 4 == 0, "GB").when(V("event_id") % 4 == 1, " GiB").when(V("event_id") % 4 == 2, "mb").otherwise("")
    e = table(spark, sf_dir, "events")
    return rounded(e.select("event_id", parse.memory_bytes(F.concat(n, unit)).alias("bytes"), parse.fraction(F.concat(n, F.lit("%"))).alias("part")))


@query("SELECT event_id, event_type AS label, user_id AS step, round(value, 4) AS loss FROM events")
def log_live(spark, sf_dir):
    line = F.concat(V("event_type"), F.lit(" : Loss (Net(0.001000) : MAE(1.00) : "), V("value").cast("string"), F.lit(") GPU([0]) Memory (3.96G (27.60 %)):  16% "), V("user_id"), F.lit("/2130 [19:06<1:03:43,  2.13s/it]"))
    read = logs.live(table(spark, sf_dir, "events").select("event_id", line.alias("line")), "line")
    return rounded(read.select("event_id", "label", "step", F.try_element_at("metrics", F.lit("Net:MAE")).alias("loss")))


@query("WITH s AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS a, unnest(b.embedding)::DOUBLE AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(avg(abs(a - b)), 4) AS content, round(avg((a - b) * (a - b)), 4) AS squared FROM s GROUP BY vec_id")
def feature_distance(spark, sf_dir):
    return rounded(beside(spark, sf_dir, 1).select("vec_id", metrics.feature_distance(V("v0"), V("v1")).alias("content"), metrics.feature_distance(V("v0"), V("v1"), True).alias("squared")))
