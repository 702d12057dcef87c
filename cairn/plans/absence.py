"""Queries of coverage, absence and contradiction: parts' brands and types, supply and sales as measurements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import r6
from ..operators import absence
from ..registry import query
from ..sources.tables import read

#: Share of a flag's lines that were found to be final, smoothed: the recall of the type's extractor here.
GRID = """brands AS (SELECT DISTINCT p_brand AS material FROM part), kinds AS (SELECT DISTINCT p_type || '/' || p_size AS property FROM part),
obs AS (SELECT p_brand AS material, p_type || '/' || p_size AS property, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
grid AS (SELECT material, property, coalesce(n, 0) AS evidence_count, (length(property) % 10) / 10.0::DOUBLE AS recall FROM brands CROSS JOIN kinds LEFT JOIN obs USING (material, property)),
post AS (SELECT *, 0.5 / (0.5 + 0.5 * (1 - recall)) AS p FROM grid),
cells AS (SELECT material, property, evidence_count, recall, CASE WHEN evidence_count > 0 THEN 0.0 WHEN recall < 0.4 THEN NULL ELSE p END AS confidence,
  CASE WHEN evidence_count > 0 THEN 'covered' WHEN recall < 0.4 THEN 'unknown' WHEN round(p, 4) >= 0.66 THEN 'confident_absence' ELSE 'possible_absence' END AS status FROM post)"""


def cells(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("material"), F.concat_ws("/", "p_type", "p_size").alias("property"))
    lines = read(spark, sf, "lineitem").select("l_partkey")
    seen = part.join(lines, F.col("l_partkey") == F.col("p_partkey"))
    grid = absence.coverage_grid(part.select("material").distinct(), part.select("property").distinct(), seen, ["material", "property"])
    grid = grid.withColumn("recall", (F.length("property") % 10) / 10.0)
    return absence.absence(grid, F.col("recall"))


@query("coverage_grid", f"WITH {GRID} SELECT material, property, evidence_count FROM grid")
def _grid(spark, sf):
    return cells(spark, sf).select("material", "property", "evidence_count")


@query("absence_posterior", f"WITH {GRID} SELECT material, property, evidence_count, recall, round(confidence, 6) AS confidence, status FROM cells")
def _posterior(spark, sf):
    return cells(spark, sf).withColumn("confidence", r6(F.col("confidence")))


@query("flagship", f"""WITH {GRID}, s AS (SELECT *, 0.4 * coalesce(confidence, 0.5) + 0.25 * recall + 0.35 * (1 - recall) AS score FROM cells WHERE evidence_count = 0),
r AS (SELECT material, property, status, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, material, property) AS place FROM s) SELECT * FROM r WHERE place <= 20""")
def _flagship(spark, sf):
    """The twenty gaps that most deserve an experiment."""
    score = absence.gap_priority({"absence": (0.4, F.col("confidence")), "importance": (0.25, F.col("recall")), "novelty": (0.35, 1 - F.col("recall"))})
    top = cells(spark, sf).where("evidence_count = 0").withColumn("score", r6(score)).orderBy(F.desc("score"), "material", "property").limit(20)
    return top.select("material", "property", "status", "score", F.row_number().over(Window.orderBy(F.desc("score"), "material", "property")).cast("long").alias("place"))


@query("voi_rank", f"""WITH {GRID}, v AS (SELECT material, property, 1 - p AS q FROM post WHERE evidence_count = 0), e AS (SELECT *, CASE WHEN q <= 0 OR q >= 1 THEN 0.0 ELSE -(q * log2(q) + (1 - q) * log2(1 - q)) END AS voi FROM v)
SELECT material, property, round(voi, 6) AS voi FROM e""")
def _voi(spark, sf):
    q = 1 - absence.posterior(F.col("recall"))
    return cells(spark, sf).where("evidence_count = 0").select("material", "property", r6(absence.binary_entropy(q)).alias("voi"))


@query("map_entropy", f"""WITH {GRID}, c AS (SELECT count(*)::DOUBLE AS n FROM cells GROUP BY status), p AS (SELECT n / sum(n) OVER () AS p FROM c)
SELECT round(sum(-p * log2(p)), 6) AS entropy, count(*) AS kinds, round(CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS normalised FROM p""")
def _entropy(spark, sf):
    got = absence.entropy_of(cells(spark, sf))
    return got.select(r6(F.col("entropy")).alias("entropy"), "kinds", r6(F.col("normalised")).alias("normalised"))


@query("coverage_inequality", f"""WITH {GRID}, i AS (SELECT material, evidence_count AS x, row_number() OVER (PARTITION BY material ORDER BY evidence_count) AS i FROM cells)
SELECT material, round(CASE WHEN sum(x) = 0 THEN 0 ELSE 2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*) END, 6) AS gini FROM i GROUP BY material""")
def _gini(spark, sf):
    return absence.gini(cells(spark, sf), ["material"], "evidence_count").select("material", r6(F.col("gini")).alias("gini"))


@query("gap_heatmap", f"""WITH {GRID} SELECT material, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'confident_absence') AS confident_absence,
count(*) FILTER (status = 'possible_absence') AS possible_absence, count(*) FILTER (status = 'unknown') AS unknown FROM cells GROUP BY material""")
def _heat(spark, sf):
    kinds = ["covered", "confident_absence", "possible_absence", "unknown"]
    return cells(spark, sf).groupBy("material").pivot("status", kinds).count().na.fill(0)


@query("coverage_3d", """WITH b AS (SELECT DISTINCT p_brand FROM part), f AS (SELECT DISTINCT l_returnflag FROM lineitem), s AS (SELECT DISTINCT l_linestatus FROM lineitem),
o AS (SELECT p_brand, l_returnflag, l_linestatus, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_brand, l_returnflag, l_linestatus, coalesce(n, 0) AS evidence_count FROM b CROSS JOIN f CROSS JOIN s LEFT JOIN o USING (p_brand, l_returnflag, l_linestatus)""")
def _grid3(spark, sf):
    part, lines = read(spark, sf, "part"), read(spark, sf, "lineitem")
    seen = part.join(lines, F.col("l_partkey") == F.col("p_partkey"))
    regimes = lines.select("l_returnflag").distinct().crossJoin(lines.select("l_linestatus").distinct())
    return absence.coverage_grid(part.select("p_brand").distinct(), regimes, seen, ["p_brand", "l_returnflag", "l_linestatus"])


@query("gap_dashboard", """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag) + 2 * grouping(l_linestatus) + 4 * grouping(l_linenumber) AS level
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), (l_linenumber), ())""")
def _dashboard(spark, sf):
    read(spark, sf, "lineitem").createOrReplaceTempView("_dashboard_lines")
    return spark.sql("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
        CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) + 4 * grouping(l_linenumber) AS BIGINT) AS level
        FROM _dashboard_lines GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), (l_linenumber), ())""")


@query("gap_rollup", """SELECT r_name, n_name, count(*) AS customers, grouping(r_name) + grouping(n_name) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def _rollup(spark, sf):
    t = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), (F.grouping("r_name") + F.grouping("n_name")).cast("long").alias("level"))


@query("recall_priors", """WITH a AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS k FROM events GROUP BY 1), w AS (SELECT *, k::DOUBLE / n AS p FROM a)
SELECT event_type, n, k, round((k + 14.0) / (n + 20), 6) AS smoothed, round((k + 0.5) / (n + 1), 6) AS jeffreys,
round(greatest(0, least(1, (p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))), 6) AS wilson_low,
round(greatest(0, least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))), 6) AS wilson_high FROM w""")
def _recall(spark, sf):
    a = read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    low, high = absence.wilson(F.col("k"), F.col("n"))
    return a.select("event_type", "n", "k", r6(absence.smoothed_recall(F.col("k"), F.col("n"))).alias("smoothed"), r6(absence.jeffreys(F.col("k"), F.col("n"))).alias("jeffreys"), r6(low).alias("wilson_low"), r6(high).alias("wilson_high"))


@query("near_miss_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def _near_miss(spark, sf):
    mentioned, seen = read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return absence.near_misses(mentioned, seen, ["c_custkey"])


@query("blindspot_report", "SELECT p_brand, count(*) AS parts, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS unseen FROM part GROUP BY 1")
def _blind(spark, sf):
    part, lines = read(spark, sf, "part"), read(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    seen = lines.distinct().withColumn("_seen", F.lit(True))
    return part.join(seen, "p_partkey", "left").groupBy("p_brand").agg(F.count("*").alias("parts"), F.count_if(F.col("_seen").isNull()).alias("unseen"))


PRICE = "m AS (SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity AS price, l_quantity FROM lineitem)"


def prices(spark, sf):
    return read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity")


@query("contradictions", f"""WITH {PRICE}, g AS (SELECT l_partkey, count(*) AS n, min(price) AS low, max(price) AS high FROM m GROUP BY 1), d AS (SELECT *, (high - low) / greatest(abs(high), abs(low)) AS difference FROM g),
s AS (SELECT *, difference * (0.5 + 0.5 * ((l_partkey % 10) / 10.0)) AS score FROM d WHERE difference >= 0.3)
SELECT l_partkey, n, round(difference, 6) AS difference, round(score, 6) AS score, CASE WHEN score >= 0.6 THEN 'critical' WHEN score >= 0.4 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END AS severity FROM s""")
def _contradictions(spark, sf):
    found = absence.contradictions(prices(spark, sf), ["l_partkey"], "price")
    score, label = absence.severity(F.col("difference"), (F.col("l_partkey") % 10) / 10.0)
    return found.select("l_partkey", "n", r6(F.col("difference")).alias("difference"), r6(score).alias("score"), label.alias("severity"))


@query("measurement_consensus", f"""WITH {PRICE}, c AS (SELECT *, sum(price * l_quantity) OVER w / sum(l_quantity) OVER w AS mu FROM m WINDOW w AS (PARTITION BY l_partkey))
SELECT l_partkey, count(*) AS n, round(min(mu), 6) AS consensus, round(max(price) - min(price), 6) AS spread, count(*) FILTER (abs(price - mu) > 0.5 * abs(mu)) AS outliers FROM c GROUP BY l_partkey""")
def _consensus(spark, sf):
    got = absence.consensus(prices(spark, sf), ["l_partkey"], "price", "l_quantity")
    return got.select("l_partkey", "n", r6(F.col("consensus")).alias("consensus"), r6(F.col("spread")).alias("spread"), "outliers")


@query("outliers", """WITH q AS (SELECT c_nationkey, count(*) AS n, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS q2, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1),
d AS (SELECT c.*, q1, q2, q3, n, abs(c_acctbal - q2) AS d FROM customer c JOIN q USING (c_nationkey)), m AS (SELECT c_nationkey, median(d) AS mad FROM d GROUP BY 1),
z AS (SELECT c_custkey, c_nationkey, c_acctbal, coalesce((c_acctbal - q2) / nullif(1.4826 * mad, 0), 0) AS robust_z, c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1) AS by_iqr FROM d JOIN m USING (c_nationkey) WHERE n >= 4)
SELECT c_custkey, c_nationkey, round(robust_z, 6) AS robust_z, by_iqr FROM z WHERE by_iqr OR abs(robust_z) > 1.2""")
def _outliers(spark, sf):
    got = absence.outliers(read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", z=1.2)
    return got.select("c_custkey", "c_nationkey", r6(F.col("robust_z")).alias("robust_z"), "by_iqr")


@query("population_summary", """SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 4) AS sd, round(quantile_cont(p_retailprice, 0.05), 4) AS p5,
round(quantile_cont(p_retailprice, 0.25), 4) AS p25, round(quantile_cont(p_retailprice, 0.5), 4) AS p50, round(quantile_cont(p_retailprice, 0.75), 4) AS p75, round(quantile_cont(p_retailprice, 0.95), 4) AS p95 FROM part GROUP BY 1""")
def _population(spark, sf):
    got = absence.population(read(spark, sf, "part"), ["p_brand"], "p_retailprice")
    return got.select("p_brand", "n", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "p5", "p25", "p50", "p75", "p95")))


@query("gap_trends", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'error'), days AS (SELECT DISTINCT day FROM d),
n AS (SELECT day, lead(day) OVER (ORDER BY day) AS next_day, lag(day) OVER (ORDER BY day) AS last_day FROM days),
o AS (SELECT n.day, count(*) FILTER (p.user_id IS NULL) AS opened, count(*) AS open FROM n JOIN d ON d.day = n.day LEFT JOIN d p ON p.day = n.last_day AND p.user_id = d.user_id GROUP BY 1),
c AS (SELECT n.next_day AS day, count(*) FILTER (p.user_id IS NULL) AS closed FROM n JOIN d ON d.day = n.day LEFT JOIN d p ON p.day = n.next_day AND p.user_id = d.user_id WHERE n.next_day IS NOT NULL GROUP BY 1)
SELECT CAST(o.day AS VARCHAR) AS day, open, opened, coalesce(closed, 0) AS closed, opened - coalesce(closed, 0) AS net FROM o LEFT JOIN c USING (day)""")
def _trends(spark, sf):
    """Who was affected on each day, who joined and who left since the day before that has any."""
    own = read(spark, sf, "events").where("event_type = 'error'").select(F.to_date("ts").alias("day"), "user_id").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("day")
    days = own.select("day").distinct().select("day", F.lag("day").over(order).alias("last"), F.lead("day").over(order).alias("next"))
    own = own.join(days, "day")
    before, after = own.select(F.col("day").alias("last"), "user_id", F.lit(1).alias("was")), own.select(F.col("day").alias("next"), "user_id", F.lit(1).alias("stays"))
    opened = own.join(before, ["last", "user_id"], "left").groupBy("day").agg(F.count("*").alias("open"), F.count_if(F.col("was").isNull()).alias("opened"))
    closed = own.where("next IS NOT NULL").join(after, ["next", "user_id"], "left").groupBy(F.col("next").alias("day")).agg(F.count_if(F.col("stays").isNull()).alias("closed"))
    both = opened.join(closed, "day", "left").na.fill(0, ["closed"])
    return both.select(F.col("day").cast("string").alias("day"), "open", "opened", "closed", (F.col("opened") - F.col("closed")).alias("net"))


@query("coverage_burndown", """WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), a AS (SELECT count(*) AS k, arg_min(n, day) AS first, arg_max(n, day) AS last FROM d)
SELECT k AS snapshots, first AS first_open, last AS last_open, round((first - last) / (k - 1.0), 6) AS rate, CASE WHEN first > last THEN round(last / ((first - last) / (k - 1.0)), 6) END AS eta FROM a""")
def _burndown(spark, sf):
    days = read(spark, sf, "events").where("event_type = 'error'").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    a = days.agg(F.count("*").alias("snapshots"), F.min_by("n", "day").alias("first_open"), F.max_by("n", "day").alias("last_open"))
    rate = F.try_divide(F.col("first_open") - F.col("last_open"), F.col("snapshots") - 1)
    return a.select("*", r6(rate).alias("rate"), r6(F.when(rate > 0, F.col("last_open") / rate)).alias("eta"))
