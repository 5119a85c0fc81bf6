"""Classification metrics from one pass over (y, p): everything reads the counts per distinct score or per bucket."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import distributions as dist

#: The 99 thresholds from 0.01 to 0.99.
GRID = [0.01 + i * ((0.99 - 0.01) / 98) for i in range(99)]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    return df.agg(*[F.count_if(c).alias(n) for n, c in (("tn", ~pos & ~hit), ("fp", ~pos & hit), ("fn", pos & ~hit), ("tp", pos & hit))])


def rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined), false positive rate and Matthews' coefficient from tn fp fn tp."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return df.select(*df.columns, r6(ratio(tp + tn, tp + tn + fp + fn), "accuracy"), r6(ratio(tp, tp + fp), "precision"), r6(ratio(tp, tp + fn), "recall"), r6(ratio(2 * tp, 2 * tp + fp + fn), "f1"), r6(ratio(fp, fp + tn), "fpr"), r6(mcc, "mcc"))


def threshold_scan(df: DataFrame) -> DataFrame:
    """Counts and rates at each grid threshold. A row counts once, under the number of thresholds that it reaches."""
    grid = F.array(*[F.lit(t) for t in GRID])
    reached = df.select("y", F.size(F.filter(grid, lambda t: F.col("p") >= t)).alias("b")).groupBy("b").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    steps = df.sparkSession.range(99).select((F.col("id") + 1).cast("int").alias("b"), F.element_at(grid, (F.col("id") + 1).cast("int")).alias("threshold"))
    total = reached.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    above = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)  # 99 rows
    run = steps.join(reached, "b", "left").na.fill(0, ["pos", "neg"]).select("b", "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"))
    counts = run.crossJoin(F.broadcast(total)).select("threshold", (F.col("all_neg") - F.col("fp")).alias("tn"), "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), "tp")  # one row
    return rates(counts)


def best_threshold(df: DataFrame) -> DataFrame:
    """Of the greatest F1, the lowest threshold."""
    return threshold_scan(df).orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)


#: Ranges of scores.
PARTS = 64


def score_parts(df: DataFrame) -> DataFrame:
    """df with ``part``, the range that its score p lies in, with about as many distinct scores as every other."""
    cuts = df.select("p").distinct().agg(F.percentile_approx("p", [i / PARTS for i in range(1, PARTS)])).first()[0] or []  # PARTS numbers
    return bucketed(df, "p", cuts, "part")


def bucketed(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """df with the number of cuts that are at or below a column's value, found by binary search; null gives -1, NaN the most."""
    edges = sorted({float(c) for c in cuts if c == c and abs(c) != float("inf")})
    if not edges:
        return df.withColumn(name, F.when(F.col(column).isNull(), -1).otherwise(0))
    value = f"{name}_value"
    made = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol=value, outputCol=name, handleInvalid="keep").transform(df.withColumn(value, F.col(column).cast("double")))
    return made.drop(value).withColumn(name, F.when(F.col(column).isNull(), -1).otherwise(F.coalesce(F.col(name), F.lit(len(edges) + 1.0)).cast("int")))


def by_score(df: DataFrame, parts: bool = False) -> DataFrame:
    """(p, pos, neg, tp, fp, all_pos, all_neg): counts of each distinct score, and running counts from the highest down.

    Distinct scores are dealt into ranges by their quantiles and each range's total carried to those after it, so that no task
    sorts all, wherever in [0, 1] the scores lie. With ``parts`` the range comes along.
    """
    counts = df.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    part = score_parts(counts)
    down = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))  # at most PARTS + 1 rows
    before = sums.select("part", F.coalesce(F.sum("pos").over(down), F.lit(0)).alias("tp0"), F.coalesce(F.sum("neg").over(down), F.lit(0)).alias("fp0"))
    total = sums.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    inner = Window.partitionBy("part").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = part.select("p", "part", F.sum("pos").over(inner).alias("tp"), F.sum("neg").over(inner).alias("fp"), "pos", "neg")
    out = run.join(F.broadcast(before), "part").crossJoin(F.broadcast(total))
    return out.select("p", "pos", "neg", (F.col("tp") + F.col("tp0")).alias("tp"), (F.col("fp") + F.col("fp0")).alias("fp"), "all_pos", "all_neg", *(["part"] if parts else []))


def roc_points(df: DataFrame) -> DataFrame:
    """threshold, fpr, tpr; points on a straight line between their neighbours are left out. The curve's start has no threshold."""
    s = by_score(df, parts=True)
    inner, down = Window.partitionBy("part").orderBy(F.col("p").desc()), Window.orderBy(F.col("part").desc())
    heads = s.groupBy("part").agg(F.max_by("pos", "p").alias("pos"), F.max_by("neg", "p").alias("neg"))  # at most PARTS + 1 rows
    after = heads.select("part", F.lead("pos").over(down).alias("after_pos"), F.lead("neg").over(down).alias("after_neg"))
    near = s.withColumn("next_pos", F.lead("pos").over(inner)).withColumn("next_neg", F.lead("neg").over(inner)).join(F.broadcast(after), "part")
    flat = near.withColumn("next_pos", F.coalesce("next_pos", "after_pos")).withColumn("next_neg", F.coalesce("next_neg", "after_neg"))
    corner = F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    points = flat.where(corner).select(F.col("p").alias("threshold"), F.round(ratio(F.col("fp"), F.col("all_neg")), 6).alias("fpr"), F.round(ratio(F.col("tp"), F.col("all_pos")), 6).alias("tpr"))
    return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).unionByName(points)


def areas(df: DataFrame) -> DataFrame:
    """ROC area (equal scores count half; null with one class) and average precision, from the same running counts."""
    s = by_score(df)
    auc = F.sum(F.col("pos") * ((F.col("all_neg") - F.col("fp")) + F.col("neg") / 2.0))
    ap = F.sum(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")) * F.col("pos"))
    return s.agg(F.round(F.try_divide(auc, F.max(F.col("all_pos") * F.col("all_neg")).cast("double")), 6).alias("roc_auc"), F.round(F.try_divide(ap, F.max("all_pos").cast("double")), 6).alias("average_precision"))


def per_class(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    c = confusion(df, threshold)
    one = c.select(F.lit(1).alias("label"), "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"))
    zero = c.select(F.lit(0).alias("label"), F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn"), (F.col("tn") + F.col("fp")).alias("support"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.unionByName(zero).select("label", "support", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def mcnemar(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """b, c and chi squared of two scores p and q on the same rows; 0 where they never disagree in being right."""
    a, b = (F.col("p") >= threshold) == (F.col("y") == 1), (F.col("q") >= threshold) == (F.col("y") == 1)
    n = df.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    return n.select("b", "c", F.round(ratio(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2), F.col("b") + F.col("c")), 6).alias("chi2"))


def mcnemar_test(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """mcnemar with the p-value of its chi squared of one degree of freedom; 1 where the scores never disagree."""
    return mcnemar(df, threshold).withColumn("p_value", F.round(dist.chi2_p(F.col("chi2"), F.lit(1.0)), 9))


def interval(df: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """Mean with its t-interval, in one row: without bounds for fewer than two values, without a mean for none."""
    g = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("sem"))
    q = dist.t_at(F.lit((1 + share) / 2), (F.col("n") - 1).cast("double"))
    g = g.withColumn("q", q)
    return g.select("n", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), F.round(F.col("mean") - F.col("q") * F.col("sem"), 6).alias("low"), F.round(F.col("mean") + F.col("q") * F.col("sem"), 6).alias("high"))


def signed_ranks(d: DataFrame) -> DataFrame:
    """Of differences d, in one row: w, the sum of the ranks of those above 0; k, how many aren't 0; tied, the sum of m^3 - m
    over sizes that m share; few, all ranks where there are at most 25, else null.

    Ranks come from counts of distinct sizes of differences, dealt into ranges so that no task sorts all of them.
    """
    size = F.round(F.abs("d"), 9)
    ties = d.where(size > 0).groupBy(size.alias("a")).agg(F.count("*").alias("m"), F.count_if(F.col("d") > 0).alias("up"))
    parts = ties.withColumn("part", F.floor(F.log2(1 + F.col("a")) * 1024))
    before = parts.groupBy("part").agg(F.sum("m").alias("m")).select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("base"))  # a row a range
    inner = F.sum("m").over(Window.partitionBy("part").orderBy("a")) - F.col("m")
    ranks = parts.withColumn("k", inner).join(before, "part").select("m", "up", (F.col("base") + F.col("k") + (F.col("m") + 1) / 2.0).alias("rank"), F.col("base") + F.col("k") < dist.EXACT_PAIRS)
    first = F.filter(F.collect_list(F.when(ranks[ranks.columns[3]], F.struct("rank", "m"))), lambda x: x.isNotNull())  # at most 25 sizes
    few = F.flatten(F.transform(first, lambda x: F.array_repeat(x["rank"], F.least(x["m"], F.lit(dist.EXACT_PAIRS + 1)).cast("int"))))
    g = ranks.agg(F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("w"), F.coalesce(F.sum("m"), F.lit(0)).cast("double").alias("k"), F.coalesce(F.sum(F.col("m").cast("double") * F.col("m") * F.col("m") - F.col("m")), F.lit(0.0)).alias("tied"), few.alias("few"))
    return g.withColumn("few", F.when(F.col("k") <= dist.EXACT_PAIRS, F.col("few")))


def paired_tests(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference of a and b, Student's t and Wilcoxon's normal value of the signed ranks, with their two-sided p-values.

    One row always. Up to 25 pairs that differ, Wilcoxon's p-value is exact, of all ways to sign the ranks at hand; above, that
    of the normal value. t and its p-value are null for fewer than two pairs; without spread t is null and the p-value 1 if
    the columns are equal, else 0; z is null and its p-value 1 if no pair differs. Pairs with a null don't count.
    """
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d is not null")
    k = F.col("k")
    z = F.try_divide(F.col("w") - k * (k + 1) / 4.0, F.sqrt(k * (k + 1) * (2 * k + 1) / 24.0 - F.col("tied") / 48.0))
    spread = F.stddev_samp("d")
    g = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), spread.alias("s"), F.try_divide(F.avg("d"), spread / F.sqrt(F.count("*"))).alias("t"))
    out = g.crossJoin(F.broadcast(signed_ranks(d).withColumn("z", z)))  # one row each
    flat = (F.col("n") > 1) & (F.col("s") == 0)
    p = F.when(flat, (F.col("mean") == 0).cast("double")).otherwise(F.col("tp"))
    out = out.withColumns({"tp": dist.t_p(F.coalesce("t", F.lit(float("nan"))), (F.col("n") - 1).cast("double")), "np": dist.normal_p(F.coalesce("z", F.lit(0.0))), "sp": dist.signed_rank_p("w", "few")})
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"), F.round(p, 9).alias("t_p"), F.round("z", 4).alias("z"), F.when(F.col("n") > 0, F.round(F.coalesce("sp", "np"), 9)).alias("wilcoxon_p"))


def gate(df: DataFrame, latency: str, target: float, threshold: float = 0.5) -> DataFrame:
    """A detector's report in one row: accuracy, F1, average and 95th percentile of latency, and whether that is under target."""
    p = quantiles(df, latency, [0.95]).select(F.round(F.col("p")[0], 6).alias("p95"))
    row = rates(confusion(df, threshold)).select("accuracy", "f1").crossJoin(F.broadcast(df.agg(F.round(F.avg(latency), 6).alias("avg_latency"))))
    return row.join(F.broadcast(p), F.lit(True), "left").withColumn("meets_target", (F.col("p95") < target).cast("int"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two ratings; kappa is 1 where chance agreement is certain."""
    cell = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cell.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cell.groupBy("a").agg(F.sum("n").alias("x")), cell.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "a").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("s"))
    out = total.crossJoin(F.broadcast(chance)).select("t", (F.col("same") / F.col("t")).alias("po"), (F.coalesce("s", F.lit(0.0)) / (F.col("t").cast("double") * F.col("t"))).alias("pe"))
    return out.select(F.col("t").alias("pairs"), F.round("po", 6).alias("agreement"), F.round(F.coalesce(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), F.lit(1.0)), 6).alias("kappa"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(f1, f2, corr) for all pairs from one aggregate; null with a constant column."""
    x = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = df.agg(*[F.covar_pop(x[a], x[b]).alias(f"{a}|{b}") for a, b in pairs])
    at = lambda a, b: F.col(f"`{a}|{b}`")
    cells = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.round(F.try_divide(at(a, b), F.sqrt(at(a, a)) * F.sqrt(at(b, b))), 6).alias("corr")) for a, b in pairs]
    return sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


#: Of percentile_approx: its ranks are right to a share of 1 / ACCURACY of a group's rows.
ACCURACY = 10_000


def quantiles(df: DataFrame, value: str, shares: list[float], *keys: str) -> DataFrame:
    """(*keys, p): the exact interpolated quantiles of each group as an array, null for a group without values.

    One pass brackets each wanted rank by approximate quantiles on both sides of it; a second counts what lies below a
    bracket and the values within, and only these, some 4 / ACCURACY of a group however its values lie, are put in order. The
    greatest value below and the least above come along, for ranks at a bracket's edge. Groups are compared as structs, so null
    keys are groups too; NaN is the largest value.
    """
    rows = df.select(F.struct(F.lit(0).alias("_"), *keys).alias("g"), F.col(value).cast("double").alias("v"))
    ends = [min(max(q + d, 0.0), 1.0) for q in shares for d in (-2 / ACCURACY, 2 / ACCURACY)]
    near = rows.groupBy("g").agg(F.count("v").alias("total"), F.percentile_approx("v", ends, ACCURACY).alias("e"))
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.col("e")[2 * i].alias("lo"), F.col("e")[2 * i + 1].alias("hi")) for i in range(len(shares))])
    known = near.select("g", spots.alias("s"))
    each = rows.where("v is not null").join(known if keys else F.broadcast(known), "g").select("g", "v", F.explode("s").alias("s"))  # one row without keys
    zone = F.when(F.col("v") < F.col("s.lo"), -1).when(F.col("v") > F.col("s.hi"), 1).otherwise(0)
    zones = each.select("g", F.col("s.i").alias("i"), zone.alias("zone"), "v").groupBy("g", "i", "zone", F.when(F.col("zone") == 0, F.col("v")).alias("x"))
    counts = zones.agg(F.count("*").alias("n"), F.max("v").alias("most"), F.min("v").alias("least"))
    run = counts.withColumn("run", F.sum("n").over(Window.partitionBy("g", "i").orderBy("zone", "x")))
    spot = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1) * (F.col("total") - 1)
    here = run.join(near.select("g", "total"), "g").withColumn("spot", spot)
    first, last = F.col("run") - F.col("n"), F.col("run") - 1
    at = lambda r: F.when((F.col("zone") == 0) & r.between(first, last), F.col("x")).when((F.col("zone") == -1) & (r == last), F.col("most")).when((F.col("zone") == 1) & (r == first), F.col("least"))
    two = here.groupBy("g", "i").agg(F.max(at(F.floor("spot"))).alias("a"), F.max(at(F.ceil("spot"))).alias("b"), F.first("spot").alias("spot"))
    sure = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error("a rank lies outside its bracket").cast("double"))
    mid = F.when(F.floor("spot") == F.ceil("spot"), F.col("a")).otherwise((F.ceil("spot") - F.col("spot")) * F.col("a") + (F.col("spot") - F.floor("spot")) * F.col("b"))
    found = two.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce(sure, mid).alias("q")))), lambda x: x["q"]).alias("p"))
    return near.select("g").join(found, "g", "left").select(*[F.col(f"g.{k}") for k in keys], "p")


def percentiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    group = F.struct(F.lit(0).alias("_"), *keys).alias("g")
    p = quantiles(df, value, [0.5, 0.95, 0.99], *keys).select(group, "p")
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("avg"), F.round(F.max(value), 6).alias("max")).select("*", group).join(p, "g")
    return out.select(*keys, "n", "avg", *[F.round(F.col("p")[i], 6).alias(f"p{k}") for i, k in enumerate((50, 95, 99))], "max")
