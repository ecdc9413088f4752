"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document d of source s gets a rate r_d, the number of times the mix takes it. Among all
rates in [0, cap] that meet the token constraint  sum(size_d * r_d) = target_s  of each source,
those with the least relative entropy to taking each document once are
r_d = min(cap, exp(lambda_s * size_d / scale_s)), with scale_s the mean size. The convex dual has
one multiplier for each source; guarded Newton steps solve it. A step is a distributed aggregate
over (source, size) counts, which are summed before anything is shuffled by source.

Rates become whole copies: floor(rate), and one more for the documents whose key u / fraction is
below a cut of their source (u is a hash of the id). The cut is found by histograms that are
refined twice, so no source is ever collected or sorted as a whole. A last correction of one copy
brings the words taken closest to the target. All decisions lie in one row for each source (the
"dials"), so that applying them to documents needs no shuffle of documents.

Defined results: null text has size 0; a null source is a source of its own, the last one;
documents of size 0 take no words; rows that repeat an id with equal size and source are treated
alike; an empty table gives an empty mix; a null id hashes to a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, n_words, packed, stage, unpacked

#: A multiplier that takes each document cap times, or not at all.
SATURATED = 1e6


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sid, source, source_size, n_docs, target for each source of sizes(source, size).

    Sources in code point order, null last, take the weights in turn. Targets share
    share * all sizes by weight; what lies above cap * source_size is shared again by weight.
    The fixed point is target = min(cap * source_size, theta * weight), found with sums over the
    sources sorted by the theta at which they fill up. Reads one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = per.withColumn("sid", F.row_number().over(order))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full_at", F.col("source_size") * cap / F.col("weight"))
    by_full = Window.orderBy("full_at", "sid")
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumn("theta_here", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum("weight").over(onward))
    ranked = ranked.withColumn("theta", F.min_by(F.when(F.col("theta_here") <= F.col("full_at"), F.col("theta_here")), F.when(F.col("theta_here") <= F.col("full_at"), F.col("full_at"))).over(everything))
    full = F.col("source_size") * F.lit(float(cap))
    target = F.when(F.col("theta").isNull(), full).otherwise(F.least(full, F.col("theta") * F.col("weight")))
    return ranked.select("sid", "source", "source_size", "n_docs", target.alias("target"))


def _rate(size: Column, scale: Column, lam: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * size / scale, F.lit(50.0))))


def solve_dual(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-7, iterations: int = 60) -> DataFrame:
    """targets with scale and lam: Newton steps on the dual until each source meets its target."""
    spark = sizes.sparkSession
    counts = stage(
        sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).alias("c")
        .join(targets.select("sid", F.col("source").alias("s")), F.col("c.source").eqNullSafe(F.col("s")))
        .select("sid", "size", "n"), "mix-counts")
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    state = stage(targets.select(
        "*", (F.greatest(F.col("source_size"), F.lit(1)) / F.col("n_docs")).alias("scale"),
        F.when(full, SATURATED).when(F.col("target") <= 0, -SATURATED).otherwise(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        (full | (F.col("target") <= 0)).alias("met")), "mix-dual")
    for _ in range(iterations):
        if state.where("not met").isEmpty():
            break
        rate = _rate(F.col("size"), F.col("scale"), F.col("lam"), cap)
        sums = (
            counts.join(state.where("not met").select("sid", "scale", "lam"), "sid")
            .select("sid", (F.col("n") * F.col("size") * rate).alias("f"), F.when(rate < cap, F.col("n") * F.col("size") * F.col("size") / F.col("scale") * rate).otherwise(0.0).alias("h"))
            .groupBy("sid").agg(F.sum("f").alias("f"), F.sum("h").alias("h")))
        now = state.join(sums, "sid", "left")
        under = F.col("f") < F.col("target")
        now = now.withColumns({
            "lo": F.when(F.col("met") | ~under, F.col("lo")).otherwise(F.col("lam")),
            "hi": F.when(F.col("met") | under, F.col("hi")).otherwise(F.col("lam")),
            "hit": F.col("met") | (F.abs(F.col("f") - F.col("target")) <= F.col("target") * tolerance)})
        newton = F.when(F.col("h") > 0, F.col("lam") + (F.col("target") - F.col("f")) / F.col("h"))
        safe = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi"))) & (F.abs(newton - F.col("lam")) <= 4 * F.greatest(F.abs(F.col("lam")), F.lit(1.0)))
        other = (F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2)
                 .when(F.col("lo").isNotNull(), F.greatest(F.col("lam") * 2, F.col("lam") + 1)).otherwise(F.least(F.col("lam") * 2, F.col("lam") - 1)))
        step = F.when(F.col("hit"), F.col("lam")).when(safe, newton).otherwise(other)
        later = stage(now.withColumn("lam", step).withColumn("met", F.col("hit")).drop("f", "h", "hit"), "mix-dual")
        forget(spark, state)
        state = later
    else:
        if not state.where("not met").isEmpty():
            raise ArithmeticError(f"a source misses its target after {iterations} Newton steps")
    forget(spark, counts)
    # A rounded multiplier: sums taken in another order on a rerun give the same rates.
    return state.select("sid", "source", "source_size", "n_docs", "target", "scale", F.round("lam", 9).alias("lam"))


def _keyed(df: DataFrame, cap: float) -> DataFrame:
    """size, id and the dials' scale and lam give whole copies, hash u and the key of one more copy."""
    rate = F.round(F.when(F.col("lam") >= SATURATED, F.lit(float(cap))).when(F.col("lam") <= -SATURATED, 0.0).otherwise(_rate(F.col("size"), F.col("scale"), F.col("lam"), cap)), 9)
    unit = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit("mix")), 11) * F.lit(2.0 ** -53)
    df = df.withColumn("rate", rate).withColumn("u", unit).withColumn("whole", F.floor("rate"))
    part = F.col("rate") - F.col("whole")
    return df.withColumn("key", F.when((part > 1e-9) & (F.col("size") > 0), F.col("u") / part))


def _cuts(keyed: DataFrame, dials: DataFrame) -> DataFrame:
    """sid and kcut: documents of the source with key < kcut are taken once more."""
    fine, wide, most = 256, 64, 256
    open_rows = keyed.where("key is not null").withColumns({"bin": F.least(F.floor(F.col("key") * wide), F.lit(most)).cast("int")})
    open_rows = open_rows.withColumn("sub", F.when(F.col("bin") < most, F.floor((F.col("key") * wide - F.col("bin")) * fine)).otherwise(F.least(F.floor(F.log2(F.col("key"))), F.lit(4000))).cast("int"))
    due = keyed.groupBy("sid").agg(F.sum(F.col("whole") * F.col("size")).alias("whole_words")).join(dials.select("sid", "target"), "sid").select("sid", (F.col("target") - F.col("whole_words")).alias("due"))

    def crossing(rows: DataFrame, col: str, due: DataFrame) -> DataFrame:
        summed = rows.groupBy("sid", col).agg(F.sum("size").alias("t")).join(due, "sid")
        w = Window.partitionBy("sid").orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = summed.withColumn("upto", F.sum("t").over(w))
        return summed.where("upto >= due").groupBy("sid").agg(F.min_by("due", col).alias("due0"), F.min(col).alias(f"x_{col}"), (F.min_by("due", col) - F.min_by(F.col("upto") - F.col("t"), col)).alias("due")).drop("due0")

    due = stage(due, "mix-due")
    first = stage(crossing(open_rows, "bin", due), "mix-bins")
    in_bin = open_rows.join(first, "sid").where("bin = x_bin")
    second = stage(crossing(in_bin.select("sid", "size", "sub"), "sub", first.select("sid", "due")).join(first.select("sid", "x_bin"), "sid"), "mix-bins")
    last = open_rows.join(second, "sid").where("bin = x_bin and sub = x_sub")
    w = Window.partitionBy("sid").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.sum("size").over(w) - F.col("size") / 2 <= F.col("due")
    last = last.withColumn("taken", taken).groupBy("sid").agg(F.min(F.when(~F.col("taken"), F.col("key"))).alias("first_left"), F.max("key").alias("last_key"))
    last = last.select("sid", F.coalesce("first_left", F.col("last_key") * (1 + 1e-12)).alias("cut"))
    # Where all keys together stay below what is due, all are taken; where nothing is due, none is.
    return due.join(last, "sid", "left").select("sid", F.when(F.col("due") <= 0, 0.0).otherwise(F.coalesce("cut", F.lit(float("inf")))).alias("kcut"))


def solve(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The dials of docs(id, source, size), one row for each source."""
    targets = stage(source_targets(docs, weights, share, cap), "mix-targets")
    dials = stage(solve_dual(docs, targets, cap), "mix-dials")
    rows = docs.alias("d").join(dials.select("sid", F.col("source").alias("s"), "scale", "lam"), F.col("d.source").eqNullSafe(F.col("s"))).select("id", "size", "sid", "scale", "lam")
    keyed = stage(_keyed(rows, cap).select("sid", "id", "size", "whole", "u", "key"), "mix-keys")
    dials = dials.join(_cuts(keyed, dials), "sid", "left")
    dials = stage(dials, "mix-dials")
    copies = F.col("whole") + F.when(F.col("key") < F.col("kcut"), 1).otherwise(0)
    rows = keyed.join(dials.select("sid", "target", "kcut"), "sid").withColumn("copies", copies)
    gap = stage(rows.groupBy("sid", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).select("sid", (F.col("target") - F.col("words")).alias("gap")), "mix-gaps")
    fit = rows.join(gap, "sid").where("size > 0 and (gap > 0 and copies + 1 <= " + str(cap) + " or gap < 0 and copies >= 1)")
    fit = fit.withColumn("err", F.abs(F.abs(F.col("gap")) - F.col("size"))).where("err < abs(gap)")
    fit = fit.groupBy("sid").agg(F.min_by("u", F.col("err") + F.col("u") * 1e-3).alias("fix_u"), F.min_by("size", F.col("err") + F.col("u") * 1e-3).alias("fix_size"), F.min_by(F.signum("gap"), F.col("err") + F.col("u") * 1e-3).cast("int").alias("fix"))
    return stage(dials.join(fit, "sid", "left"), "mix-dials")


def apply(docs: DataFrame, dials: DataFrame, cap: float = 2.0) -> DataFrame:
    """docs(id, source, size, ...) with source_size, target, rate and copies."""
    names = docs.columns
    d = dials.select(F.col("source").alias("_source"), "source_size", "target", "scale", "lam", "kcut", "fix_u", "fix_size", "fix")
    rows = _keyed(docs.join(d, F.col("source").eqNullSafe(F.col("_source"))), cap)
    fixed = F.when((F.col("u") == F.col("fix_u")) & (F.col("size") == F.col("fix_size")), F.col("fix")).otherwise(0)
    extra = F.when(F.col("key") < F.col("kcut"), 1).otherwise(0)
    return rows.withColumn("copies", (F.col("whole") + extra + fixed).cast("long")).select(*names, "source_size", "target", "rate", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """id, source, size, source_size, target, rate, copies for each row of docs."""
    sizes = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "mix-sizes")
    return apply(sizes, solve(sizes, weights, share, cap), cap)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return mix(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the columns of docs, under any name.

    Defined results: documents of size 0 stay once, as they take no words; a null source is a source
    of its own; an empty table gives none."""
    sizes = stage(docs.select(F.col("doc_id").alias("id"), "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    dials = solve(sizes)
    out = apply(packed(docs, id=F.col("doc_id"), source=F.col("source"), size=n_words(F.col("text"))), dials)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    return unpacked(out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))), docs.columns)
