"""Aggregate metrics over vehicle logs and run tables (A*).

All of these are algebraic (sum / count / min / max / avg / max_by) so Spark's
partial aggregation combines map-side: a run or vehicle holding a third of all rows
reaches the reducer as one partial row per map task, not as its raw rows.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as ph
from ..functions.numeric import rnd


def mpg_from_sums(speed_sum: Column, fuel_sum: Column, dt: float = ph.DT) -> Column:
    """A2: miles / gallons from summed speeds and fuel rates; NULL when gallons <= 0."""
    miles = speed_sum / ph.METERS_PER_MILE * dt
    gallons = fuel_sum / 3600.0 * dt
    return F.when(gallons > 0, F.try_divide(miles, gallons))


def is_av_substring(id_col="id") -> Column:
    """The `'av' in id` predicate (substring)."""
    return F.col(id_col).contains("av")


def is_av_token(id_col="id") -> Column:
    """The `'av' in id.split('_')` predicate (token)."""
    return F.array_contains(F.split(F.col(id_col), "_"), "av")


def mpg_metrics(df: DataFrame, group: list[str], speed="speed", fuel="fuel", id_col="id", dt=ph.DT) -> DataFrame:
    """A2: system and AV MPG per group."""
    av = is_av_substring(id_col)
    return df.groupBy(*group).agg(
        rnd(mpg_from_sums(F.sum(speed), F.sum(fuel), dt), 6).alias("system_mpg"),
        rnd(mpg_from_sums(F.sum(F.when(av, F.col(speed))), F.sum(F.when(av, F.col(fuel))), dt), 6).alias("av_mpg"),
    )


def is_token(id_col: str, token: str) -> Column:
    return F.array_contains(F.split(F.col(id_col), "_"), token)


def trajectory_summary(df: DataFrame, keys, seq="seq", time="time") -> DataFrame:
    """A1: timestep = round(t1 - t0, 3), duration = round(max - min, 3), size."""
    return df.groupBy(*keys).agg(
        rnd(F.max(F.when(F.col(seq) == 1, F.col(time))) - F.max(F.when(F.col(seq) == 0, F.col(time))), 3).alias("timestep"),
        rnd(F.max(time) - F.min(time), 3).alias("duration"),
        F.count(F.lit(1)).alias("size"),
    )


def vehicle_mpg_eps(speed_sum: Column, fuel_sum: Column) -> Column:
    """A3: (sum v / 1609.34) / (sum fuel / 3600 + 1e-6) - no step factor, epsilon inside."""
    return (speed_sum / ph.METERS_PER_MILE) / (fuel_sum / 3600.0 + 1e-6)


def mean_vehicle_mpg_eps(df: DataFrame, keys, id_col="id") -> DataFrame:
    """A3: per-vehicle MPG with epsilon, averaged over non-leader vehicles."""
    v = df.groupBy(*keys, id_col).agg(vehicle_mpg_eps(F.sum("speed"), F.sum("fuel")).alias("mpg"))
    v = v.filter(~F.col(id_col).contains("trajectory"))
    return v.groupBy(*keys).agg(rnd(F.avg("mpg"), 6).alias("mean_mpg"))


def system_totals(c: DataFrame, keys, id_col="id", dt=ph.DT) -> DataFrame:
    """A4 + A5: per vehicle max-min of cumulative gallons / miles and seconds = rows * dt,
    summed over vehicles (all, and AVs by substring); sample std of speed."""
    av = mt_av = F.col(id_col).contains("av")  # noqa: F841
    v = c.groupBy(*keys, id_col).agg(
        (F.max("total_gallons") - F.min("total_gallons")).alias("g"),
        (F.max("total_miles") - F.min("total_miles")).alias("m"),
        (F.count(F.lit(1)) * dt).alias("s"),
    )
    t = v.groupBy(*keys).agg(
        F.sum("g").alias("tg"), F.sum("m").alias("tm"), F.sum("s").alias("ts"),
        F.sum(F.when(mt_av, F.col("g"))).alias("ag"), F.sum(F.when(mt_av, F.col("m"))).alias("am"),
        F.sum(F.when(mt_av, F.col("s"))).alias("a_s"),
    )
    sd = c.groupBy(*keys).agg(
        F.stddev_samp("speed").alias("speed_std"), F.stddev_samp(F.when(av, F.col("speed"))).alias("av_speed_std")
    )
    x = t.join(sd, on=keys, how="inner")
    return x.select(
        *keys,
        rnd(F.try_divide(F.col("tm"), F.col("tg")), 6).alias("system_mpg"),
        rnd("tg", 9).alias("total_gallons"), rnd("tm", 9).alias("total_miles"),
        rnd(F.try_divide(F.col("tm"), F.col("ts")) * 3600, 6).alias("system_speed"),
        rnd("speed_std", 6).alias("speed_std"),
        rnd(F.try_divide(F.col("am"), F.col("ag")), 6).alias("av_mpg"),
        rnd(F.try_divide(F.col("am"), F.col("a_s")) * 3600, 6).alias("av_speed"),
        rnd("av_speed_std", 6).alias("av_speed_std"),
    )


def _lines_df(spark, lines):
    from ..plans.broadcast import maybe_broadcast

    return maybe_broadcast(spark.createDataFrame([(float(x),) for x in lines], "line double"), len(lines))


def _per_id_cross_times(df, keys, id_col, pos, t, lines_df):
    """Per (keys, line, id): first time beyond the line and last time before it (all time)."""
    x = df.select(*keys, id_col, pos, t).crossJoin(lines_df)
    return x.groupBy(*keys, "line", id_col).agg(
        F.min(F.when(F.col(pos) > F.col("line"), F.col(t))).alias("first_after"),
        F.max(F.when(F.col(pos) < F.col("line"), F.col(t))).alias("last_before"),
    )


def throughput_total(df: DataFrame, keys, id_col, pos, t, lines) -> DataFrame:
    """n_crossing / (last time before - first time after) * 3600 per line; 0/NULL span -> NULL."""
    per = _per_id_cross_times(df, keys, id_col, pos, t, _lines_df(df.sparkSession, lines))
    per = per.filter(F.col("first_after").isNotNull() & F.col("last_before").isNotNull())
    agg = per.groupBy(*keys, "line").agg(
        F.count(F.lit(1)).alias("n_crossing"), (F.max("last_before") - F.min("first_after")).alias("_span")
    )
    return agg.select(*keys, "line", "n_crossing",
                      rnd(F.when(F.col("_span") != 0, F.col("n_crossing") / F.col("_span") * 3600), 6).alias("throughput"))


def throughput_series(df: DataFrame, keys, id_col, pos, t, lines, period=60.0, half_width=180.0) -> DataFrame:
    """Every ``period`` s, ids crossing inside [mid - hw, mid + hw] (inclusive); their
    first/last times over *all* time; no crossing -> 0.

    Each row fans out only to the few midpoints whose window holds it (candidate range
    widened by one, then the exact inclusive test), instead of a theta join.
    """
    spark = df.sparkSession
    lines_df = _lines_df(spark, lines)
    ends = df.groupBy(*keys).agg(F.floor(F.max(t) / period).cast("long").alias("_n"))
    grid = ends.filter(F.col("_n") > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k"))
    grid = grid.select(*keys, (F.col("_k") * period).alias("t_mid")).crossJoin(lines_df)
    x = df.select(*keys, id_col, pos, t).join(ends, on=keys, how="inner")
    lo = F.ceil((F.col(t) - half_width) / period).cast("long") - 1
    hi = F.floor((F.col(t) + half_width) / period).cast("long") + 1
    x = x.withColumn("_k", F.explode(F.sequence(F.greatest(lo, F.lit(0).cast("long")), F.least(hi, F.col("_n") - 1))))
    x = x.withColumn("t_mid", F.col("_k") * period)
    x = x.filter((F.col(t) >= F.col("t_mid") - half_width) & (F.col(t) <= F.col("t_mid") + half_width))
    x = x.crossJoin(lines_df)
    win = x.groupBy(*keys, "line", "t_mid", id_col).agg(F.min(pos).alias("_mn"), F.max(pos).alias("_mx"))
    win = win.filter((F.col("_mn") < F.col("line")) & (F.col("_mx") > F.col("line")))
    per = _per_id_cross_times(df, keys, id_col, pos, t, lines_df)
    agg = win.join(per, on=[*keys, "line", id_col], how="inner").groupBy(*keys, "line", "t_mid").agg(
        F.count(F.lit(1)).alias("_cnt"), (F.max("last_before") - F.min("first_after")).alias("_span")
    )
    out = grid.join(agg, on=[*keys, "line", "t_mid"], how="left")
    tput = F.when(F.col("_cnt").isNull(), F.lit(0.0)).when(F.col("_span") != 0, F.col("_cnt") / F.col("_span") * 3600)
    return out.select(*keys, "line", "t_mid", F.coalesce(F.col("_cnt"), F.lit(0)).cast("long").alias("n_crossing"),
                      rnd(tput, 6).alias("throughput"))


def mpg_by_leader_bucket(f: DataFrame, keys, min_steps=1000, step="step") -> DataFrame:
    """Leader speed buckets (0,10], (10,20], (20,30], (30,40]; per vehicle (AV or
    human, token test) MPG with epsilon over the bucket's steps, averaged; a bucket with
    no more than ``min_steps`` steps reports 0."""
    lead = f.filter(is_token("id", "leader") & (F.col("speed") > 0) & (F.col("speed") <= 40))
    lead = lead.select(*keys, step, (F.ceil(F.col("speed") / 10).cast("int") * 10).alias("bucket_max"))
    cnt = lead.groupBy(*keys, "bucket_max").agg(F.count(F.lit(1)).alias("n_steps"))
    veh = f.filter(is_token("id", "av") | is_token("id", "human")).join(lead, on=[*keys, step], how="inner")
    veh = veh.groupBy(*keys, "bucket_max", "id").agg(vehicle_mpg_eps(F.sum("speed"), F.sum("fuel")).alias("mpg"))
    m = veh.groupBy(*keys, "bucket_max").agg(F.avg("mpg").alias("_m"))
    out = cnt.join(m, on=[*keys, "bucket_max"], how="left")
    return out.select(*keys, "bucket_max", "n_steps",
                      rnd(F.when(F.col("n_steps") > min_steps, F.col("_m")).otherwise(F.lit(0.0)), 6).alias("mean_mpg"))


def trajectory_ranges(c: DataFrame, keys, step="step") -> DataFrame:
    """A10: leader length / duration / speed range, AV headway and accel ranges, and the
    mean final avg_mpg of AVs, humans and both (token tests on the id)."""
    is_leader, is_av, is_human = is_token("id", "leader"), is_token("id", "av"), is_token("id", "human")
    last = c.groupBy(*keys, "id").agg(F.max_by("avg_mpg", step).alias("final_mpg"))
    last = last.withColumns({"_av": is_av, "_hu": is_human})
    m = last.groupBy(*keys).agg(
        F.avg(F.when(F.col("_av"), F.col("final_mpg"))).alias("mpg_avs"),
        F.avg(F.when(F.col("_hu"), F.col("final_mpg"))).alias("mpg_humans"),
        F.avg(F.when(F.col("_av") | F.col("_hu"), F.col("final_mpg"))).alias("mpg_avs_humans"),
    )
    r = c.groupBy(*keys).agg(
        F.max_by(F.when(is_leader, F.col("total_distance")), F.when(is_leader, F.col(step))).alias("traj_length"),
        F.max(F.when(is_leader, F.col("t"))).alias("traj_duration"),
        F.min(F.when(is_leader, F.col("speed"))).alias("leader_speed_min"),
        F.max(F.when(is_leader, F.col("speed"))).alias("leader_speed_max"),
        F.min(F.when(is_av, F.col("headway"))).alias("av_headway_min"),
        F.max(F.when(is_av, F.col("headway"))).alias("av_headway_max"),
        F.min(F.when(is_av, F.col("accel"))).alias("av_accel_min"),
        F.max(F.when(is_av, F.col("accel"))).alias("av_accel_max"),
    )
    x = r.join(m, on=keys, how="inner")
    six = ["traj_length", "traj_duration", "av_headway_min", "av_headway_max", "av_accel_min", "av_accel_max",
           "mpg_avs", "mpg_humans", "mpg_avs_humans"]
    return x.select(*keys, *[rnd(c_, 6).alias(c_) for c_ in six], "leader_speed_min", "leader_speed_max")


def platoon_mpg(c: DataFrame, keys, step="step") -> DataFrame:
    """A11 + W20 + W21: last row per vehicle; platoon = 1 + number of AVs with id_num <=
    this one (ids >= 100 have none); sum miles / gallons of the AV/sensor vehicles and
    the vehicle right in front of each; mpg; gain vs the platoon ahead and vs platoon 1."""
    last = c.groupBy(*keys, "id_num", "id").agg(
        F.max_by("total_miles", step).alias("miles"), F.max_by("total_gallons", step).alias("gallons")
    )
    circ = F.col("id").contains("av") | F.col("id").contains("sensor")
    fronts = last.filter(circ).select(*keys, (F.col("id_num") - 1).alias("id_num")).distinct().withColumn("_front", F.lit(True))
    x = last.join(fronts, on=[*keys, "id_num"], how="left")
    w = Window.partitionBy(*keys).orderBy("id_num").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("platoon_id", 1 + F.sum(F.when(F.col("id").contains("av"), 1).otherwise(0)).over(w))
    x = x.filter((F.col("id_num") < 100) & (circ | F.col("_front").isNotNull()))
    p = x.groupBy(*keys, "platoon_id").agg(F.sum("miles").alias("m"), F.sum("gallons").alias("g"))
    p = p.withColumn("mpg", F.try_divide(F.col("m"), F.col("g")))
    wp = Window.partitionBy(*keys).orderBy("platoon_id")
    return p.select(
        *keys, F.col("platoon_id").cast("long").alias("platoon_id"), rnd("mpg", 6).alias("mpg"),
        rnd(100 * (1 - F.try_divide(F.lag("mpg").over(wp), F.col("mpg"))), 6).alias("improvement_rel"),
        rnd(100 * (1 - F.try_divide(F.first("mpg").over(wp), F.col("mpg"))), 6).alias("improvement_abs"),
    )


def stat_summary(df: DataFrame, keys, cols, std="pop") -> DataFrame:
    """Mean, std (population or sample), min, max per column."""
    sfn = F.stddev_pop if std == "pop" else F.stddev_samp
    aggs = []
    for c_ in cols:
        aggs += [rnd(F.avg(c_), 6).alias(f"{c_}_mean"), rnd(sfn(c_), 6).alias(f"{c_}_std"),
                 F.min(c_).alias(f"{c_}_min"), F.max(c_).alias(f"{c_}_max")]
    return df.groupBy(*keys).agg(*aggs)


#: rows of a block of a group, and of a lot of blocks (about)
CALLBACK_ROWS = 1 << 16


def stat_callbacks(df: DataFrame, keys, cols, callbacks: dict) -> DataFrame:
    """User statistics by name, ``{col}_{name}`` per group, as Python functions in Arrow batches.

    A callback is a pair (partial, final): ``partial(Series) -> list of floats`` on a block of a group's values,
    ``final(2-d array) -> float`` on the partials of the group's blocks, a row each. A group of more than CALLBACK_ROWS rows (counted
    first) is cut into blocks of about that many by the hash of its rows, so that no task or call holds a hot group. A worker
    takes blocks by lots of about CALLBACK_ROWS rows, for a batch of its own costs more than a short block's work. Nulls
    are left out before; a group without values gives null, and so does a final of NaN."""
    from ..session import cut_lineage

    named = [(c, name, fns) for c in cols for name, fns in callbacks.items()]
    sizes = cut_lineage(df.groupBy(*[F.col(c).alias(f"_h_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("_n")))
    lots = max(1, -(-(sizes.agg(F.sum("_n")).first()[0] or 0) // CALLBACK_ROWS))
    hot = F.broadcast(sizes.filter(F.col("_n") > CALLBACK_ROWS))  # of n rows, less than n / CALLBACK_ROWS groups
    block = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce(F.ceil(F.col("_n") / CALLBACK_ROWS), F.lit(1)))
    cut = df.join(hot, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in keys], "left").select(
        *keys, block.alias("_block"), *[F.col(c).cast("double").alias(f"_v_{c}") for c in cols])
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"`{c}_{name}` array<double>" for c, name, _ in named])

    def partials(rows):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        code = np.zeros(rows.num_rows, int)
        for c in [*keys, "_block"]:
            at = rows[c].combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * (len(at.dictionary) + 1) + at.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(order))
        out = {c: rows[c].take(pa.array(order[edges[:-1]])) for c in keys}
        for c in cols:
            values = pd.Series(rows[f"_v_{c}"].to_numpy()[order])
            blocks = [values.iloc[lo:hi].dropna() for lo, hi in zip(edges, edges[1:])]
            for name, (partial, _) in callbacks.items():
                out[f"{c}_{name}"] = pa.array([[float(x) for x in partial(v)] if len(v) else None for v in blocks], pa.list_(pa.float64()))
        return pa.table(out)

    def final_of(fn):
        @F.pandas_udf("double")
        def run(partials: pd.Series) -> pd.Series:
            import numpy as np

            return partials.map(lambda rows: float(fn(np.stack(rows))) if len(rows) else float("nan")).astype(float)

        return run

    parts = cut.withColumn("_lot", F.pmod(F.xxhash64(*keys, "_block"), F.lit(lots))).groupBy("_lot").applyInArrow(partials, schema)
    out = parts.groupBy(*keys).agg(*[F.collect_list(f"{c}_{name}").alias(f"{c}_{name}") for c, name, _ in named])  # a partial a block
    out = out.select(*keys, *[final_of(f)(f"{c}_{name}").alias(f"{c}_{name}") for c, name, (_, f) in named])
    return out.withColumns({f"{c}_{name}": F.when(~F.isnan(f"{c}_{name}"), F.col(f"{c}_{name}")) for c, name, _ in named})


def moment_callbacks() -> dict:
    """Mean, population deviation, least and greatest value as callbacks (the deviation by pairwise merging of moments)."""
    def moments(values):
        mean = values.mean()
        return len(values), mean, ((values - mean) ** 2).sum()

    def deviation(parts):
        n, mean, square = parts.T
        return ((square.sum() + (n * (mean - (n * mean).sum() / n.sum()) ** 2).sum()) / n.sum()) ** 0.5

    return {"mean": (moments, lambda p: (p[:, 0] * p[:, 1]).sum() / p[:, 0].sum()), "std": (moments, deviation),
            "min": (lambda v: [v.min()], lambda p: p.min()), "max": (lambda v: [v.max()], lambda p: p.max())}


def select_policies(pr: DataFrame, max_headway=350.0, min_headway=0.5, max_crash=None, n=3) -> DataFrame:
    """A16 + T2: mean per policy; keep headway max < a, min > b and crash-free (or crash
    mean < ``max_crash``); top n by system_mpg; mean / sample std (NULL -> 0) / min / max
    of their runs."""
    from ..plans.broadcast import maybe_broadcast

    m = pr.groupBy("cp_path").agg(F.avg("headway_max").alias("hm"), F.avg("headway_min").alias("hn"),
                                  F.avg("crash").alias("c"), F.avg("system_mpg").alias("s"))
    crash_ok = (F.col("c") == 0) if max_crash is None else (F.col("c") < max_crash)
    good = m.filter((F.col("hm") < max_headway) & (F.col("hn") > min_headway) & crash_ok)
    top = good.orderBy(F.col("s").desc(), "cp_path").limit(n).select("cp_path")
    kept = pr.join(maybe_broadcast(top, n), on="cp_path", how="left_semi")
    return kept.groupBy("cp_path").agg(
        rnd(F.avg("system_mpg"), 6).alias("system_mpg_mean"),
        rnd(F.coalesce(F.stddev_samp("system_mpg"), F.lit(0.0)), 6).alias("system_mpg_std"),
        F.min("system_mpg").alias("system_mpg_min"), F.max("system_mpg").alias("system_mpg_max"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def chunk_speed_class(f: DataFrame, run="run_id", threshold=18.0) -> DataFrame:
    """Run class high when the leader's mean speed > threshold; mean vehicle MPG
    (epsilon form) of non-leader vehicles per class."""
    v = f.groupBy(run, "id").agg(vehicle_mpg_eps(F.sum("speed"), F.sum("fuel")).alias("mpg"))
    cls = f.filter(F.col("id").contains("trajectory")).groupBy(run).agg(
        F.when(F.avg("speed") > threshold, "high").otherwise("low").alias("speed_class"))
    x = v.filter(~F.col("id").contains("trajectory")).join(cls, on=run, how="inner")
    return x.groupBy("speed_class").agg(rnd(F.avg("mpg"), 6).alias("mean_mpg"), F.count(F.lit(1)).alias("n_vehicles"))


def latest_checkpoint(p: DataFrame, exp: str, path: str, n_text: str) -> DataFrame:
    """T4: highest-numbered checkpoint per experiment (numeric, not text, comparison)."""
    n = F.col(n_text).try_cast("int")
    return p.groupBy(exp).agg(F.max_by(path, n).alias("latest_path"), F.max(n).alias("latest_n"))


def head_tail(df: DataFrame, keys, seq: str, max_rows: int) -> DataFrame:
    """T5: first and last ``max_rows // 2`` rows per key (dense seq; counts joined back)."""
    half = max_rows // 2
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = df.join(n, on=keys, how="inner")
    return x.filter((F.col(seq) < half) | (F.col(seq) >= F.col("_n") - half)).drop("_n")


def skip_sparse(df: DataFrame, keys, col: str, max_null_frac=0.5) -> DataFrame:
    """Keep groups whose share of NULL ``col`` is at most ``max_null_frac``."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count(col).alias("n_valid"),
             F.avg(F.when(F.col(col).isNull(), 1.0).otherwise(0.0)).alias("_f"))
        .filter(F.col("_f") <= max_null_frac)
        .drop("_f")
    )


def step_context(c: DataFrame, run: str = "run_id", step: str = "step", id_num: str = "id_num", vid: str = "id", humans: bool = False) -> DataFrame:
    """For every AV and step, (avg_miles, avg_gallons with 1e-6 each, time_frac of the run's last step, av_pos, headway and
    leader_speed where ``c`` has them). Averages are over the AVs, and the humans too if flagged."""
    av = F.col(vid).contains("av")
    counted = (av | F.col(vid).contains("human")) if humans else av
    g = c.groupBy(run, step).agg(F.avg(F.when(counted, F.col("total_miles"))).alias("avg_miles"),
                                 F.avg(F.when(counted, F.col("total_gallons") + 1e-6)).alias("avg_gallons"))
    last = c.groupBy(run).agg(F.max(step).alias("_last"))
    own = c.filter(av).select(run, step, id_num, F.col("position").alias("av_pos"), *[x for x in ("headway", "leader_speed") if x in c.columns])
    return own.join(g, [run, step]).join(last, run).withColumn("time_frac", F.col(step) / F.col("_last")).drop("_last")
