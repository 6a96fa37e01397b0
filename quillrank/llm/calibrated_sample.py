"""p4: a sample whose strata follow given shares, with minimum rows, and the targets that cannot be met.

1. Labels are folded to strata and each run's candidates become units with the set of their strata ("mask":
   their numbers in order, as text).
2. Category moments are aggregated: the number of units of each run and mask. What goes on is a run's masks,
   not its units.
   A target is out of reach where the tilting towards all targets, with probabilities of at most 1, leaves a
   stratum's moment short of it: its masks are all at 1 then. That is what ``p4_found`` reports.
3. The wanted counts are what the run can give: floors first, what a stratum lacks is shared among those
   with units to spare. Units' probabilities exp(x . lambda), at most 1, are calibrated to the wanted counts
   by Newton steps on the convex dual of exponential tilting; masks at 1 are fixed and the rest solved again.
4. Expected counts of masks are rounded to whole numbers with the floors kept, and units are drawn with
   those probabilities by the pivotal method: two undecided units of a mask fight, one gets all of their
   common probability or gives up all of its own. A mask of a run with more than a block of units is played in
   salted blocks; each leaves at most one undecided unit, and those play on.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.tables import checkpoint, table, task_count

SAMPLE_SIZE = 100
BLOCK_UNITS = 20_000
SEED = 42


def folded_stratum(label: Column) -> Column:
    """Lower case, no outer white space, one underscore between words; null for a blank label."""
    words = F.regexp_replace(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(words != "", words)


def label_units(labels: DataFrame, strata: list[str]) -> DataFrame:
    """(run_id, candidate_id, mask): each candidate of a run once, with the strata it is labelled with.

    ``mask`` has the numbers of its ``strata`` in order, joined by commas; unknown and missing strata add none.
    Rows without a run or a candidate are left out. Repeated labels count once; a hot candidate is combined
    before the shuffle.
    """
    number = F.coalesce(*(F.when(folded_stratum(F.col("stratum")) == s, F.lit(k)) for k, s in enumerate(strata)), F.lit(None).cast("int"))
    known = labels.where(F.col("run_id").isNotNull() & F.col("candidate_id").isNotNull())
    return known.select("run_id", "candidate_id", number.alias("_k")).groupBy("run_id", "candidate_id").agg(F.array_join(F.sort_array(F.collect_set("_k")).cast("array<string>"), ",").alias("mask"))


def wanted_counts(available: np.ndarray, shares: np.ndarray, floors: np.ndarray, size: int) -> np.ndarray:
    """Counts as near to the shares as the run allows: never above what there is, floors kept where there are units."""
    most = available.astype(float)
    least = np.minimum(floors, most)
    want = np.clip(shares * size, least, most)
    for _ in range(64):
        over = size - want.sum()
        room = (most - want > 1e-9) if over > 0 else (want - least > 1e-9)
        if abs(over) < 1e-9 or not room.any():
            break
        weight = np.where(room, np.maximum(shares, 1e-6), 0.0)
        want = np.clip(want + over * weight / weight.sum(), least, most)
    return want


def tilt(x: np.ndarray, units: np.ndarray, want: np.ndarray, steps: int = 100) -> np.ndarray:
    """Probabilities min(1, exp(x . lam)) of the masks ``x`` (0/1 rows) whose moments are as near to ``want`` as can be.

    Damped Newton steps on the convex dual sum(units * f(x . lam)) - want . lam, where f is exp below 0 and goes on
    straight above it, so that its slope is the probability. A stratum all of whose masks are at 1 and that still
    is short of its target is out of reach: its own unknown would grow for ever and is left where it is.
    """
    lam = np.full(x.shape[1], np.log(min(1.0, max(want.sum(), 1e-9) / max(units.sum(), 1.0))) / max(1.0, x.sum(1).mean()))
    value = lambda v: float(units @ np.where((q := x @ v) < 0, np.exp(np.minimum(q, 0)), 1 + q) - want @ v)
    now = value(lam)
    for _ in range(steps):
        q = x @ lam
        p = np.exp(np.minimum(q, 0))
        gradient = (units * p) @ x - want
        below = ((q < -1e-12) & (units > 0)) @ x > 0
        moving = (np.abs(gradient) > 1e-7) & (below | (gradient > 0))
        if not moving.any():
            break
        xs = x[:, moving]
        w = units * np.where(q < 0, p, 1e-2)
        step = np.linalg.solve((xs * w[:, None]).T @ xs + 1e-7 * np.eye(xs.shape[1]), gradient[moving])
        step *= min(1.0, 8.0 / max(np.abs(step).max(), 1e-12))
        t = 1.0
        while t > 1e-6:
            tried = lam.copy()
            tried[moving] -= t * step
            if (then := value(tried)) <= now:
                break
            t /= 2
        else:
            break
        lam, now = tried, then
    return np.where(units > 0, np.exp(np.minimum(x @ lam, 0)), 0.0)


def whole_counts(x: np.ndarray, units: np.ndarray, expected: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers near ``expected`` for each mask that sum to ``size`` (or all units) and keep the floors."""
    size = int(min(size, units.sum()))
    n = np.minimum(np.floor(expected + 1e-9), units).astype(int)
    rest = expected - n
    while n.sum() < size:
        open_ = n < units
        short = np.maximum(least - n @ x, 0) @ x.T
        best = int(np.argmax(np.where(open_, 10 * np.minimum(short, 1) + rest, -np.inf)))
        n[best] += 1
        rest[best] -= 1
    for _ in range(4 * size + 4):
        missing = np.flatnonzero(least - n @ x > 0)
        fixable = [(k, m) for k in missing for m in np.flatnonzero((x[:, k] > 0) & (n < units))]
        if n.sum() > size:
            spare = [m for m in np.flatnonzero(n > 0) if np.all((n @ x - x[m])[x[m] > 0] >= least[x[m] > 0])] or list(np.flatnonzero(n > 0))
            n[max(spare, key=lambda m: n[m] - expected[m])] -= 1
        elif fixable:
            n[fixable[0][1]] += 1
        else:
            break
    return n


def _calibrator(strata: list[str], shares: list[float], floors: list[int], size: int):
    s, f = np.array(shares), np.array(floors)
    required = np.maximum(f, np.floor(s * size + 0.5 + 1e-9)).astype(int)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        masks = pdf["mask"].tolist()
        units = pdf["n_units"].to_numpy(dtype=float)
        x = np.zeros((len(masks), len(strata)))
        for i, mask in enumerate(masks):
            x[i, [int(k) for k in mask.split(",") if k]] = 1.0
        available = (units @ x).astype(int)
        known = x.any(axis=1)
        reached = (tilt(x[known], units[known], required.astype(float)) * units[known]) @ x[known]
        want = wanted_counts(available, s, f, size)
        drawn = np.zeros(len(masks), dtype=int)
        if known.any():
            p = tilt(x[known], units[known], want)
            expected = p * units[known]
            total = min(size, units[known].sum())
            if expected.sum() > 0:
                expected = np.minimum(expected * total / expected.sum(), units[known])
            drawn[known] = whole_counts(x[known], units[known], expected, np.minimum(f, available), size)
        got = (drawn @ x).astype(int)
        run_id = pdf["run_id"].iloc[0]
        by_mask = pd.DataFrame({"run_id": run_id, "mask": masks, "stratum": None, "n_units": units.astype(int), "n_drawn": drawn, "required": 0, "wanted": 0.0, "reached": 0.0})
        by_stratum = pd.DataFrame({"run_id": run_id, "mask": None, "stratum": strata, "n_units": available, "n_drawn": got, "required": required, "wanted": want, "reached": reached})
        return pd.concat([by_mask, by_stratum], ignore_index=True)

    return run


def calibrate(units: DataFrame, strata: list[str], shares: list[float], floors: list[int], size: int = SAMPLE_SIZE) -> DataFrame:
    """For each run its masks (units and whole numbers to draw) and, under a null mask, its strata.

    A run is one group of as many rows as there are different sets of strata, however many labels it has.
    """
    moments = units.groupBy("run_id", "mask").agg(F.count(F.lit(1)).alias("n_units"))
    kind = dict(units.dtypes)["run_id"]
    # Few bytes, much work: the number of tasks is stated, as by size all would be one.
    return moments.repartition(task_count(units.sparkSession), "run_id").groupBy("run_id").applyInPandas(_calibrator(strata, shares, floors, size), f"run_id {kind}, mask string, stratum string, n_units bigint, n_drawn bigint, required bigint, wanted double, reached double")


def pivotal(p: np.ndarray, order: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Probabilities after the fights: all 0 or 1 but for at most one. Sums are kept."""
    out, holder = p.astype(float).copy(), -1
    eps = 1e-9
    for i, u in zip(order, chance):
        if out[i] < eps or out[i] > 1 - eps:
            out[i] = round(out[i])
            continue
        if holder < 0:
            holder = i
            continue
        a, b = out[holder], out[i]
        if a + b < 1:
            winner, loser = (holder, i) if u < a / (a + b) else (i, holder)
            out[winner], out[loser] = a + b, 0.0
        else:
            winner, loser = (holder, i) if u < (1 - b) / (2 - a - b) else (i, holder)
            out[winner], out[loser] = 1.0, a + b - 1
            winner = loser
        holder = winner
        if out[holder] < eps or out[holder] > 1 - eps:
            out[holder] = round(out[holder])
            holder = -1
    return out


def _fight(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["mask", "_u", "candidate_id"], ignore_index=True)
    p = pdf["p"].to_numpy(dtype=float).copy()
    for rows in pdf.groupby("mask", sort=True).indices.values():
        p[rows] = pivotal(p[rows], np.arange(len(rows)), pdf["_v"].to_numpy()[rows])
    return pdf.assign(p=p)


def _uniform(*parts: object) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)).cast("double")


def salted(units: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The units of the masks that are drawn from, with probability, random numbers and block.

    Blocks are of the units of one run and mask; so a run's sample depends on that run alone, and a mask of less
    than a block is whole.
    """
    masks = plan.where("mask is not null and n_drawn > 0").select("run_id", "mask", (F.col("n_drawn") / F.col("n_units")).alias("p"), F.ceil(F.col("n_units") / BLOCK_UNITS).alias("_blocks"))
    return units.join(masks, ["run_id", "mask"]).select("run_id", "candidate_id", "mask", "p", _uniform("candidate_id", "run_id", F.lit(seed)).alias("_u"), _uniform("candidate_id", "run_id", F.lit(seed + 1)).alias("_v"), F.pmod(F.xxhash64("candidate_id", F.lit(seed + 2)), F.col("_blocks")).cast("int").alias("_salt"))


def draw(units: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(run_id, candidate_id, mask) of the sample, by the pivotal method in salted blocks, then among what they left."""
    rows = salted(units, plan, seed)
    # Blocks of the same number of all masks of a run make one group: masks of less than a block are all in block 0.
    first = checkpoint(rows.groupBy("run_id", "_salt").applyInPandas(_fight, rows.schema))
    # Sums of whole masks are whole, so the last round leaves no unit undecided but for rounding.
    undecided = first.where("p > 1e-9 and p < 1 - 1e-9")
    last = undecided.groupBy("run_id", "mask").applyInPandas(_fight, rows.schema)
    won = first.where("p >= 1 - 1e-9").unionByName(last.where("p >= 0.5"))
    return won.select("run_id", "candidate_id", "mask")


def _targets(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[float], list[int]]:
    """The strata: as many as the dual has unknowns, so they go to the driver as the program's parameters do."""
    rows = table(spark, sf_dir, "stratum_targets").select(folded_stratum(F.col("stratum")).alias("s"), "target_share", "min_rows").orderBy("s").collect()
    return [r["s"] for r in rows], [r["target_share"] for r in rows], [r["min_rows"] for r in rows]


def run_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    strata, shares, floors = _targets(spark, sf_dir)
    units = label_units(table(spark, sf_dir, "label_results"), strata)
    return units, calibrate(units, strata, shares, floors)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of a run whose target or floor the calibration leaves out of reach; candidates there are confirm it."""
    _, plan = run_plan(spark, sf_dir)
    return plan.where("mask is null and reached < required - 0.001 and n_units < required").select("run_id", "stratum")


def p4_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run and stratum: candidates there are, needed, aimed at and drawn."""
    _, plan = run_plan(spark, sf_dir)
    return plan.where("mask is null").select("run_id", "stratum", F.col("n_units").alias("n_available"), "required", F.round("wanted", 6).alias("wanted"), "n_drawn")


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, plan = run_plan(spark, sf_dir)
    return draw(units, checkpoint(plan))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: 100 distinct candidates a run, or all labelled ones where there are fewer."""
    return _sample(spark, sf_dir).select("run_id", "candidate_id", F.size(F.split("mask", ",")).alias("n_strata"))


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: candidates drawn, those drawn twice, and strata drawn below what floor and run allow."""
    strata, _, floors = _targets(spark, sf_dir)
    drawn = checkpoint(_sample(spark, sf_dir))
    size = drawn.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_drawn"), (F.count(F.lit(1)) - F.countDistinct("candidate_id")).alias("n_twice"))
    got = drawn.select("run_id", F.explode(F.split("mask", ",").cast("array<int>")).alias("_k")).groupBy("run_id", "_k").agg(F.count(F.lit(1)).alias("_got"))
    units = label_units(table(spark, sf_dir, "label_results"), strata).where("mask <> ''")
    there = units.select("run_id", F.explode(F.split("mask", ",").cast("array<int>")).alias("_k")).groupBy("run_id", "_k").agg(F.count(F.lit(1)).alias("_there"))
    floor = F.array(*map(F.lit, floors))[F.col("_k")]
    short = there.join(got, ["run_id", "_k"], "left").groupBy("run_id").agg(F.sum((F.coalesce("_got", F.lit(0)) < F.least("_there", floor)).cast("bigint")).alias("n_below_floor"))
    return short.join(size, "run_id", "left").select("run_id", F.coalesce("n_drawn", F.lit(0)).alias("n_drawn"), F.coalesce("n_twice", F.lit(0)).alias("n_twice"), "n_below_floor")


P4_CHECKS_SQL = """
WITH folded AS (SELECT run_id, candidate_id, trim(regexp_replace(lower(stratum), '[^a-z0-9]+', '_', 'g'), '_') AS stratum FROM label_results WHERE run_id IS NOT NULL AND candidate_id IS NOT NULL)
SELECT run_id, least(100, count(DISTINCT candidate_id)) AS n_drawn, CAST(0 AS BIGINT) AS n_twice, CAST(0 AS BIGINT) AS n_below_floor
FROM folded WHERE stratum IN (SELECT stratum FROM stratum_targets) GROUP BY 1
"""

P4_FOUND_SQL = """
WITH folded AS (
  SELECT DISTINCT run_id, candidate_id, trim(regexp_replace(lower(stratum), '[^a-z0-9]+', '_', 'g'), '_') AS stratum
  FROM label_results WHERE run_id IS NOT NULL AND candidate_id IS NOT NULL),
have AS (SELECT run_id, stratum, count(*) AS n FROM folded GROUP BY 1, 2)
SELECT r.run_id, t.stratum FROM (SELECT DISTINCT run_id FROM folded) AS r CROSS JOIN stratum_targets AS t
LEFT JOIN have AS h ON h.run_id = r.run_id AND h.stratum = t.stratum
WHERE coalesce(h.n, 0) < greatest(t.min_rows, round(100 * t.target_share))
"""
