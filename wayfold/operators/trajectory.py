"""Rewards, transitions, advantages and summaries over (episode, step) tables.

``eid`` names the episode and ``step`` its 0-based step. Windows and recursions run per
(episode, block of steps), so one very long episode spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wayfold.operators.blocks import ROWS_PER_BLOCK, OrderedRows, never_null, ordered_rows

# Columns rewards read, and the defaults of rewards and advantages.
COMPLETED, BREACHES, COST = "completed_count", "sla_breaches", "total_cost"
BREACH_PENALTY = -10.0
COMPLIANCE_BONUS = 1.0
GAMMA = 0.99
LAMBDA = 0.95

# Neighbouring steps one task folds at a time in a backward scan.
FAN_IN = 32

Reward = Callable[[WindowSpec], Column]


def change(column: str, w: WindowSpec) -> Column:
    """Growth of ``column`` since the step before; missing counts as 0, and so does the state before the first step."""
    now = F.coalesce(F.col(column), F.lit(0))
    return now - F.coalesce(F.lag(now).over(w), F.lit(0))


def throughput_reward() -> Reward:
    return lambda w: change(COMPLETED, w).cast("double")


def sla_reward(penalty: float = BREACH_PENALTY, bonus: float = COMPLIANCE_BONUS) -> Reward:
    """A penalty per new breach; without one, a bonus for completing at the end of the episode."""
    return lambda w: (
        F.when(change(BREACHES, w) > 0, F.lit(penalty) * change(BREACHES, w))
        .when(F.col("done") & (change(COMPLETED, w) > 0), F.lit(bonus))
        .otherwise(F.lit(0.0))
    )


def cost_reward() -> Reward:
    return lambda w: -change(COST, w).cast("double")


def composite_reward(parts: list[tuple[Reward, float]]) -> Reward:
    """Weighted sum of rewards; 0 without parts."""
    def build(w: WindowSpec) -> Column:
        total = F.lit(0.0)
        for reward, weight in parts:
            total = total + F.lit(float(weight)) * reward(w)
        return total

    return build


def by_step(
    df: DataFrame, before: int = 0, after: int = 0, rows_per_block: int = ROWS_PER_BLOCK, split: bool | None = None
) -> OrderedRows:
    return ordered_rows(df, ["eid"], ["step"], before, after, rows_per_block, split=split)


def rewards(
    df: DataFrame, rules: dict[str, Reward], rows_per_block: int = ROWS_PER_BLOCK, split: bool | None = None
) -> DataFrame:
    """One column per named reward; all share one window."""
    ready = by_step(df, 1, 0, rows_per_block, split)
    return ready.select(*[rule(ready.window).cast("double").alias(n) for n, rule in rules.items()]).finish()


def transitions(
    df: DataFrame, state: Column, action: Column, reward: Column, max_steps: int | None = None,
    rows_per_block: int = ROWS_PER_BLOCK, split: bool | None = None,
) -> DataFrame:
    """(eid, step, state, action, reward, next_state, done) of consecutive steps.

    The last step of an episode leads nowhere and is no transition; one that arrives
    at it, or at step ``max_steps``, is done, and nothing follows ``max_steps``.
    """
    ready = by_step(
        df.select("eid", "step", state.alias("state"), action.alias("action"), reward.alias("reward"), "done"),
        0, 1, rows_per_block, split,
    )
    w = ready.window
    moved = ready.select(
        F.lead("state").over(w).alias("next_state"),
        F.lead("step").over(w).alias("_next_step"),
        F.lead("reward").over(w).alias("_next_reward"),
        F.lead("done").over(w).alias("_next_done"),
    ).finish()
    capped = F.lit(False) if max_steps is None else F.col("_next_step") >= max_steps
    kept = moved.where(F.col("_next_step").isNotNull())
    if max_steps is not None:
        kept = kept.where(F.col("step") < max_steps)
    return kept.select(
        "eid", "step", "state", "action",
        F.col("_next_reward").alias("reward"), "next_state",
        (F.coalesce("_next_done", F.lit(False)) | capped).alias("done"),
    )


def one_step_target(reward: Column, done: Column, next_values: Column, gamma: float = GAMMA) -> Column:
    """reward + gamma x best next value, nothing beyond the end."""
    return reward + F.lit(gamma) * F.array_max(next_values) * (1 - done.cast("double"))


def advantages(
    df: DataFrame, gamma: float = GAMMA, lam: float = LAMBDA, last_value: float = 0.0, fan_in: int = FAN_IN
) -> DataFrame:
    """Adds ``advantage`` and ``ret`` (advantage + value) to (eid, step, reward, value, done), in place of columns of these names.

    The recursion A(t) = r - v + gamma v(t+1) + gamma lam A(t+1) starts at the last step,
    where ``last_value`` follows, and is cut where an episode is done. Steps may be negative; rows without a step stand
    before the first step of their run.
    """
    ends = df.agg(F.min("step").cast("bigint").alias("low"), F.max("step").cast("bigint").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    goes_on = 1 - F.col("done").cast("double")
    terms = df.select(
        never_null(F.col("eid")).alias("run"),
        F.coalesce(F.col("step").cast("bigint") - F.lit(low) + 1, F.lit(0)).cast("bigint").alias("at"),
        (F.lit(gamma * lam) * goes_on).alias("p"),
        (F.lit(gamma) * goes_on).alias("g"),
        (F.col("reward") - F.col("value")).cast("double").alias("r"),
        F.col("value").cast("double").alias("v"),
        F.struct(*df.columns).alias("payload"),
    )
    scanned = backward_scan(terms, high - low + 1, fan_in, float(last_value))
    kept = [F.col("payload")[c].alias(c) for c in df.columns if c.lower() not in ("advantage", "ret")]
    return scanned.select(*kept, F.col("a").alias("advantage"), (F.col("a") + F.col("payload")["value"]).alias("ret"))


def backward_scan(rows: DataFrame, last: int, fan_in: int, last_value: float) -> DataFrame:
    """Run a = r + g x (v behind it) + p x (a behind it) from the highest ``at`` of each ``run`` down.

    Input (run, at, p, g, r, v, payload) with a run that is never null; adds ``a``, and what entered from
    behind as ``a_in`` and ``v_in``. A group of ``fan_in`` neighbours acts as one such step itself, so
    groups are folded on their own, the same scan runs over the folded groups, and each
    group is then filled in. Every task sees at most ``fan_in`` rows of a run at a
    time, and a run of n steps needs log n rounds; short ones need one.
    """
    grouped = rows.groupBy("run", F.floor(F.col("at") / fan_in).alias("_group")).agg(
        F.sort_array(F.collect_list(F.struct("at", "p", "g", "r", "v", "payload")), asc=False).alias("_steps")
    )
    if last < fan_in:
        entered = grouped.withColumns({"_a": F.lit(0.0), "_v": F.lit(last_value)})
    else:
        behind = F.col("_steps")[0]
        folded = F.aggregate(
            F.slice("_steps", 2, F.size("_steps")),
            F.struct(*[behind[n].alias(n) for n in "pgrv"]),
            lambda acc, x: F.struct(
                (x["p"] * acc["p"]).alias("p"),
                (x["p"] * acc["g"]).alias("g"),
                (x["r"] + x["g"] * acc["v"] + x["p"] * acc["r"]).alias("r"),
                x["v"].alias("v"),
            ),
        )
        lines = grouped.select("run", F.col("_group").alias("at"), folded.alias("_line")).select(
            "run", "at", "_line.*", F.lit(None).cast("int").alias("payload")
        )
        above = backward_scan(lines, last // fan_in, fan_in, last_value).select(
            "run", F.col("at").alias("_group"), F.col("a_in").alias("_a"), F.col("v_in").alias("_v")
        )
        entered = grouped.join(above, ["run", "_group"])
    payload = rows.schema["payload"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<at:bigint,payload:{payload},a_in:double,v_in:double,a:double>>")
    start = F.struct(F.col("_a").alias("a"), F.col("_v").alias("v"), empty.alias("rows"))
    return entered.select("run", F.inline(F.aggregate("_steps", start, _scan_step, lambda acc: acc["rows"])))


def _scan_step(acc: Column, x: Column) -> Column:
    a = x["r"] + x["g"] * acc["v"] + x["p"] * acc["a"]
    row = F.struct(
        x["at"].alias("at"), x["payload"].alias("payload"), acc["a"].alias("a_in"), acc["v"].alias("v_in"), a.alias("a")
    )
    return F.struct(a.alias("a"), x["v"].alias("v"), F.concat(acc["rows"], F.array(row)).alias("rows"))


def normalise(df: DataFrame, column: str = "advantage", out: str = "advantage_norm") -> DataFrame:
    """(x - mean) / (sample deviation + 1e-8) over all rows; mean and deviation are scalar subqueries."""
    facts = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    mean, deviation = facts.select("m").scalar(), facts.select("s").scalar()
    return df.withColumn(out, (F.col(column) - mean) / (deviation + 1e-8))


def episode_returns(df: DataFrame, reward: str = "reward") -> DataFrame:
    """(eid, total_reward, length)."""
    return df.groupBy("eid").agg(F.sum(reward).alias("total_reward"), F.count(F.lit(1)).alias("length"))


def episode_summary(df: DataFrame, reward: str = "reward") -> DataFrame:
    """Mean, population deviation, range and success share of episode rewards, and the mean length."""
    return episode_returns(df, reward).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("total_reward").alias("mean_reward"),
        F.stddev_pop("total_reward").alias("std_reward"),
        F.min("total_reward").alias("min_reward"),
        F.max("total_reward").alias("max_reward"),
        F.avg((F.col("total_reward") > 0).cast("double")).alias("success_rate"),
        F.avg("length").alias("mean_length"),
    )
