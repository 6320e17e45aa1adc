"""Rewards, transitions, advantages and buffers over the journeys of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import JOURNEYS, OFF_TIES, Entry, event_block, plain_journeys, r6, rounded, split_journeys
from wayfold.operators.blocks import ROWS_PER_BLOCK
from wayfold.operators.replay import largest, newest, prioritised_sample, uniform_sample
from wayfold.operators.trajectory import (
    advantages,
    composite_reward,
    cost_reward,
    episode_returns,
    episode_summary,
    normalise,
    one_step_target,
    rewards,
    sla_reward,
    throughput_reward,
    transitions,
)
from wayfold.sources.event_tables import table

# Folds few steps at a time, so that several rounds are needed.
FAN_IN = 16


def counted(spark, folder):
    """Journeys with the running counts rewards are made of."""
    tr = plain_journeys(spark, folder)
    return tr.select(
        "eid", "step", "done", "wait", "s_node_util",
        (F.col("step") * 2 + F.when(F.col("done"), 1).otherwise(0)).alias("completed_count"),
        F.floor(F.col("s_cum_wait") / 5000).cast("bigint").alias("sla_breaches"),
        F.when(F.col("step") > 0, F.col("s_cum_cost")).alias("total_cost"),
    )


def rewarded(spark, folder, rows_per_block=ROWS_PER_BLOCK, split=None):
    rules = {
        "throughput": throughput_reward(), "sla": sla_reward(), "cost": cost_reward(),
        "total": composite_reward([(throughput_reward(), 1.0), (sla_reward(), 1.0), (cost_reward(), 0.1)]),
    }
    found = rewards(counted(spark, folder), rules, rows_per_block, split)
    return rounded(found.select("eid", "step", *rules), "cost", "total")


def moved(spark, folder):
    tr = plain_journeys(spark, folder)
    found = transitions(
        tr, F.array(r6("s_node_util").cast("float"), F.col("s_steps_done").cast("float")), F.col("node"), r6(-F.col("wait")), 3, event_block(spark, folder), True
    )
    return found.select(
        "eid", "step", "action", "reward", "done",
        *[F.round(F.col(c)[i].cast("double"), 4).alias(f"{c}_{i}") for c in ("state", "next_state") for i in (0, 1)],
    )


def rollout(spark, folder):
    tr = plain_journeys(spark, folder)
    ends = F.col("done")
    return tr.select("eid", "step", r6("s_node_util").alias("reward"), r6(F.col("s_sys_util") / 2).alias("value"), ends.alias("done"))


def advanced(spark, folder):
    found = advantages(rollout(spark, folder))
    return rounded(found.withColumns({c: F.col(c) + OFF_TIES for c in ("advantage", "ret")}), "advantage", "ret")


def long_run(spark, folder):
    """All events of a user as one episode, done at each error; long runs need several rounds."""
    events = table(spark, folder, "events")
    steps = events.select(
        (F.col("user_id") % 3).cast("string").alias("eid"), F.col("event_id").alias("step"),
        (F.col("value") / 100).alias("reward"), (F.col("event_id") % 5 / 10).alias("value"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)).alias("done"),
    )
    found = advantages(steps, fan_in=FAN_IN)
    return rounded(found.withColumns({c: F.col(c) + OFF_TIES for c in ("advantage", "ret")}), "advantage", "ret")


def normal(spark, folder):
    found = normalise(advantages(rollout(spark, folder)))
    return rounded(found.select("eid", "step", "advantage_norm"), "advantage_norm")


def targets(spark, folder):
    tr = plain_journeys(spark, folder)
    q = F.array(F.col("s_node_util"), F.col("s_sys_util"), F.lit(0.25))
    return tr.select("eid", "step", F.round(one_step_target(-F.col("wait"), F.col("done"), q), 6).alias("target"))


def buffered(n, small):
    def run(spark, folder):
        return newest_of(table(spark, folder, "events"), n, small)
    return run


def newest_of(events, n, small):
    kept = events.select("event_id", "user_id", "event_type")
    if small:
        return newest(kept, n, "event_id")
    # Forced onto the cut-value path that large capacities take.
    return largest(kept, n, F.col("event_id"), F.col("event_id"), small=0, bracket_limit=100)


LARGE = 10_500


def large_buffer(known):
    """A buffer of more rows than a single merge takes; keys are equal or, where ``known`` does not hold, null."""
    def run(spark, folder):
        line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.expr(known), F.col("l_quantity")).alias("q"))
        tie = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string"))
        return largest(line, LARGE, F.col("q"), tie)
    return run


def large_buffer_sql(known):
    return f"""SELECT l_orderkey, l_linenumber, CASE WHEN {known} THEN l_quantity END AS q FROM lineitem
        ORDER BY q DESC NULLS LAST, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber LIMIT {LARGE}"""


def all_moves(spark, folder):
    tr = plain_journeys(spark, folder)
    found = transitions(tr, F.array(r6("s_node_util").cast("float")), F.col("node"), r6(-F.col("wait")), None, event_block(spark, folder), True)
    return found.select("eid", "step", "action", "reward", "done")


def all_steps(spark, folder):
    """Every event: a long episode and one for each other user, half of the steps negative, the last event of each episode without a step."""
    events = table(spark, folder, "events").withColumn("eid", F.when(F.col("user_id") % 7 == 0, "long").otherwise(F.col("user_id").cast("string")))
    last = events.groupBy("eid").agg(F.max("event_id").alias("event_id")).withColumn("last", F.lit(True))
    signed = F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id"))
    # Both columns are the key, so that the long episode spreads.
    return events.join(last, ["eid", "event_id"], "left").select(
        "eid", F.when(F.col("last").isNull(), signed).alias("step"),
        (F.col("value") / 100).alias("reward"), (F.col("event_id") % 5 / 10).alias("value"), (F.col("event_id") % 97 == 0).alias("done"),
    )


def all_advantages(spark, folder):
    found = advantages(all_steps(spark, folder))
    return rounded(found.withColumns({c: F.col(c) + OFF_TIES for c in ("advantage", "ret")}), "advantage", "ret")


def tied(spark, folder):
    """The cut falls inside many equal quantities; the tie rule decides."""
    line = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"))
    return largest(line, 700, F.col("q"), F.col("l_orderkey"), small=0, bracket_limit=10)


def sampled(spark, folder):
    return uniform_sample(table(spark, folder, "events").select("event_id", "value"), 64, F.col("event_id"), 7)


def prioritised(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return prioritised_sample(events, 64, F.col("value"), F.col("event_id"), 7)


def summary(spark, folder):
    found = episode_summary(split_journeys(spark, folder).withColumn("reward", F.col("s_node_util") - 0.5))
    return rounded(found, "mean_reward", "std_reward", "min_reward", "max_reward", "success_rate", "mean_length")


def returns(spark, folder):
    return rounded(episode_returns(plain_journeys(spark, folder), "processing"), "total_reward")


COUNTED = JOURNEYS + """,
co AS (SELECT eid, step, done, step * 2 + CASE WHEN done THEN 1 ELSE 0 END AS completed,
       CAST(floor(s_cum_wait / 5000) AS BIGINT) AS breaches, CASE WHEN step > 0 THEN s_cum_cost ELSE 0e0 END AS cost FROM tr),
ch AS (SELECT eid, step, done, completed - coalesce(lag(completed) OVER w, 0) AS dn, breaches - coalesce(lag(breaches) OVER w, 0) AS db,
       cost - coalesce(lag(cost) OVER w, 0) AS dc FROM co WINDOW w AS (PARTITION BY eid ORDER BY step)),
rw AS (SELECT eid, step, CAST(dn AS DOUBLE) AS throughput,
       CAST(CASE WHEN db > 0 THEN -10 * db WHEN done AND dn > 0 THEN 1 ELSE 0 END AS DOUBLE) AS sla, -dc AS cost FROM ch)"""


def advantage_sql(source: str) -> str:
    """The recursion row by row: ``ro`` is numbered from each episode's end."""
    return f"""WITH RECURSIVE {source},
        nu AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY eid ORDER BY step), 0e0) AS nv, CASE WHEN done THEN 0e0 ELSE 1e0 END AS go,
               row_number() OVER (PARTITION BY eid ORDER BY step DESC) AS k FROM ro),
        de AS (SELECT *, reward + 0.99e0 * nv * go - value AS d FROM nu),
        ga AS (SELECT eid, step, k, d AS advantage FROM de WHERE k = 1
               UNION ALL SELECT de.eid, de.step, de.k, de.d + 0.99e0 * 0.95e0 * de.go * ga.advantage FROM de JOIN ga ON de.eid = ga.eid AND de.k = ga.k + 1)"""


ROLLOUT = JOURNEYS + ", ro AS (SELECT eid, step, round(s_node_util, 6) AS reward, round(s_sys_util / 2, 6) AS value, done FROM tr)"
LONG = """ro AS (SELECT CAST(user_id % 3 AS VARCHAR) AS eid, event_id AS step, value / 100 AS reward, event_id % 5 / 10e0 AS value,
        event_type = 'error' AND event_id % 2 = 0 AS done FROM events)"""
# The step that stands for none comes before all others.
ALL_STEPS = """ev AS (SELECT *, CASE WHEN user_id % 7 = 0 THEN 'long' ELSE CAST(user_id AS VARCHAR) END AS eid FROM events),
    ro AS (SELECT eid, CASE WHEN event_id = max(event_id) OVER (PARTITION BY eid) THEN -1000000000000 WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END AS step,
        value / 100 AS reward, event_id % 5 / 10e0 AS value, event_id % 97 = 0 AS done FROM ev)"""
ADVANTAGE_COLUMNS = f"round(advantage + {OFF_TIES}, 6) AS advantage, round(advantage + value + {OFF_TIES}, 6) AS ret"
UNIFORM = "((CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|7'), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0)"

REWARDS = f"""WITH {COUNTED}
        SELECT eid, step, throughput, sla, round(cost, 6) AS cost, round(throughput + sla + 0.1e0 * cost, 6) AS total FROM rw"""

ENTRIES = [
    Entry("reward_columns", rewarded, REWARDS),
    Entry("reward_columns_in_blocks", lambda s, f: rewarded(s, f, event_block(s, f), True), REWARDS),
    Entry("trajectory_transitions", moved, f"""WITH {JOURNEYS},
        le AS (SELECT eid, step, node AS action, round(s_node_util, 4) AS state_0, CAST(s_steps_done AS DOUBLE) AS state_1,
          lead(round(-wait, 6)) OVER w AS reward, lead(done) OVER w AS nd, lead(step) OVER w AS ns,
          lead(round(s_node_util, 4)) OVER w AS next_state_0, CAST(lead(s_steps_done) OVER w AS DOUBLE) AS next_state_1
          FROM tr WINDOW w AS (PARTITION BY eid ORDER BY step))
        SELECT eid, step, action, reward, nd OR ns >= 3 AS done, state_0, state_1, next_state_0, next_state_1
        FROM le WHERE ns IS NOT NULL AND step < 3"""),
    Entry("trajectory_transitions_uncapped", all_moves, f"""WITH {JOURNEYS},
        le AS (SELECT eid, step, node AS action, lead(round(-wait, 6)) OVER w AS reward, lead(done) OVER w AS done, lead(step) OVER w AS ns
          FROM tr WINDOW w AS (PARTITION BY eid ORDER BY step))
        SELECT eid, step, action, reward, done FROM le WHERE ns IS NOT NULL"""),
    Entry("trajectory_advantages_all_steps", all_advantages, advantage_sql(ALL_STEPS) + """
        SELECT ro.eid, CASE WHEN ro.step > -1000000000000 THEN ro.step END AS step, reward, value, done, """ + ADVANTAGE_COLUMNS + """
        FROM ro JOIN ga ON ro.eid = ga.eid AND ro.step = ga.step"""),
    Entry("trajectory_advantages", advanced, advantage_sql(ROLLOUT) + """
        SELECT ro.eid, ro.step, reward, value, done, """ + ADVANTAGE_COLUMNS + """
        FROM ro JOIN ga ON ro.eid = ga.eid AND ro.step = ga.step"""),
    Entry("trajectory_advantages_long", long_run, advantage_sql(LONG) + """
        SELECT ro.eid, ro.step, reward, value, done, """ + ADVANTAGE_COLUMNS + """
        FROM ro JOIN ga ON ro.eid = ga.eid AND ro.step = ga.step"""),
    Entry("trajectory_normalised", normal, advantage_sql(ROLLOUT) + """
        SELECT eid, step, round((advantage - (SELECT avg(advantage) FROM ga)) / ((SELECT stddev_samp(advantage) FROM ga) + 1e-8), 6) AS advantage_norm FROM ga"""),
    Entry("trajectory_one_step_target", targets, f"""WITH {JOURNEYS}
        SELECT eid, step, round(-wait + 0.99e0 * greatest(s_node_util, s_sys_util, 0.25e0) * CASE WHEN done THEN 0 ELSE 1 END, 6) AS target FROM tr"""),
    Entry("trajectory_returns", returns, f"WITH {JOURNEYS} SELECT eid, round(sum(processing), 6) AS total_reward, count(*) AS length FROM tr GROUP BY eid"),
    Entry("trajectory_summary", summary, f"""WITH {JOURNEYS}, ep AS (SELECT eid, sum(s_node_util - 0.5) AS r, count(*) AS n FROM tr GROUP BY eid)
        SELECT count(*) AS episodes, round(avg(r), 6) AS mean_reward, round(stddev_pop(r), 6) AS std_reward, round(min(r), 6) AS min_reward,
          round(max(r), 6) AS max_reward, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS success_rate, round(avg(n), 6) AS mean_length FROM ep"""),
    Entry("replay_newest", buffered(500, True), "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500"),
    Entry("replay_newest_large", buffered(700, False), "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 700"),
    Entry("replay_largest_ties", tied, """
        SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey ORDER BY q DESC, l_orderkey LIMIT 700"""),
    Entry("replay_large_ties", large_buffer("true"), large_buffer_sql("true")),
    Entry("replay_large_null_keys", large_buffer("l_linenumber = 2"), large_buffer_sql("l_linenumber = 2")),
    Entry("replay_uniform", sampled, f"SELECT event_id, value FROM events ORDER BY {UNIFORM} DESC, event_id LIMIT 64"),
    Entry("replay_prioritised", prioritised, f"""
        SELECT event_id, value FROM events WHERE value > 0 ORDER BY ln({UNIFORM}) / pow(value, 0.6e0) DESC, event_id LIMIT 64"""),
]
