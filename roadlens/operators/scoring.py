"""Scoring of tagged model answers and judge outputs (L5-L10). Answers and judge
responses are input tables; everything here is Column expressions or joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize

# ---- fixed values (must equal the studied code base) -------------------------
ANSWER_TAGS = {
    "future_speeds": 4,
    "future_headway": 4,
    "future_leader_speed": 4,
    "future_reward": 4,
    "reward_coefficients": 4,
}
MIN_REASONING_CHARS = 5
JUDGE_PASS = 7
SPEED_LIMITS = (0.0, 50.0)
HEADWAY_LIMITS = (0.0, 200.0)
# ------------------------------------------------------------------------------


def format_ok(response: Column, tags: dict[str, int] = ANSWER_TAGS) -> Column:
    """Every tag parses to exactly its count of numbers, reasoning >= 5 chars."""
    conds = [F.coalesce(F.size(tx.extract_values(response, t)) == n, F.lit(False)) for t, n in tags.items()]
    reasoning = tx.extract_tag(response, "reasoning")
    conds.append(F.coalesce(F.length(tx.strip(reasoning)) >= MIN_REASONING_CHARS, F.lit(False)))
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def judge_scores(judge_text: Column) -> dict[str, Column]:
    """Integer scores; any unparsable or missing -> both -1; pass when both >= 7."""
    uf = tx.extract_tag(judge_text, "user_friendly_score").try_cast("int")
    coh = tx.extract_tag(judge_text, "coherence_score").try_cast("int")
    bad = uf.isNull() | coh.isNull()
    uf_s = F.when(bad, F.lit(-1)).otherwise(uf)
    coh_s = F.when(bad, F.lit(-1)).otherwise(coh)
    return {
        "user_friendly_score": uf_s,
        "coherence_score": coh_s,
        "verdict": F.when((uf_s >= JUDGE_PASS) & (coh_s >= JUDGE_PASS), "yes").otherwise("no"),
    }


def physical_check(speeds: Column, headways: Column | None = None, leaders: Column | None = None) -> dict[str, Column]:
    """Speeds / leader speeds in [0, 50], headways in [0, 200]; first failing reason."""
    def bad(arr, lo, hi):
        return F.coalesce(F.exists(arr, lambda x: (x < lo) | (x > hi)), F.lit(False))

    reason = F.when(bad(speeds, *SPEED_LIMITS), F.lit("Invalid speed detected"))
    if headways is not None:
        reason = reason.when(bad(headways, *HEADWAY_LIMITS), F.lit("Invalid headway detected"))
    if leaders is not None:
        reason = reason.when(bad(leaders, *SPEED_LIMITS), F.lit("Invalid leader speed detected"))
    reason = reason.otherwise(F.lit(""))
    return {"physical_ok": reason == "", "reason": reason}


def majority_vote(votes: DataFrame, key="pair_id", vote="winner") -> DataFrame:
    """Valid votes are 'A'/'B'; majority wins; tie or no valid vote -> the
    deterministic stand-in for the random pick: 'A' for even keys, 'B' for odd."""
    agg = votes.groupBy(key).agg(
        F.count_if(F.col(vote) == "A").cast("long").alias("votes_a"),
        F.count_if(F.col(vote) == "B").cast("long").alias("votes_b"),
    )
    fallback = F.when(F.col(key) % 2 == 0, "A").otherwise("B")
    return agg.withColumn(
        "winner",
        F.when(F.col("votes_a") > F.col("votes_b"), "A").when(F.col("votes_b") > F.col("votes_a"), "B").otherwise(fallback),
    ).withColumn("decided_by", F.when(F.col("votes_a") == F.col("votes_b"), "fallback").otherwise("majority"))


def knockout_champion(entrants: DataFrame, key: str, slot: str, score: str) -> DataFrame:
    """Knock-out bracket per ``key``: round r pairs slots (2i, 2i+1); the higher
    ``score`` wins, ties go to A (the earlier slot); an odd entrant out gets a bye.

    A round is one grouping of the entrants by (key, half the slot); dealt by ``key`` once,
    all rounds stay in their partitions. The number of rounds (log2 of the largest field)
    is the only value brought to the driver.
    """
    max_n = entrants.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    cur = entrants.select(key, F.col(slot).cast("long").alias("_slot"), F.col(slot).alias("champion_slot"), F.col(score).alias("_score")).repartition(key)
    rounds = 0
    while (1 << rounds) < max_n:
        side = lambda parity: F.max(F.when(F.col("_slot") % 2 == parity, F.struct("_score", "champion_slot")))
        m = cur.withColumn("_m", F.floor(F.col("_slot") / 2)).groupBy(key, "_m").agg(side(0).alias("_a"), side(1).alias("_b"))
        won = F.when(F.col("_b").isNotNull() & (F.col("_b._score") > F.col("_a._score")), F.col("_b")).otherwise(F.col("_a"))
        cur = m.select(key, F.col("_m").alias("_slot"), won.alias("_w")).select(key, "_slot", "_w.champion_slot", "_w._score")
        rounds += 1
    return cur.select(key, "champion_slot", F.col("_score").alias("champion_score"))


def knockout_by_votes(entrants: DataFrame, key: str, slot: str, votes_for: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Knock-out bracket per ``key``, decided by votes on each match.

    Slots are 0, 1, ... without holes. Round r pairs slots (2i, 2i + 1); ``votes_for`` gets the round's
    matches (key, ``match``, ``a``, ``b``: the entrants' first slots) and returns votes (key, ``match``, ``winner``), any
    number per match. Valid ones are 'A' and 'B'; the majority wins, a tie or no valid vote is settled by a seeded
    draw (``draw_winner``), and an odd entrant out gets a bye. Returns (key, champion, n_votes, n_draws):
    the valid votes cast and the matches drawn on the whole bracket.

    log2 rounds of one grouping and one join, each a plain equi-join on (key, match): a round halves the field. Only the
    largest field's size comes to the driver. Rows with a null key or slot are left out; an empty table has no champions."""
    cur = entrants.filter(F.col(key).isNotNull() & F.col(slot).isNotNull()).select(
        key, F.col(slot).cast("long").alias("_slot"), F.col(slot).cast("long").alias("champion"), F.lit(0).cast("long").alias("n_votes"),
        F.lit(0).cast("long").alias("n_draws"))
    field = cur.agg(F.max("_slot")).first()[0]
    rounds = 0 if field is None else int(field).bit_length()
    for _ in range(rounds):
        side = lambda parity: F.max(F.when(F.col("_slot") % 2 == parity, F.struct("champion", "n_votes", "n_draws")))
        pairs = cur.groupBy(key, F.shiftright("_slot", 1).alias("match")).agg(side(0).alias("_a"), side(1).alias("_b"))
        pairs = materialize(pairs.select(key, "match", "_a", "_b", F.col("_a.champion").alias("a"), F.col("_b.champion").alias("b")))
        cast = votes_for(pairs.filter("b is not null").select(key, "match", "a", "b")).groupBy(key, "match").agg(
            F.count_if(F.col("winner") == "A").cast("long").alias("_va"), F.count_if(F.col("winner") == "B").cast("long").alias("_vb"))
        x = pairs.join(cast, [key, "match"], "left").withColumns({"_va": F.coalesce("_va", F.lit(0)), "_vb": F.coalesce("_vb", F.lit(0))})
        first = F.when(F.col("b").isNull() | (F.col("_va") > F.col("_vb")), True).when(F.col("_vb") > F.col("_va"), False).otherwise(
            draw_winner(F.col(key), F.col("a"), F.col("b")))
        both = lambda c: F.col(f"_a.{c}") + F.coalesce(F.col(f"_b.{c}"), F.lit(0))
        drawn = (F.col("b").isNotNull() & (F.col("_va") == F.col("_vb"))).cast("long")
        cur = x.select(key, F.col("match").alias("_slot"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("champion"),
                       (both("n_votes") + F.col("_va") + F.col("_vb")).alias("n_votes"), (both("n_draws") + drawn).alias("n_draws"))
    return cur.select(key, "champion", "n_votes", "n_draws")


def draw_winner(key: Column, a: Column, b: Column) -> Column:
    """The seeded stand-in for a random pick between two entrants: true for the first. Small factors, so no key overflows
    before it is reduced."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(7919)) * 31 + a * 17 + b * 13, F.lit(2)) == 0


def first_passing(attempts: DataFrame, key: str, attempt: str, passed: Column, payload: list[str]) -> DataFrame:
    """First passing attempt per key; keys with none get a 'No valid response' row."""
    ok = attempts.filter(passed).groupBy(key).agg(
        F.min_by(F.struct(F.col(attempt).alias("attempt"), *[F.col(c) for c in payload]), F.col(attempt)).alias("_b")
    )
    keys = attempts.select(key).distinct()
    out = keys.join(ok, on=key, how="left")
    return out.select(
        key,
        F.col("_b.attempt").alias("attempt"),
        *[F.col(f"_b.{c}").alias(c) for c in payload],
        F.when(F.col("_b").isNull(), "No valid response").otherwise("ok").alias("status"),
    )
