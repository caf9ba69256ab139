"""The daily prize-draw workflow (m6-m10 of the survey) for batches of requests.

The reference handles one request at a time inside PL/pgSQL functions and
route handlers; here a batch of requests is applied to the candidate and
winner tables in one job.  Requests carry an explicit order column ``seq``:
conflicts inside a batch (two requests for one date) go to the first.
Every "first per group" is a grouped minimum plus a join on a unique id.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinse import config as C
from rinse.functions import expr as X
from rinse.operators.ordered import first_per_group, ordinal, running_sum
from rinse.operators.rankings import pick_key
from rinse.sources.sinks import materialise


def backfill_status(winners: DataFrame) -> DataFrame:
    """m6: rows whose status is not APPROVED (NULL-safe) become APPROVED with
    approved_at = COALESCE(approved_at, created_at); approved rows are untouched."""
    touch = ~F.col("status").eqNullSafe(F.lit("APPROVED"))
    return (winners.withColumn("approved_at", F.when(touch, F.coalesce("approved_at", "created_at"))
                               .otherwise(F.col("approved_at")))
                   .withColumn("status", F.lit("APPROVED")))


WINNER_COLS = ["id", "draw_date", "customer_id", "vehicle_reg", "customer_phone", "customer_name",
               "status", "created_at", "approved_at", "note"]


def approve(cands: DataFrame, winners: DataFrame, requests: DataFrame, as_of,
            any_status: bool = False) -> tuple[DataFrame, DataFrame]:
    """m7: approve requested candidates as winners.

    ``requests``: request_id, candidate_id, draw_date (NULL = the candidate's),
    seq, note.  Refused: unknown candidate; a date that already has an
    APPROVED winner (any winner with ``any_status``); a date taken by an
    earlier request of the same batch.  Returns (winners after, refused)."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    c = cands.select(F.col("id").alias("candidate_id"), F.col("draw_date").alias("_cdate"),
                     "customer_id", "vehicle_reg", "customer_phone", "customer_name")
    r = requests.join(c, "candidate_id", "left")
    unknown = r.filter(F.col("_cdate").isNull()).select("request_id", F.lit("candidate not found").alias("reason"))
    r = r.filter(F.col("_cdate").isNotNull()).withColumn("_date", F.coalesce(F.col("draw_date"), F.col("_cdate")))
    taken = winners if any_status else winners.filter(F.col("status") == "APPROVED")
    taken = taken.select(F.col("draw_date").alias("_date")).distinct()
    blocked = r.join(taken, "_date", "left_semi").select(
        "request_id", F.lit("an approved winner already exists for the date").alias("reason"))
    open_ = r.join(taken, "_date", "left_anti")
    firsts = first_per_group(open_, ["_date"], ["seq", "request_id"], ["request_id"]) \
        .select(F.col("request_id").alias("_win"))
    ok = open_.join(firsts, open_["request_id"] == firsts["_win"], "left_semi")
    lost = open_.join(firsts, open_["request_id"] == firsts["_win"], "left_anti").select(
        "request_id", F.lit("date already taken in this batch").alias("reason"))
    new = ok.select(F.col("candidate_id").alias("id"), F.col("_date").alias("draw_date"), "customer_id",
                    "vehicle_reg", "customer_phone", "customer_name", F.lit("APPROVED").alias("status"),
                    now.alias("created_at"), now.alias("approved_at"),
                    (F.col("note") if "note" in requests.columns else F.lit(None).cast("string")).alias("note"))
    after = winners.select(*WINNER_COLS).unionByName(new.select(*WINNER_COLS))
    return after, unknown.unionByName(blocked).unionByName(lost)


#: candidates and requests of one person that are replayed in one place
REPLAY_MOST = 20_000


def reschedule(cands: DataFrame, requests: DataFrame, replay_most: int = REPLAY_MOST) -> tuple[DataFrame, DataFrame]:
    """m8: move candidates to new dates, one request after the other.

    ``requests``: candidate_id, new_date, seq (ties: candidate_id, new_date).
    Refused: no candidate or date given; unknown candidate; another candidate
    of the same customer (NULL-safe) and plate key on the new date *at that
    moment*, so an earlier move of the batch may free a date or take it.
    Returns (candidates after, refused requests).

    A request depends only on earlier ones of the same person.  Persons of at
    most ``replay_most`` rows are replayed request by request (``_replayed``).
    For larger ones all requests are first taken as granted; each round
    recomputes every decision from the dates the others then hold, until no
    decision changes.  After k rounds the first k requests of each person are
    right, so the fixed point is the sequential result.  It is reached after as
    many rounds as requests hang on one another; persons whose decisions no
    longer change leave the loop."""
    person = ["_cust", "_rk"]
    known = cands.select(F.col("id").alias("candidate_id"), F.col("draw_date").alias("_from"),
                         F.coalesce(F.col("customer_id").cast("string"), F.lit("\u0000")).alias("_cust"),
                         X.regkey("vehicle_reg").alias("_rk"))
    asked = requests.select("candidate_id", "new_date", "seq")
    given = F.col("candidate_id").isNotNull() & F.col("new_date").isNotNull()
    blank = asked.filter(~given).select("candidate_id", "new_date", F.lit("candidate_id and new_date are required").alias("reason"))
    unknown = (asked.filter(given).join(known, "candidate_id", "left_anti")
               .select("candidate_id", "new_date", F.lit("candidate not found").alias("reason")))
    valid = materialise(asked.filter(given).join(known, "candidate_id").drop("_from"), "valid")
    known = materialise(known.filter("candidate_id IS NOT NULL"), "known")
    # an id that several persons bear ties them together
    who = F.struct(*person)
    tied = known.groupBy("candidate_id").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).filter("lo <> hi")
    tied = known.join(tied, "candidate_id", "left_semi").select(*person)
    large = (known.select(*person).unionAll(valid.select(*person)).groupBy(*person).agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > replay_most).select(*person))
    large = materialise(large.unionAll(tied).distinct(), "large")
    of = lambda df, how: df.join(large, person, how)

    settled = [_replayed(of(known, "left_anti"), of(valid, "left_anti"), person)]
    if not large.isEmpty():
        settled += _settled_by_rounds(of(known, "left_semi"), of(valid, "left_semi"), person)
    final = materialise(reduce(DataFrame.unionByName, settled), "decided")
    refused = final.filter("NOT ok").select("candidate_id", "new_date", F.lit("same candidate already on the new date").alias("reason"))
    last = final.filter("ok").groupBy(F.col("candidate_id").alias("_mid")).agg(F.max_by("new_date", "no").alias("_mdate"))
    after = (cands.join(last, cands["id"] == last["_mid"], "left")
             .withColumn("draw_date", F.coalesce(F.col("_mdate"), F.col("draw_date"))).drop("_mid", "_mdate"))
    return after, blank.unionByName(unknown).unionByName(refused)


def _replayed(held: DataFrame, valid: DataFrame, person: list[str]) -> DataFrame:
    """``no, candidate_id, new_date, ok``: the requests of each person decided in order, on the list of the person's candidates and dates.

    A fold over the sorted requests; candidates and dates stand in it by their
    places in the person's lists, with the number of candidates on each date."""
    asked = valid.groupBy(*person).agg(F.array_sort(F.collect_list(F.struct("seq", "candidate_id", "new_date"))).alias("_asked"))
    lists = asked.join(held.groupBy(*person).agg(F.collect_list(F.struct("candidate_id", "_from")).alias("_held")), person)
    lists = (lists.withColumn("_ids", F.col("_held.candidate_id"))
             .withColumn("_days", F.array_distinct(F.array_compact(F.concat(F.col("_held._from"), F.col("_asked.new_date"))))))
    lists = lists.selectExpr("_asked", "_days", "transform(_held, h -> CAST(array_position(_days, h._from) AS INT)) AS _at",
                             "transform(_asked, a -> struct(CAST(array_position(_ids, a.candidate_id) AS INT) AS c, CAST(array_position(_days, a.new_date) AS INT) AS d)) AS _moves")
    # places count from 1; a candidate without a date is on none
    there = lists.selectExpr("_asked", "_moves", "_at", "transform(_days, (x, j) -> size(filter(_at, v -> v = j + 1))) AS _on")
    ok = "s.on[m.d - 1] = CAST(coalesce(s.at[m.c - 1] = m.d, false) AS INT)"
    fold = f"""aggregate(_moves, struct(_at AS at, _on AS on, CAST(array() AS array<boolean>) AS ok), (s, m) ->
        CASE WHEN {ok}
        THEN struct(transform(s.at, (v, j) -> CASE WHEN j + 1 = m.c THEN m.d ELSE v END) AS at,
                    transform(s.on, (v, j) -> v + CAST(j + 1 = m.d AS INT) - CAST(coalesce(j + 1 = s.at[m.c - 1], false) AS INT)) AS on,
                    concat(s.ok, array(true)) AS ok)
        ELSE struct(s.at AS at, s.on AS on, concat(s.ok, array(false)) AS ok) END, s -> s.ok)"""
    decided = there.selectExpr("_asked", f"{fold} AS _ok")
    return decided.selectExpr("posexplode(_asked) AS (i, a)", "_ok").selectExpr("CAST(i AS BIGINT) AS no", "a.candidate_id", "a.new_date", "_ok[i] AS ok")


def _settled_by_rounds(known: DataFrame, valid: DataFrame, person: list[str]) -> list[DataFrame]:
    """The decisions of ``_replayed`` for persons of any size, found round by round."""
    cols = ["no", "candidate_id", "new_date", "ok"]
    moves = materialise(ordinal(valid, [], ["seq", "candidate_id", "new_date"], out="no")
                        .select("no", "candidate_id", *person, "new_date", F.lit(True).alias("ok")), "moves")
    held = materialise(known.join(moves.select(*person).distinct(), person, "left_semi"), "held")
    settled: list[DataFrame] = []
    while True:
        judged = materialise(_judge_moves(held, moves, person), "judged")
        unsure = judged.filter("ok <> was_ok").select(*person).distinct()
        settled.append(judged.join(unsure, person, "left_anti").select(*cols))
        moves = judged.join(unsure, person, "left_semi").drop("was_ok")
        if unsure.isEmpty():
            return settled
        held = held.join(unsure, person, "left_semi")


def _judge_moves(held: DataFrame, moves: DataFrame, person: list[str]) -> DataFrame:
    """``moves`` with ``ok`` decided anew (the old one in ``was_ok``): is the new date free of the person's other candidates, if the old decisions hold?"""
    stay = held.select("candidate_id", *person, F.col("_from").alias("new_date"), F.lit(0).cast("bigint").alias("no"), F.lit(True).alias("ok"))
    before = Window.partitionBy("candidate_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    rows = stay.unionByName(moves.select(*stay.columns)).withColumn("_at", F.last(F.when(F.col("ok"), F.col("new_date")), ignorenulls=True).over(before))
    # who is on a date: arrivals and departures in request order; a request looks before its own take effect
    step = lambda date, kind, v: F.struct(F.col(date).alias("date"), F.lit(kind).alias("kind"), F.lit(v).cast("bigint").alias("v"))
    steps = rows.withColumn("_s", F.explode(F.array_compact(F.array(
        F.when(F.col("no") > 0, step("new_date", 0, 0)), F.when(F.col("ok"), step("new_date", 1, 1)),
        F.when(F.col("ok") & (F.col("no") > 0), step("_at", 1, -1))))))
    there = running_sum(steps.select("*", "_s.*").drop("_s"), [*person, "date"], ["no", "kind", "v"], F.col("v"), out="_on")
    others = F.col("_on") - F.col("_at").eqNullSafe(F.col("new_date")).cast("bigint")
    return there.filter("kind = 0").select("no", "candidate_id", *person, "new_date", (others == 0).alias("ok"), F.col("ok").alias("was_ok"))


def revoke(winners: DataFrame, requests: DataFrame, mode: str = "status") -> tuple[DataFrame, DataFrame]:
    """m9: revoke winners.

    ``mode="status"`` (the SQL function): ``requests`` has winner_id, reason,
    seq; status becomes REVOKED and every given reason is appended to the note
    in request order.  ``mode="delete"`` (the route): ``requests`` has
    draw_date; all winners of those dates are removed.  Returns (winners
    after, refused requests)."""
    if mode == "delete":
        dates = requests.select("draw_date").distinct()
        refused = dates.join(winners.select("draw_date"), "draw_date", "left_anti") \
            .withColumn("refusal", F.lit("no winner found for that date"))
        return winners.join(dates, "draw_date", "left_anti"), refused
    known = winners.select(F.col("id").alias("winner_id"))
    refused = requests.join(known, "winner_id", "left_anti").withColumn("refusal", F.lit("winner not found"))
    tail = F.when(F.col("reason").isNotNull(), F.concat(F.lit(C.REVOCATION_PREFIX), F.col("reason"))) \
        .otherwise(F.lit(""))
    # the note gains every given reason, in request order (an ordered string aggregate)
    per = (requests.join(known, "winner_id", "left_semi").withColumn("_t", tail)
           .groupBy("winner_id")
           .agg(F.expr("listagg(_t, '') WITHIN GROUP (ORDER BY seq)").alias("_tail")))
    j = winners.join(per, winners["id"] == per["winner_id"], "left")
    hit = F.col("winner_id").isNotNull()
    out = (j.withColumn("status", F.when(hit, F.lit("REVOKED")).otherwise(F.col("status")))
             .withColumn("note", F.when(hit, F.concat(F.coalesce(F.col("note"), F.lit("")), F.col("_tail")))
                         .otherwise(F.col("note")))
             .drop("winner_id", "_tail"))
    return out, refused


def auto_draw(dates: DataFrame, eligibles_by_month: DataFrame, winners: DataFrame, seed: str,
              as_of=None) -> DataFrame:
    """m10: for each date without any winner, pick one of that month's eligibles
    (uniform, repeatable) and add it as a winner; existing winners are kept.

    ``eligibles_by_month`` is the at most 200 per month of ``eligibles_by_month``,
    so the date x eligible join is bounded by 31 x 200 rows per month."""
    now = F.lit(str(as_of or dt.datetime(2000, 1, 1))).cast("timestamp_ntz")
    open_dates = (dates.select("draw_date").distinct()
                  .join(winners.select("draw_date"), "draw_date", "left_anti")
                  .withColumn("month", F.trunc("draw_date", "MM")))
    pool = open_dates.join(eligibles_by_month, "month")
    picked = first_per_group(pool.withColumn("_pick", pick_key(["customer_id"], "draw_date", seed)),
                             ["draw_date"], ["_pick", "customer_id"],
                             ["customer_id", "vehicle_reg", "customer_phone", "customer_name"])
    new = picked.select((-F.datediff(F.col("draw_date"), F.lit(dt.date(1970, 1, 1)))).cast("bigint").alias("id"),
                        "draw_date", "customer_id", "vehicle_reg", "customer_phone", "customer_name",
                        F.lit("APPROVED").alias("status"), now.alias("created_at"),
                        F.lit(None).cast("timestamp_ntz").alias("approved_at"),
                        F.lit(None).cast("string").alias("note"))
    return winners.select(*WINNER_COLS).unionByName(new.select(*WINNER_COLS))
