"""The SQL every registered query must equal, over the given tables."""

from __future__ import annotations

import re

DAY_US = 86_400_000_000
CHANNELS = ("view", "click", "signup", "purchase", "error")
STATS = ("mean", "last", "min", "max")
FEATURES = [f"{c}_{s}" for c in CHANNELS for s in STATS] + ["sedated_flag"]
DROPPED = ("purchase_min", "purchase_max", "error_min", "error_max")
KEPT = [f for f in FEATURES if f not in DROPPED]
FINAL = [*KEPT, "age", "gender_M", "gender_F"]

SQL: dict[str, str] = {}


def rounded(expression: str) -> str:
    """Six decimal places, halves away from zero.

    Goes through nine decimal places as a decimal, so that a mean that lies
    exactly half way does not depend on the last bit of a sum.
    """
    return f"CAST(round(CAST({expression} AS DECIMAL(38, 9)), 6) AS DOUBLE)"


def r(expression: str, name: str | None = None) -> str:
    """A rounded column; ``name`` defaults to the expression."""
    return f"{rounded(expression)} AS {name or expression}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


# Named sub-queries, in the order they build on each other.

CTE: dict[str, str] = {
    "v_patients": """
        SELECT c_custkey AS subject_id, CAST(c_custkey * 7 % 90 AS INT) AS anchor_age,
               CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender
        FROM customer""",
    "v_admissions": """
        SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
               CASE WHEN o_orderstatus = 'F'
                    THEN d0 + CAST(o_orderkey % 40 AS INT) * INTERVAL 1 DAY END AS deathtime
        FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS d0 FROM lineitem GROUP BY 1)
             ON l_orderkey = o_orderkey""",
    "v_icustays": """
        SELECT o_custkey AS subject_id, l_orderkey AS hadm_id,
               l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS stay_id,
               min(l_shipdate) AS intime,
               min(l_shipdate) + CAST(max(l_quantity) * 20 AS INT) * INTERVAL 1 HOUR AS outtime
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "merged": """
        SELECT a.subject_id, a.hadm_id, a.deathtime, p.anchor_age, p.gender,
               s.stay_id, s.intime, s.outtime,
               (epoch_us(s.outtime) - epoch_us(s.intime)) / 3600000000.0 AS icu_los_hours
        FROM v_admissions a JOIN v_patients p USING (subject_id)
             JOIN v_icustays s ON s.subject_id = a.subject_id AND s.hadm_id = a.hadm_id""",
    "v_readings": """
        SELECT user_id AS stay_id, ts, event_type AS channel, value, event_id,
               epoch_us(ts) // 1000000 AS sec
        FROM events""",
    "v_stays": """
        SELECT user_id AS stay_id, user_id AS subject_id, date_trunc('day', min(ts)) AS intime,
               max(ts) AS outtime,
               CASE WHEN user_id % 3 = 0
                    THEN max(ts) - CAST(user_id % 10 AS INT) * INTERVAL 1 DAY END AS deathtime
        FROM events GROUP BY 1, 2""",
    "v_scores": """
        SELECT l_linestatus AS model, l_orderkey AS subject_id, l_linenumber AS obs_start_hour,
               l_partkey AS tiebreak, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
               round((l_quantity + l_orderkey % 50) / 101.0, 4) AS y_prob
        FROM lineitem""",
    "flagged": """
        SELECT r.*, CASE WHEN channel = 'purchase' THEN
                 CASE WHEN EXISTS (SELECT 1 FROM v_readings c
                                   WHERE c.channel = 'signup' AND c.stay_id = r.stay_id
                                     AND abs(c.sec - r.sec) <= 14400) THEN 1 ELSE 0 END
               END AS sedated_flag
        FROM v_readings r""",
    "st": f"""
        SELECT *, coalesce(deathtime, outtime) AS obs_end,
               least(CAST(ceil((epoch_us(outtime) - epoch_us(intime)) / {DAY_US}.0) AS INT),
                     CAST(ceil((epoch_us(coalesce(deathtime, outtime)) - epoch_us(intime))
                               / {DAY_US}.0) AS INT)) AS n
        FROM v_stays""",
    "daily": """
        SELECT stay_id, date_trunc('day', ts) AS ts, channel, value FROM v_readings WHERE stay_id % 5 <> 0""",
    "spine": """
        SELECT subject_id, stay_id, CAST(b AS INT) AS bin,
               intime + CAST(b AS INT) * INTERVAL 1 DAY AS bin_start,
               least(intime + CAST(b + 1 AS INT) * INTERVAL 1 DAY, obs_end) AS bin_end
        FROM (SELECT *, unnest(range(0, n)) AS b FROM st WHERE n > 0)""",
    "inside": f"""
        SELECT f.*, CASE WHEN f.ts < s.obs_end
                          AND (epoch_us(f.ts) - epoch_us(s.intime)) // {DAY_US} < s.n
                         THEN CAST((epoch_us(f.ts) - epoch_us(s.intime)) // {DAY_US} AS INT)
                    END AS bin
        FROM flagged f JOIN st s USING (stay_id)
        WHERE f.ts BETWEEN s.intime AND s.outtime""",
    "present": """
        SELECT stay_id FROM inside GROUP BY 1 HAVING count(DISTINCT channel) = 5""",
    "agg": "SELECT stay_id, bin, "
    + ", ".join(
        f"avg(value) FILTER (channel = '{c}') AS {c}_mean, "
        f"arg_max(value, ROW(ts, event_id)) FILTER (channel = '{c}' AND value IS NOT NULL)"
        f" AS {c}_last, "
        f"min(value) FILTER (channel = '{c}') AS {c}_min, "
        f"max(value) FILTER (channel = '{c}') AS {c}_max"
        for c in CHANNELS
    )
    + """, CASE WHEN count(value) FILTER (channel = 'purchase') > 0
                THEN CAST(max(sedated_flag) FILTER (channel = 'purchase') AS INT)
           END AS sedated_flag
        FROM inside WHERE bin IS NOT NULL GROUP BY 1, 2""",
    "bins": f"""
        SELECT s.*, {", ".join("a." + f for f in FEATURES)},
               {" + ".join(f"(a.{f} IS NOT NULL)::INT" for f in FEATURES)} AS filled
        FROM spine s SEMI JOIN present USING (stay_id)
             LEFT JOIN agg a ON a.stay_id = s.stay_id AND a.bin = s.bin""",
    "starts": """
        SELECT subject_id, stay_id, CAST(w AS INT) AS window_id, CAST(3 * w AS INT) AS o0,
               CAST(3 * w + 5 AS INT) AS o1, CAST(3 * w + 7 AS INT) AS p1
        FROM (SELECT stay_id, min(subject_id) AS subject_id,
                     unnest(range(0, greatest(0, (max(bin) + 1 - 7) // 3 + 1))) AS w
              FROM bins GROUP BY stay_id HAVING max(bin) + 1 >= 7)""",
    "bounded": """
        SELECT w.*, s.intime, s.deathtime, s.intime + o0 * INTERVAL 1 DAY AS obs_start,
               s.intime + o1 * INTERVAL 1 DAY AS obs_end,
               s.intime + p1 * INTERVAL 1 DAY AS pred_end
        FROM starts w JOIN v_stays s USING (stay_id)""",
    "labelled": """
        SELECT *, coalesce(deathtime BETWEEN obs_start AND obs_end, false) AS removed,
               CASE WHEN deathtime BETWEEN obs_start AND obs_end THEN 0
                    WHEN deathtime BETWEEN obs_end AND pred_end THEN 1
                    WHEN deathtime > pred_end AND deathtime <= pred_end + INTERVAL 2 DAY THEN 1
                    ELSE 0 END AS label,
               CASE WHEN deathtime BETWEEN obs_end AND pred_end THEN 1 ELSE 0 END AS label_plain
        FROM bounded""",
    "candidates": f"""
        SELECT l.*, {5 * len(FEATURES)} AS total_values,
               {5 * len(FEATURES)} - coalesce(c.filled, 0) AS missing_values,
               coalesce(c.filled, 0) / {5.0 * len(FEATURES)} AS obs_completeness
        FROM labelled l LEFT JOIN
             (SELECT w.stay_id, w.window_id, sum(b.filled) AS filled
              FROM starts w JOIN bins b ON b.stay_id = w.stay_id AND b.bin >= o0 AND b.bin < o1
              GROUP BY 1, 2) c ON c.stay_id = l.stay_id AND c.window_id = l.window_id""",
    "windows": """
        SELECT * FROM candidates
        WHERE NOT removed AND (label = 1 OR obs_completeness >= 0.3)""",
    "steps": f"""
        SELECT w.subject_id, w.stay_id, w.window_id, w.label, w.o0,
               CAST(k AS INT) AS step, {", ".join(FEATURES)}
        FROM (SELECT *, unnest(range(0, 5)) AS k FROM windows) w
             LEFT JOIN bins b ON b.stay_id = w.stay_id AND b.bin = w.o0 + k""",
    "cells": f"""
        SELECT subject_id, stay_id, window_id, label, step,
               unnest({list(range(len(FEATURES)))}) AS pos,
               unnest([{", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES)}]) AS value
        FROM steps""",
    "statics": """
        SELECT s.subject_id, s.stay_id, p.anchor_age AS age,
               CAST(p.gender = 'M' AS INT) AS gender_M, CAST(p.gender = 'F' AS INT) AS gender_F
        FROM v_stays s JOIN v_patients p USING (subject_id)""",
    "final_cells": f"""
        SELECT s.stay_id, s.window_id, s.label AS y, s.step,
               unnest({list(range(len(FINAL)))}) AS pos,
               unnest([{", ".join(f"CAST({f} AS FLOAT)" for f in FINAL)}]) AS value
        FROM steps s LEFT JOIN statics t ON t.subject_id = s.subject_id AND t.stay_id = s.stay_id
        """,
    "subjects": """
        SELECT subject_id, max(label) AS subject_label, count(*) AS n_windows,
               sum(label) AS n_positive
        FROM windows GROUP BY 1""",
    "balance": """
        SELECT count(*) AS n_subjects, count(*) FILTER (subject_label = 0) AS neg,
               count(*) FILTER (subject_label = 1) AS pos, sum(n_windows) AS n_windows,
               sum(n_positive) AS n_positive
        FROM subjects""",
    "by_class": """
        SELECT *, row_number() OVER (PARTITION BY subject_label
                                     ORDER BY md5('42|' || subject_id)) AS rk,
               count(*) OVER (PARTITION BY subject_label) AS sz
        FROM subjects""",
    "tested": """
        SELECT subject_id, subject_label, rk <= floor(sz * 0.2::DOUBLE + 0.5) AS tst
        FROM by_class""",
    "splits": """
        SELECT subject_id, subject_label,
               CASE WHEN tst THEN 'test'
                    WHEN row_number() OVER (PARTITION BY tst ORDER BY md5('42v|' || subject_id))
                         <= ceil(count(*) OVER (PARTITION BY tst) * 0.2::DOUBLE) THEN 'val'
                    ELSE 'train' END AS split
        FROM tested""",
    "clean_cells": "SELECT * REPLACE (coalesce(value, 0.0) AS value) FROM cells",
    "scaler": """
        SELECT pos, avg(value) AS mean,
               CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS std
        FROM clean_cells GROUP BY 1""",
    "scaled": """
        SELECT c.* REPLACE ((c.value - s.mean) / s.std AS value)
        FROM clean_cells c JOIN scaler s USING (pos)""",
    "counted": """
        SELECT model, y_prob, count(*) FILTER (y_true = 1) AS pos,
               count(*) FILTER (y_true = 0) AS neg
        FROM v_scores GROUP BY 1, 2""",
    "totals": """
        SELECT *, sum(pos) OVER d AS cum_pos, sum(neg) OVER d AS cum_neg,
               sum(pos) OVER (PARTITION BY model) AS all_pos,
               sum(neg) OVER (PARTITION BY model) AS all_neg,
               lead(pos) OVER d AS next_pos, lead(neg) OVER d AS next_neg,
               row_number() OVER d AS place
        FROM counted
        WINDOW d AS (PARTITION BY model ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING)""",
    "pr": """
        SELECT *, CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg) AS p,
               CAST(cum_pos AS DOUBLE) / all_pos AS rc
        FROM totals""",
    "f1s": "SELECT *, p * rc * 2 / (p + rc + 1e-8) AS f1 FROM pr",
    "best": """
        SELECT model, y_prob AS threshold FROM
          (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, y_prob) AS k
           FROM f1s WHERE rc >= 0.3) WHERE k = 1""",
    "confused": """
        SELECT model, threshold, count(*) FILTER (y_true = 0 AND y_prob < threshold) AS tn,
               count(*) FILTER (y_true = 0 AND y_prob >= threshold) AS fp,
               count(*) FILTER (y_true = 1 AND y_prob < threshold) AS fn,
               count(*) FILTER (y_true = 1 AND y_prob >= threshold) AS tp
        FROM v_scores JOIN best USING (model) GROUP BY 1, 2""",
    "auc": """
        SELECT model, sum(neg * (2 * (cum_pos - pos) + pos))::DOUBLE
                      / (2.0::DOUBLE * max(all_pos) * max(all_neg)) AS auc_roc,
               sum(pos * CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg)) / max(all_pos) AS auc_pr
        FROM totals GROUP BY 1""",
    "measured": """
        SELECT model, auc_roc, auc_pr,
               coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
               coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS "precision",
               coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
               coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity,
               coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS npv,
               coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS alarm_rate,
               threshold AS threshold_optimal, tn, fp, fn, tp
        FROM confused JOIN auc USING (model)""",
    "timeline": """
        SELECT *, row_number() OVER t AS place,
               count(*) OVER (PARTITION BY model, subject_id) AS hour_count
        FROM v_scores
        WINDOW t AS (PARTITION BY model, subject_id ORDER BY obs_start_hour, tiebreak, y_prob)""",
    "trend": """
        SELECT model, subject_id, max(hour_count) AS hour_count,
               avg(y_prob) FILTER (place <= hour_count // 2) AS early_mean,
               avg(y_prob) FILTER (place > hour_count // 2) AS late_mean
        FROM timeline GROUP BY 1, 2""",
    "trends": """
        SELECT *, CASE WHEN hour_count < 3 THEN 'stable'
                       WHEN late_mean > early_mean + 0.1::DOUBLE THEN 'increasing'
                       WHEN late_mean < early_mean - 0.1::DOUBLE THEN 'decreasing'
                       ELSE 'stable' END AS risk_trend
        FROM trend""",
    "risk": """
        SELECT model, subject_id, max(y_prob) AS max_risk, avg(y_prob) AS avg_risk,
               min(y_prob) AS min_risk, count(*) AS hour_count,
               min(obs_start_hour) AS first_hour, max(obs_start_hour) AS latest_hour,
               max(y_true) AS mortality_outcome
        FROM v_scores GROUP BY 1, 2""",
    "importance": """
        SELECT model, pos, v * o AS score
        FROM (SELECT pos, var_pop(value) AS v FROM cells GROUP BY 1),
             (SELECT model, var_samp(ln(p / (1 - p))) AS o
              FROM (SELECT model, least(greatest(y_prob, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p
                    FROM v_scores) GROUP BY 1)""",
    "filled_forward": "SELECT subject_id, bin, "
    + ", ".join(
        f"last_value({f} IGNORE NULLS) OVER "
        f"(PARTITION BY subject_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS {f}"
        for f in FEATURES
    )
    + " FROM bins",
    "overall": "SELECT " + ", ".join(f"avg({f}) AS {f}" for f in FEATURES) + " FROM bins",
    "imputed": "SELECT f.subject_id, f.bin, "
    + ", ".join(
        f"coalesce(f.{f}, avg(f.{f}) OVER (PARTITION BY f.subject_id), o.{f}) AS {f}"
        for f in FEATURES
    )
    + " FROM filled_forward f, overall o",
    "one_a_day": """
        SELECT stay_id, channel, date_trunc('day', ts) AS day, arg_max(ts, ROW(ts, event_id)) AS ts,
               arg_max(value, ROW(ts, event_id)) AS value
        FROM events_named GROUP BY 1, 2, 3""",
    "events_named": """
        SELECT user_id AS stay_id, event_type AS channel, ts, value, event_id FROM events""",
}


def _used(body: str) -> list[str]:
    """Sub-queries a statement needs, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in found and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(CTE[name])
                if name not in found:
                    found.append(name)

    visit(body)
    return found


def add(name: str, body: str) -> None:
    parts = [f"{n} AS ({CTE[n]})" for n in _used(body)]
    SQL[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# Cohort


def _cohort(first: str) -> str:
    return f"""
        SELECT subject_id, hadm_id, stay_id, anchor_age AS age,
               CAST(gender = 'F' AS INT) AS gender_F, CAST(gender = 'M' AS INT) AS gender_M,
               intime, outtime, deathtime, {r("icu_los_hours")}
        FROM ({first})
        WHERE icu_los_hours BETWEEN 24 AND 720 AND (deathtime IS NULL OR deathtime <= outtime)"""


_COLUMNS = (
    "hadm_id", "stay_id", "anchor_age", "gender", "intime", "outtime", "deathtime", "icu_los_hours",
)
_FIRST_VALUES = (
    "SELECT subject_id, count(*) AS n, "
    + ", ".join(
        f"arg_min({c}, ROW(intime, stay_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in _COLUMNS
    )
    + " FROM merged WHERE anchor_age >= 18 GROUP BY 1"
)
_FIRST_ROWS = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
                                                ORDER BY intime, stay_id) AS rn
                   FROM merged WHERE anchor_age >= 18) WHERE rn = 1"""
add("cohort_select", _cohort(_FIRST_VALUES))
add("cohort_first_row", _cohort(_FIRST_ROWS))
add(
    "cohort_attrition",
    f"""
    SELECT 1 AS step_no, 'adults' AS step, count(*) AS n_rows, NULL::DOUBLE AS event_rate
    FROM v_patients WHERE anchor_age >= 18
    UNION ALL SELECT 2, 'merged', CAST(sum(n) AS BIGINT), NULL FROM ({_FIRST_VALUES})
    UNION ALL SELECT 3, 'first_stays', count(*), NULL FROM ({_FIRST_VALUES})
    UNION ALL SELECT 4, 'stay_length', count(*), NULL FROM ({_FIRST_VALUES})
              WHERE icu_los_hours BETWEEN 24 AND 720
    UNION ALL SELECT 5, 'event_end', count(*),
                     CAST(round(CAST(avg((deathtime IS NOT NULL)::INT) AS DECIMAL(38, 9)), 6) AS DOUBLE) FROM ({_FIRST_VALUES})
              WHERE icu_los_hours BETWEEN 24 AND 720
                AND (deathtime IS NULL OR deathtime <= outtime)""",
)
add("join_dimensions", f"SELECT * REPLACE ({r('icu_los_hours')}) FROM merged")
add(
    "one_hot",
    """SELECT *, CAST(gender = 'F' AS INT) AS gender_F, CAST(gender = 'M' AS INT) AS gender_M
       FROM v_patients""",
)

# Cleaning

_R = "stay_id, ts, channel, CAST(round(CAST(value AS DECIMAL(38, 9)), 6) AS DOUBLE) AS value, event_id"
add("channel_filter", f"SELECT {_R} FROM v_readings WHERE channel IN ('view', 'error')")
add(
    "clip_range",
    f"SELECT {_R} FROM v_readings WHERE channel = 'view' AND value > 1 AND value < 20",
)
add(
    "clip_range_right",
    f"SELECT {_R} FROM v_readings WHERE channel = 'view' AND value > 0 AND value <= 20",
)
add(
    "convert_units",
    f"""SELECT {_R} FROM (SELECT * REPLACE (CASE WHEN channel = 'error'
                            THEN (value - 32.0::DOUBLE) / 1.8::DOUBLE ELSE value END AS value)
                          FROM v_readings WHERE channel IN ('view', 'error'))
        WHERE value BETWEEN -15 AND 20""",
)
add(
    "clean_channel",
    f"""SELECT stay_id, ts, {r("value")}, event_id FROM v_readings WHERE channel = 'view' AND value BETWEEN 1 AND 20
        AND stay_id IN (SELECT stay_id FROM v_stays WHERE deathtime IS NOT NULL)""",
)
add(
    "trim_quantiles",
    f"""SELECT {_R} FROM v_readings,
          (SELECT min(value) FILTER (share >= 0.01::DOUBLE) AS lo,
                  min(value) FILTER (share >= 0.99::DOUBLE) AS hi
           FROM (SELECT value, cume_dist() OVER (ORDER BY value) AS share
                 FROM v_readings WHERE channel = 'view'))
        WHERE channel = 'view' AND value BETWEEN lo AND hi""",
)
add(
    "restrict_to_cohort",
    f"""SELECT {_R} FROM v_readings
        WHERE stay_id IN (SELECT subject_id FROM ({_cohort(_FIRST_VALUES)}))""",
)


def _near(channel: str, tolerance: int) -> str:
    return f"""EXISTS (SELECT 1 FROM v_readings c WHERE c.channel = '{channel}'
               AND c.stay_id = v.stay_id AND abs(c.sec - v.sec) <= {tolerance})"""


add(
    "low_with_context",
    f"""SELECT DISTINCT {_R} FROM v_readings v WHERE channel = 'view' AND
        (value > 3 OR {_near("signup", 86400)}
         OR EXISTS (SELECT 1 FROM v_readings c WHERE c.channel = 'error'
                    AND c.stay_id = v.stay_id AND c.ts = v.ts))""",
)
add(
    "keep_if_near",
    f"SELECT {_R} FROM v_readings v WHERE channel = 'click' AND {_near('signup', 86400)}",
)
add(
    "flag_near",
    f"""SELECT {_R}, CASE WHEN {_near("signup", 14400)} THEN 1 ELSE 0 END AS sedated_flag
        FROM v_readings v WHERE channel = 'purchase'""",
)
add(
    "semi_same_instant",
    f"""SELECT {_R}, date_trunc('day', ts) AS day FROM v_readings v WHERE channel = 'view'
        AND EXISTS (SELECT 1 FROM v_readings c WHERE c.channel = 'error'
                    AND c.stay_id = v.stay_id
                    AND date_trunc('day', c.ts) = date_trunc('day', v.ts))""",
)
add(
    "distinct_instants",
    """SELECT DISTINCT stay_id, date_trunc('day', ts) AS day
       FROM v_readings WHERE channel = 'signup'""",
)
add(
    "union_distinct",
    """SELECT DISTINCT stay_id, channel, date_trunc('day', ts) AS day
       FROM v_readings WHERE channel IN ('view', 'click', 'error')""",
)
_ROLLED = """
    SELECT stay_id, ts, channel, value, event_id,
           stddev_samp(value) OVER (PARTITION BY stay_id ORDER BY sec
                                    RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS rolling_std
    FROM v_readings WHERE channel = 'view'"""
add("rolling_stddev", f"SELECT {_R}, {r('rolling_std')} FROM ({_ROLLED})")
add(
    "flag_flatline",
    f"""SELECT {_R}, {r('rolling_std')}, rolling_std < 5 AS is_flat,
               NOT (rolling_std < 5) AS is_valid FROM ({_ROLLED})""",
)


def _component(name: str, primary: str, fallback: str, mode: str = "filter") -> str:
    ranged = "AND value BETWEEN 1 AND 60" if mode == "filter" else ""
    checked = "value BETWEEN 1 AND 60 AND" if mode == "flag" else ""
    return f"""
        SELECT stay_id, day, CASE WHEN ok AND pv IS NOT NULL THEN pv ELSE fv END AS final_{name},
               CASE WHEN ok AND pv IS NOT NULL THEN 'IBP' WHEN fv IS NOT NULL THEN 'NIBP'
                    ELSE 'NA' END AS {name}_source
        FROM (SELECT stay_id, day, value AS pv,
                     {checked} NOT (stddev_samp(value) OVER (
                        PARTITION BY stay_id ORDER BY epoch_us(ts) // 1000000
                        RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) < 5) AS ok
              FROM one_a_day WHERE channel = '{primary}' {ranged}) a
             FULL JOIN (SELECT stay_id, day, value AS fv FROM one_a_day
                        WHERE channel = '{fallback}' {ranged}) b USING (stay_id, day)"""


for _name, _mode in (("fuse_sources", "filter"), ("fuse_sources_flagged", "flag")):
    add(
        _name,
        f"""SELECT stay_id, day, {r("final_sbp")}, sbp_source
            FROM ({_component("sbp", "view", "click", _mode)})""",
    )
add(
    "combine_components",
    f"""SELECT stay_id, day, {r("final_sbp")}, sbp_source, {r("final_dbp")}, dbp_source,
               CAST(round(CAST(coalesce(final_map, (final_dbp * 2 + final_sbp) / 3.0::DOUBLE) AS DECIMAL(38, 9)), 6) AS DOUBLE)
                   AS final_map, map_source
        FROM ({_component("sbp", "view", "click")})
             FULL JOIN ({_component("dbp", "click", "signup")}) USING (stay_id, day)
             FULL JOIN ({_component("map", "error", "purchase")}) USING (stay_id, day)""",
)



def _fused(name: str, primary: str, fallback: str, mode: str) -> str:
    ranged = "AND value BETWEEN 1 AND 60" if mode == "filter" else ""
    checked = "value BETWEEN 1 AND 60 AND" if mode == "flag" else ""
    return f"""
        SELECT stay_id, ts, CASE WHEN ok AND pv IS NOT NULL THEN pv ELSE fv END AS final_{name},
               CASE WHEN ok AND pv IS NOT NULL THEN 'IBP' WHEN fv IS NOT NULL THEN 'NIBP' ELSE 'NA' END AS {name}_source
        FROM (SELECT stay_id, ts, value AS pv,
                     {checked} NOT (stddev_samp(value) OVER (PARTITION BY stay_id ORDER BY epoch_us(ts) // 1000000
                                                             RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) < 5) AS ok
              FROM daily WHERE channel = '{primary}' {ranged}) a
             FULL JOIN (SELECT stay_id, ts, value AS fv FROM daily WHERE channel = '{fallback}' {ranged}) b USING (stay_id, ts)"""


for _name, _mode in (("clean_pressure", "filter"), ("clean_pressure_flagged", "flag")):
    add(
        _name,
        f"""SELECT stay_id, ts, {r("final_sbp")}, sbp_source, {r("final_dbp")}, dbp_source,
               CAST(round(CAST(coalesce(final_map, (final_dbp * 2 + final_sbp) / 3.0::DOUBLE) AS DECIMAL(38, 9)), 6) AS DOUBLE)
                   AS final_map, map_source
        FROM ({_fused("sbp", "view", "click", _mode)}) FULL JOIN ({_fused("dbp", "signup", "purchase", _mode)}) USING (stay_id, ts)
             FULL JOIN ({_fused("map", "error", "click", _mode)}) USING (stay_id, ts)""",
    )
add("require_rows", f"SELECT {_R} FROM v_readings WHERE channel = 'view'")

# Bins

_ROUNDED = ", ".join(r(f) if f != "sedated_flag" else f for f in FEATURES)
add("bin_spine", "SELECT * FROM spine")
add("bin_spine_capped", "SELECT * FROM spine WHERE bin < 10")
add(
    "within_stay",
    f"""SELECT stay_id, event_id, ts, channel, {r("value")} FROM v_readings JOIN v_stays
        USING (stay_id) WHERE ts BETWEEN intime AND outtime""",
)
add("assign_bin", "SELECT stay_id, event_id, ts, bin FROM inside")
add("present_stays", "SELECT stay_id FROM present")
add("bin_aggregate", f"SELECT subject_id, stay_id, bin, bin_start, bin_end, {_ROUNDED} FROM bins")
add(
    "merge_channels",
    "SELECT stay_id, bin, bin_start, bin_end, "
    + ", ".join(r(f) for f in FEATURES if f != "sedated_flag")
    + " FROM bins",
)
_COVERAGE = """
    SELECT stay_id, min(bin) AS min_hour, max(bin) AS max_hour, count(bin) AS total_hours,
           min(subject_id) AS subject_id, max(bin) - min(bin) + 1 AS hour_range
    FROM bins GROUP BY 1"""
add(
    "coverage",
    f"SELECT *, CAST(round(CAST(total_hours / hour_range AS DECIMAL(38, 9)), 6) AS DOUBLE) AS coverage_ratio FROM ({_COVERAGE})",
)
add(
    "coverage_summary",
    f"""SELECT CAST(round(CAST(avg(total_hours / hour_range) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS mean_coverage_ratio,
               CAST(round(CAST(quantile_cont(total_hours, 0.5) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS median_total_hours
        FROM ({_COVERAGE})""",
)
_MISSING = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, count(*) - count({f}) AS missing_count, count(*) AS total_count
        FROM bins"""
    for f in FEATURES
)
add(
    "missing_rate",
    f"""SELECT feature, CAST(round(CAST(missing_count / total_count AS DECIMAL(38, 9)), 6) AS DOUBLE) AS missing_rate,
               missing_count, total_count, missing_count / total_count > 0.9::DOUBLE
                   AS above_threshold
        FROM ({_MISSING})""",
)
add("missing_per_column", f"SELECT feature, missing_count FROM ({_MISSING})")
add(
    "sampling_density",
    f"""SELECT stay_id, {r("h", "time_span_hours")}, data_points,
               CAST(round(CAST(CASE WHEN data_points > 1 THEN h / (data_points - 1) ELSE 0 END AS DECIMAL(38, 9)), 6) AS DOUBLE)
                   AS avg_interval_hours
        FROM (SELECT stay_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE AS h,
                     count(*) AS data_points FROM v_readings GROUP BY 1)""",
)

# Windows

_HOURS = """subject_id, stay_id, window_id, o0 AS obs_start_hour, o1 AS obs_end_hour,
    o1 AS pred_start_hour, p1 AS pred_end_hour"""
add("window_starts", f"SELECT {_HOURS} FROM starts")
add(
    "window_labels",
    f"""SELECT {_HOURS}, intime, deathtime, obs_start, obs_end, obs_end AS pred_start, pred_end,
               removed, label
        FROM labelled""",
)
CTE["long_bins"] = f"""
    SELECT subject_id, stay_id, unnest(range(0, CAST(ceil(
               (epoch_us(outtime) - epoch_us(intime)) / {DAY_US}.0) AS INT))) AS bin
    FROM v_stays"""
_LONG = {
    "starts": CTE["starts"].replace("FROM bins", "FROM long_bins"),
    "bounded": CTE["bounded"],
    "labelled": CTE["labelled"],
}
SQL["window_labels_outlast"] = (
    f"WITH v_stays AS ({CTE['v_stays']}), long_bins AS ({CTE['long_bins']}), "
    + ", ".join(f"{n} AS ({b})" for n, b in _LONG.items())
    + " SELECT stay_id, window_id, removed, label FROM labelled"
)
SQL["window_labels"] = (
    f"WITH v_stays AS ({CTE['v_stays']}), st AS ({CTE['st']}), spine AS ({CTE['spine']}), "
    + ", ".join(f"{n} AS ({b.replace('FROM long_bins', 'FROM spine')})" for n, b in _LONG.items())
    + f""" SELECT {_HOURS}, intime, deathtime, obs_start, obs_end, obs_end AS pred_start,
                  pred_end, removed, label FROM labelled"""
)
add("window_labels_plain", "SELECT stay_id, window_id, label_plain FROM candidates")
add(
    "window_completeness",
    f"""SELECT stay_id, window_id, {big("total_values", "total_values")},
               {big("missing_values", "missing_values")}, {r("obs_completeness")}
        FROM candidates""",
)
add(
    "window_completeness_rows",
    """SELECT w.stay_id, w.window_id, CAST(round(CAST(count(b.bin) / 5.0 AS DECIMAL(38, 9)), 6) AS DOUBLE) AS obs_completeness
       FROM starts w LEFT JOIN bins b ON b.stay_id = w.stay_id AND b.bin >= o0 AND b.bin < o1
            AND b.filled > 0
       GROUP BY 1, 2""",
)
add(
    "build_windows",
    f"""SELECT {_HOURS}, label, label_plain, {big("total_values", "total_values")},
               {big("missing_values", "missing_values")}, {r("obs_completeness")}
        FROM windows""",
)
add(
    "window_stats",
    """SELECT count(*) AS total_possible, count(*) FILTER (removed) AS death_during_obs,
              count(*) FILTER (NOT removed AND label = 0 AND obs_completeness < 0.3)
                  AS low_completeness,
              count(*) FILTER (NOT removed AND (label = 1 OR obs_completeness >= 0.3)) AS created,
              count(*) FILTER (NOT removed AND label = 1) AS positive
       FROM candidates""",
)
add(
    "window_summary",
    f"""SELECT count(*) AS n_windows, {big("sum(label)", "n_positive")},
               {r("avg(label)", "positive_ratio")}, count(DISTINCT subject_id) AS n_subjects,
               {r("count(*) / count(DISTINCT subject_id)", "windows_per_subject")},
               {r("avg(obs_completeness)", "mean_completeness")}
        FROM windows""",
)
add(
    "completeness_describe",
    f"""SELECT count(*) AS n, {r("avg(c)", "mean")}, {r("stddev_samp(c)", "std")},
               {r("min(c)", "min")}, {r("quantile_cont(c, 0.25)", "q25")},
               {r("quantile_cont(c, 0.5)", "q50")}, {r("quantile_cont(c, 0.75)", "q75")},
               {r("max(c)", "max")}
        FROM (SELECT CAST(obs_completeness AS DOUBLE) AS c FROM candidates)""",
)
add(
    "completeness_profile",
    """SELECT CASE WHEN obs_completeness >= 0.9 THEN '0.9+'
                   WHEN obs_completeness >= 0.7 THEN '0.7-0.9'
                   WHEN obs_completeness >= 0.5 THEN '0.5-0.7'
                   WHEN obs_completeness >= 0.3 THEN '0.3-0.5' ELSE '<0.3' END AS band,
              count(*) AS n_windows
       FROM candidates GROUP BY 1""",
)
add(
    "label_diff",
    f"""SELECT {big("o", "old_positive")}, {big("w", "new_positive")}, {big("w - o", "delta")},
               CAST(round(CAST(CASE WHEN o > 0 THEN (w - o) * 100.0::DOUBLE / o ELSE 0 END AS DECIMAL(38, 9)), 6) AS DOUBLE)
                   AS delta_pct,
               n AS n_windows, {r("o * 100.0::DOUBLE / n", "old_pct")},
               {r("w * 100.0::DOUBLE / n", "new_pct")}
        FROM (SELECT sum(label_plain) AS o, sum(label) AS w, count(*) AS n FROM windows)""",
)
add(
    "lost_positives",
    """SELECT DISTINCT subject_id FROM v_stays WHERE deathtime IS NOT NULL
       AND subject_id NOT IN (SELECT subject_id FROM candidates
                              WHERE label = 1 AND NOT removed AND obs_completeness >= 0.3)""",
)
add(
    "complete_windows",
    f"""SELECT stay_id, window_id, label, {r("obs_completeness")} FROM candidates
        WHERE NOT removed AND obs_completeness >= 0.3""",
)

# Landing and sinks

add(
    "landing_report",
    """SELECT 'patients' AS name, true AS present, count(*) AS n_rows FROM v_patients
       UNION ALL SELECT 'admissions', true, count(*) FROM v_admissions
       UNION ALL SELECT 'icustays', true, count(*) FROM v_icustays
       UNION ALL SELECT 'chartevents', true, count(*) FROM v_readings
       UNION ALL SELECT 'inputevents', false, NULL
       UNION ALL SELECT 'procedureevents', false, NULL""",
)
add(
    "read_events_csv",
    f"""SELECT stay_id, ts, CAST(list_position(['view', 'click', 'signup', 'purchase', 'error'], channel) AS INT)
               AS itemid, {r("value", "valuenum")} FROM v_readings""",
)
add("read_dimension_csv", "SELECT subject_id, gender, anchor_age FROM v_patients")
add("dataset_roundtrip", "SELECT stay_id, window_id, label FROM windows")
add(
    "documents_json",
    f"""SELECT {r("max_risk", "death_probability")}, first_outcome AS actual_death
        FROM (SELECT max(y_prob) AS max_risk,
                     arg_min(y_true, ROW(obs_start_hour, tiebreak, y_prob)) AS first_outcome
              FROM v_scores GROUP BY model, subject_id)""",
)
add("sequences_tall", f"SELECT subject_id, stay_id, window_id, step, {_ROUNDED} FROM steps")
add("sequence_arrays", f"SELECT stay_id, window_id, step, pos, {r('value')} FROM cells")

# Imputation and final dataset

_ALL_ROUNDED = ", ".join(r(f) for f in FEATURES)
add("ffill", f"SELECT subject_id, bin, {_ROUNDED} FROM filled_forward")
add(
    "fill_means",
    "SELECT b.subject_id, b.bin, "
    + ", ".join(
        f"CAST(round(CAST(coalesce(b.{f}, avg(b.{f}) OVER (PARTITION BY b.subject_id), o.{f}) AS DECIMAL(38, 9)), 6) AS DOUBLE)"
        f" AS {f}"
        for f in FEATURES
    )
    + " FROM bins b, overall o",
)
add("impute", f"SELECT subject_id, bin, {_ALL_ROUNDED} FROM imputed")
_GAPS = " + ".join(f"({f} IS NULL)::INT" for f in FEATURES)
add(
    "missing_delta",
    f"""SELECT {big("b", "missing_before")}, {big("a", "missing_after")},
               {big("n", "total_values")}, {big("b - a", "removed")},
               {r("b * 100.0::DOUBLE / n", "pct_before")},
               {r("a * 100.0::DOUBLE / n", "pct_after")}
        FROM (SELECT sum({_GAPS}) AS b, count(*) * {len(FEATURES)} AS n FROM bins),
             (SELECT sum({_GAPS}) AS a FROM imputed)""",
)
add(
    "drop_matching",
    "SELECT subject_id, stay_id, bin, "
    + ", ".join(
        r(f) if f != "sedated_flag" else f for f in KEPT if not f.endswith("_last")
    )
    + " FROM bins",
)
add("sort_readings", f"SELECT stay_id, ts, {r('value')} FROM v_readings ORDER BY stay_id, ts")
add(
    "attach_static",
    """SELECT w.stay_id, w.window_id, w.label, t.age, t.gender_M, t.gender_F
       FROM windows w LEFT JOIN statics t
            ON t.subject_id = w.subject_id AND t.stay_id = w.stay_id""",
)
add(
    "final_tall",
    """SELECT stay_id, window_id, y, step, pos, round(CAST(value AS DOUBLE), 3) + 0.0 AS value
       FROM final_cells""",
)
add(
    "feature_names",
    f"""SELECT pos, ({FINAL})[pos + 1] AS name, count(value) AS n_values
        FROM final_cells GROUP BY pos""",
)

# Quality reports

add(
    "tensor_health",
    """SELECT count(*) - count(value) AS x_null, count(*) FILTER (isnan(value)) AS x_nan,
              count(*) FILTER (isinf(value)) AS x_inf, count(*) FILTER (y IS NULL) AS y_null,
              CAST(0 AS BIGINT) AS y_nan, CAST(0 AS BIGINT) AS y_inf
       FROM final_cells""",
)
add(
    "tensor_range",
    f"""SELECT {r("min(value)", "x_min")}, {r("max(value)", "x_max")},
               array_to_string(list_sort(list(DISTINCT label)), ',') AS y_values
        FROM cells""",
)
add(
    "tensor_null_ratio",
    f"""SELECT count(*) > count(value) AS has_missing, count(*) AS total_values,
               count(*) - count(value) AS missing_values,
               {r("(count(*) - count(value)) * 100.0::DOUBLE / count(*)", "missing_pct")}
        FROM final_cells""",
)
_GAP = "count(*) - count(value) AS missing FROM final_cells GROUP BY"
add(
    "top_null_window",
    f"""SELECT stay_id, window_id, {_GAP} 1, 2
        ORDER BY missing DESC, stay_id, window_id LIMIT 5""",
)
add("top_null_step", f"SELECT step, {_GAP} 1 ORDER BY missing DESC, step LIMIT 5")
add("top_null_feature", f"SELECT pos, {_GAP} 1 ORDER BY missing DESC, pos LIMIT 5")
add(
    "class_balance",
    f"""SELECT n_subjects, neg AS n_negative_subjects, pos AS n_positive_subjects,
               {big("n_windows", "n_windows")}, {big("n_positive", "n_positive_windows")},
               {r("neg * 100.0::DOUBLE / n_subjects", "negative_pct")},
               {r("pos * 100.0::DOUBLE / n_subjects", "positive_pct")},
               {r("neg::DOUBLE / nullif(pos, 0)", "imbalance_ratio")},
               {r("n_positive * 100.0::DOUBLE / n_windows", "window_positive_pct")},
               {r("n_windows::DOUBLE / n_subjects", "windows_per_subject")}
        FROM balance""",
)
add(
    "windows_by_class",
    f"""SELECT subject_label, count(*) AS n_subjects, {big("sum(n_windows)", "n_windows")},
               {r("sum(n_windows)::DOUBLE / count(*)", "windows_per_subject")}
        FROM subjects GROUP BY 1""",
)
add(
    "balance_band",
    """SELECT CAST(round(CAST(m AS DECIMAL(38, 9)), 6) AS DOUBLE) AS minority_ratio,
              CASE WHEN m < 0.1::DOUBLE THEN '심각한 불균형' WHEN m < 0.2::DOUBLE THEN '중간 불균형'
                   WHEN m < 0.4::DOUBLE THEN '약간 불균형' ELSE '균형적' END AS balance,
              CASE WHEN m < 0.1::DOUBLE
                        THEN 'oversample subjects, strong class weights, focal loss'
                   WHEN m < 0.3::DOUBLE THEN 'class weights, balanced subject sampling'
                   ELSE 'train as is, light class weights' END AS advice
       FROM (SELECT least(neg, pos)::DOUBLE / n_subjects AS m FROM balance)""",
)
add(
    "check_dataset",
    """SELECT count(*) AS n_windows, CAST(0 AS BIGINT) AS missing_x,
              count(*) FILTER (n_steps <> 5) AS bad_steps, CAST(0 AS BIGINT) AS bad_width,
              count(*) FILTER (label IS NULL) AS missing_y
       FROM (SELECT stay_id, window_id, label, count(*) AS n_steps FROM steps GROUP BY 1, 2, 3)""",
)

# Model input

add(
    "subsample_windows",
    """SELECT subject_id, stay_id, window_id, o0 AS obs_start_hour
       FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
                                          ORDER BY o0, stay_id, window_id) AS rn,
                    count(*) OVER (PARTITION BY subject_id) AS n FROM windows)
       WHERE n <= 2 OR (rn - 1) % greatest(1, n // 3) = 0""",
)
add("split_subjects", "SELECT subject_id, subject_label, split FROM splits")
add(
    "split_leakage",
    """SELECT count(*) AS n_windows, count(DISTINCT split) AS n_splits,
              CAST(0 AS BIGINT) AS n_leaking
       FROM windows JOIN splits USING (subject_id)""",
)


def _undersampled(source: str, condition: str) -> str:
    return f"""
        SELECT stay_id, window_id, label
        FROM (SELECT *, row_number() OVER (PARTITION BY label
                        ORDER BY md5('42|' || stay_id || '|' || window_id)) AS rk,
                     sum(label) OVER () AS pos, avg(label) OVER () AS rate FROM {source})
        WHERE label = 1 OR {condition}
              OR rk <= floor(pos * 0.9::DOUBLE / 0.1::DOUBLE + 1e-9)"""


add("undersample", _undersampled("windows", "pos = 0"))
add(
    "undersample_train",
    _undersampled(
        "(SELECT windows.* FROM windows JOIN splits USING (subject_id) WHERE split = 'train')",
        "pos = 0 OR rate >= 0.15::DOUBLE",
    ),
)
add(
    "fit_scaler",
    f"""SELECT pos, {r("mean")}, {r("std")}, ({FEATURES})[pos + 1] AS feature FROM scaler""",
)
add(
    "fit_scaler_skip",
    f"""SELECT pos, {r("avg(value)", "mean")},
               CAST(round(CAST(CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS DECIMAL(38, 9)), 6) AS DOUBLE)
                   AS std, ({FEATURES})[pos + 1] AS feature
        FROM cells GROUP BY pos""",
)
add("apply_scaler", f"SELECT stay_id, window_id, step, pos, {r('value')} FROM scaled")
add(
    "class_weight",
    """SELECT count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative,
              CAST(round(CAST(1.5::DOUBLE * count(*) FILTER (label = 0)
                    / greatest(count(*) FILTER (label = 1), 1) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS pos_weight
       FROM windows""",
)
add(
    "dataset_facts",
    f"""SELECT n_subjects, {big("n_windows", "n_samples")},
               {r("n_windows::DOUBLE / n_subjects", "samples_per_subject")},
               {r("n_positive::DOUBLE / n_windows", "window_event_rate")},
               {r("pos::DOUBLE / n_subjects", "subject_event_rate")}
        FROM balance""",
)

# Evaluation

_ROC = """
    SELECT model, CAST(round(CAST(cum_neg::DOUBLE / all_neg AS DECIMAL(38, 9)), 6) AS DOUBLE) AS fpr,
           CAST(round(CAST(cum_pos::DOUBLE / all_pos AS DECIMAL(38, 9)), 6) AS DOUBLE) AS tpr, CAST(round(CAST(y_prob AS DECIMAL(38, 9)), 6) AS DOUBLE) AS threshold
    FROM totals {where}
    UNION ALL SELECT DISTINCT model, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM v_scores"""
add("roc_curve_full", _ROC.format(where=""))
add(
    "roc_curve",
    _ROC.format(
        where="WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"
    ),
)
add("roc_auc", f"SELECT model, {r('auc_roc')} FROM auc")
add(
    "pr_curve",
    """SELECT model, CAST(round(CAST(y_prob AS DECIMAL(38, 9)), 6) AS DOUBLE) AS threshold, CAST(round(CAST(p AS DECIMAL(38, 9)), 6) AS DOUBLE) AS "precision",
              CAST(round(CAST(rc AS DECIMAL(38, 9)), 6) AS DOUBLE) AS recall FROM pr
       UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM v_scores""",
)
add("average_precision", f"SELECT model, {r('auc_pr')} FROM auc")
add("best_threshold", f"SELECT model, {r('threshold')} FROM best")
add(
    "best_threshold_free",
    """SELECT model, CAST(round(CAST(y_prob AS DECIMAL(38, 9)), 6) AS DOUBLE) AS threshold FROM
         (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, y_prob) AS k FROM f1s)
       WHERE k = 1""",
)


def _cells_at(condition: str) -> str:
    return f"""count(*) FILTER (y_true = 0 AND NOT {condition}) AS tn,
        count(*) FILTER (y_true = 0 AND {condition}) AS fp,
        count(*) FILTER (y_true = 1 AND NOT {condition}) AS fn,
        count(*) FILTER (y_true = 1 AND {condition}) AS tp"""


add(
    "confusion",
    f"""SELECT model, 0.5::DOUBLE AS threshold, {_cells_at("(y_prob >= 0.5)")}
        FROM v_scores GROUP BY 1""",
)
add(
    "confusion_own_threshold",
    "SELECT model, CAST(round(CAST(threshold AS DECIMAL(38, 9)), 6) AS DOUBLE) AS threshold, tn, fp, fn, tp"
    " FROM confused",
)
_RATES = ("auc_roc", "auc_pr", "f1", "precision", "recall", "specificity", "npv", "alarm_rate")
add(
    "metrics",
    "SELECT model, "
    + ", ".join(f'CAST(round(CAST("{m}" AS DECIMAL(38, 9)), 6) AS DOUBLE) AS "{m}"' for m in (*_RATES, "threshold_optimal"))
    + ", tn, fp, fn, tp FROM measured",
)


def _swept(points: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"('{name}', {value}::DOUBLE)" for name, value in points)
    return f"""
        SELECT model, shift, {r("threshold")}, tp, tn, fp, fn,
               CAST(round(CAST(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS f1,
               CAST(round(CAST(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS "precision",
               CAST(round(CAST(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS recall,
               CAST(round(CAST(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS specificity,
               CAST(round(CAST(coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS npv,
               CAST(round(CAST(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS alarm_rate
        FROM (SELECT model, shift, threshold, {_cells_at("(y_prob >= threshold)")}
              FROM v_scores, (VALUES {rows}) t(shift, threshold) GROUP BY 1, 2, 3)
        WHERE tp + fp > 0 AND tn + fn > 0"""


_STEP = (0.9 - 0.1) / 14
add(
    "threshold_sweep",
    f"""SELECT * EXCLUDE (shift)
        FROM ({_swept([(str(i), repr(0.1 + i * _STEP)) for i in range(14)] + [("14", "0.9")])})""",
)
add(
    "operating_points",
    _swept([("night_weekend", "0.5"), ("day_standard", "0.3"), ("emergency", "0.15")]),
)
_EDGES = " + ".join(f"(y_prob > {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10))
add(
    "calibration",
    f"""SELECT model, {_EDGES} AS bin_no, count(*) AS n_rows,
               {r("avg(y_true)", "fraction_positive")}, {r("avg(y_prob)", "mean_predicted")}
        FROM v_scores GROUP BY 1, 2""",
)
add(
    "score_histogram",
    """SELECT model, y_true,
              CAST(least(49, floor((y_prob - lo) / (hi - lo) * 50)) AS INT) AS bin_no,
              count(*) AS n_rows
       FROM (SELECT *, min(y_prob) OVER w - CASE WHEN min(y_prob) OVER w = max(y_prob) OVER w
                                                 THEN 0.5 ELSE 0 END AS lo,
                    max(y_prob) OVER w + CASE WHEN min(y_prob) OVER w = max(y_prob) OVER w
                                              THEN 0.5 ELSE 0 END AS hi
             FROM v_scores WINDOW w AS (PARTITION BY model, y_true))
       GROUP BY 1, 2, 3""",
)
_SIX = ("auc_roc", "auc_pr", "f1", "precision", "recall", "specificity")
add(
    "compare_models",
    "SELECT upper(model) AS model, "
    + ", ".join(f'round("{m}", 4) + 0.0 AS "{m}"' for m in _SIX)
    + " FROM measured",
)
add(
    "compare_models_tall",
    " UNION ALL ".join(
        f"""SELECT model, '{m}' AS metric, CAST(round(CAST("{m}" AS DECIMAL(38, 9)), 6) AS DOUBLE) AS value FROM measured"""
        for m in _SIX
    ),
)
add(
    "rank_models",
    f"""SELECT CAST(row_number() OVER (ORDER BY auc_pr DESC, model) AS INT) AS place, model,
               {r("auc_pr")}
        FROM measured QUALIFY place <= 2""",
)
add(
    "blend",
    """SELECT subject_id, y_true, CAST(round(CAST(p AS DECIMAL(38, 9)), 6) AS DOUBLE) AS y_prob,
              CAST(round(CAST(ln(p / (1.0::DOUBLE - p)) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS logit
       FROM (SELECT subject_id, max(y_true) AS y_true, count(*) AS n,
                    least(greatest(sum(exp(w) * y_prob)
                                   / (exp(0.25::DOUBLE) + exp(-0.5::DOUBLE)), 1e-6),
                          1.0::DOUBLE - 1e-6) AS p
             FROM (SELECT model, subject_id, max(y_true) AS y_true, max(y_prob) AS y_prob
                   FROM v_scores GROUP BY 1, 2)
                  JOIN (VALUES ('F', 0.25::DOUBLE), ('O', -0.5::DOUBLE)) t(model, w) USING (model)
             GROUP BY 1)
       WHERE n = 2""",
)

# Risk tables


def _band(p: str, high: str = ">", low: str = ">") -> str:
    return f"""CASE WHEN {p} {high} 0.7::DOUBLE THEN 'High'
                    WHEN {p} {low} 0.3::DOUBLE THEN 'Medium' ELSE 'Low' END"""


add(
    "risk_band",
    f"""SELECT {r("y_prob")}, n_rows, {_band("y_prob")} AS band_0,
               {_band("y_prob", ">=", ">=")} AS band_1, {_band("y_prob", ">", ">=")} AS band_2
        FROM (SELECT y_prob, count(*) AS n_rows FROM v_scores GROUP BY 1)""",
)


def _by_level(column: str, high: str, medium: str, low: str) -> str:
    return f"""CASE risk_level WHEN 'High' THEN '{high}' WHEN 'Medium' THEN '{medium}'
                               ELSE '{low}' END AS {column}"""


_ALERT = ", ".join(
    [
        _by_level("alert_level", "🔴 긴급", "🟡 주의", "🟢 안정"),
        """CASE WHEN y_prob > 0.2::DOUBLE AND y_prob < 0.8::DOUBLE
                THEN 'high' ELSE 'medium' END AS model_confidence""",
        _by_level("action", "즉시 의료진 상담", "지속 모니터링", "정기 검진"),
        _by_level("monitoring_interval", "15분", "1시간", "4시간"),
    ]
)
add(
    "alert_columns",
    f"""SELECT * REPLACE ({r("y_prob")}), {_ALERT}
        FROM (SELECT *, {_band("y_prob")} AS risk_level FROM v_scores)""",
)
add(
    "batch_alerts",
    f"""SELECT model, subject_id, obs_start_hour, tiebreak, {r("y_prob")}, risk_level, {_ALERT}
        FROM (SELECT *, lag(risk_level) OVER (PARTITION BY model, subject_id
                             ORDER BY obs_start_hour, tiebreak, y_prob) AS before
              FROM (SELECT *, {_band("y_prob")} AS risk_level FROM v_scores))
        WHERE before IS DISTINCT FROM risk_level""",
)
_LANDED = f"""
    SELECT *, max(place) OVER (PARTITION BY model, subject_id ORDER BY part
                               RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM (SELECT *, {_band("y_prob")} AS risk_level,
                 CASE WHEN tiebreak % 17 = 0 THEN 3 ELSE least(obs_start_hour // 3, 2) END AS part,
                 CAST(obs_start_hour AS BIGINT) * 100000000000000 + tiebreak * 1000000
                     + CAST(round(y_prob * 10000) AS BIGINT) AS place
          FROM v_scores)"""
add(
    "stream_alerts",
    f"""SELECT model, subject_id, obs_start_hour, tiebreak, {r("y_prob")}, risk_level, {_ALERT}
        FROM (SELECT *, lag(risk_level) OVER (PARTITION BY model, subject_id ORDER BY part, place) AS before
              FROM ({_LANDED}) WHERE seen IS NULL OR place >= seen)
        WHERE before IS DISTINCT FROM risk_level""",
)
add(
    "stream_late_scores",
    f"SELECT model, subject_id, obs_start_hour, tiebreak, {r('y_prob')} FROM ({_LANDED}) WHERE place < seen",
)
add(
    "risk_timeline",
    f"""SELECT model, subject_id, CAST(row_number() OVER (PARTITION BY model, subject_id
                   ORDER BY obs_start_hour, tiebreak, y_prob, y_true) - 1 AS INT) AS pos,
               obs_start_hour AS hour, {r("y_prob", "risk_score")}, y_true AS actual_outcome
        FROM v_scores""",
)
add(
    "timeline_rows",
    f"""SELECT model, subject_id, obs_start_hour, tiebreak, {r("y_prob")}, place, hour_count
        FROM timeline""",
)
add(
    "risk_trend",
    f"""SELECT model, subject_id, hour_count, {r("early_mean")}, {r("late_mean")}, risk_trend
        FROM trends""",
)
_RISKS = ", ".join(r(c) for c in ("max_risk", "avg_risk", "min_risk"))
add(
    "subject_risk",
    f"""SELECT model, subject_id, {_RISKS}, hour_count, first_hour, latest_hour, mortality_outcome
        FROM risk""",
)
add(
    "high_risk",
    f"""SELECT model, subject_id, {_RISKS}, a.hour_count, first_hour, latest_hour,
               mortality_outcome, risk_trend
        FROM (SELECT * FROM risk WHERE max_risk > 0.7::DOUBLE
              QUALIFY row_number() OVER (PARTITION BY model
                                         ORDER BY max_risk DESC, subject_id) <= 50) a
             JOIN trends USING (model, subject_id)""",
)
add(
    "high_risk_all",
    f"""SELECT model, subject_id, {_RISKS}, a.hour_count, first_hour, latest_hour,
               mortality_outcome, risk_trend
        FROM risk a JOIN trends USING (model, subject_id) WHERE max_risk > 0.7::DOUBLE""",
)
add(
    "risk_summary",
    f"""SELECT model, any_value(auc) AS model_auc, count(*) AS total_patients, count(*) FILTER (hi) AS high_risk_count,
               count(*) FILTER (NOT hi AND NOT lo) AS medium_risk_count,
               count(*) FILTER (lo) AS low_risk_count, {r("avg(max_risk)", "avg_max_risk")},
               {r("avg(hour_count)", "avg_hour_count")}, count(*) FILTER (e) AS total_deaths,
               {r("count(*) FILTER (e) / count(*)", "patient_mortality_rate")},
               {r("coalesce(count(*) FILTER (e AND hi) / nullif(count(*) FILTER (hi), 0), 0)",
                  "high_risk_mortality_rate")},
               {r("coalesce(count(*) FILTER (e AND lo) / nullif(count(*) FILTER (lo), 0), 0)",
                  "low_risk_mortality_rate")}
        FROM (SELECT *, max_risk > 0.7::DOUBLE AS hi, max_risk < 0.3::DOUBLE AS lo,
                     mortality_outcome = 1 AS e FROM risk) JOIN
             (SELECT model, {r("auc_roc", "auc")} FROM auc) USING (model)
        GROUP BY 1""",
)
add(
    "top_factors",
    f"""SELECT stay_id, window_id, CAST(place AS INT) AS place, feature_name, value,
               CASE WHEN abs(value) > 1 THEN 'high' ELSE 'medium' END AS contribution
        FROM (SELECT *, row_number() OVER (PARTITION BY stay_id, window_id
                                           ORDER BY abs(value) DESC, feature_name) AS place
              FROM (SELECT stay_id, window_id, ({FEATURES})[pos + 1] AS feature_name,
                           {r("value")} FROM scaled WHERE step = 4)
              WHERE abs(value) > 0.1)
        WHERE place <= 5""",
)
add(
    "variance_importance",
    f"""SELECT model, ({FEATURES})[pos + 1] AS feature_name, {r("score", "importance_score")}
        FROM importance""",
)
add(
    "global_importance",
    f"""SELECT ({FEATURES})[pos + 1] AS feature_name,
               CAST(round(CAST(avg(round(score, 6)) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS importance_score
        FROM importance GROUP BY pos ORDER BY avg(CAST(round(CAST(score AS DECIMAL(38, 9)), 6) AS DOUBLE)) DESC, feature_name LIMIT 20""",
)
add(
    "explanation_docs",
    f"""SELECT model, subject_id, {r("max_risk", "death_probability")},
               first_outcome AS actual_death, {_band("max_risk")} AS risk_level,
               {r("max_risk", "factor_value")}
        FROM (SELECT model, subject_id, max(y_prob) AS max_risk,
                     arg_min(y_true, ROW(obs_start_hour, tiebreak, y_prob)) AS first_outcome
              FROM v_scores GROUP BY 1, 2)""",
)
add(
    "trend_docs",
    f"""SELECT model, subject_id, CAST(place - 1 AS INT) AS pos, obs_start_hour AS hour,
               {r("y_prob", "death_probability")}
        FROM timeline""",
)
add(
    "performance_table",
    f"""SELECT model, {r("auc_roc")}, {r("auc_pr")}, {r("f1", "f1_score")},
               CAST(round(CAST("precision" AS DECIMAL(38, 9)), 6) AS DOUBLE) AS "precision", {r("recall")}, {r("specificity")},
               {r("auc_roc", "best_auc")}, 'enhanced_prediction' AS model_type,
               {r("auc_roc", "auroc")}, 0.0::DOUBLE AS aupr
        FROM measured""",
)
add(
    "tile_snapshot",
    f"""SELECT stay_id, CAST(k AS INT) AS step, pos, CAST(round(CAST(coalesce(value, 0) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS value
        FROM (SELECT stay_id, k, unnest({list(range(len(FEATURES) + 1))}) AS pos,
                     unnest([{", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES)}, 0]) AS value
              FROM (SELECT {", ".join("arg_max_null(" + f + ", bin) AS " + f for f in FEATURES)},
                           stay_id, unnest(range(0, 5)) AS k FROM bins GROUP BY stay_id))""",
)
add(
    "score_linear",
    f"""SELECT stay_id, window_id,
               CAST(round(CAST(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS y_prob
        FROM (SELECT stay_id, window_id,
                     -0.5::DOUBLE + sum(value * ((pos % 5 - 2) / 10.0::DOUBLE)) AS z
              FROM scaled WHERE step = 4 GROUP BY 1, 2)""",
)

# Streams

add(
    "stream_bins",
    "SELECT stay_id, bin, intime + bin * INTERVAL 1 DAY AS bin_start, "
    + ", ".join(r(f) for f in FEATURES if f != "sedated_flag")
    + " FROM agg JOIN v_stays USING (stay_id)",
)
_IN_PARTS = """
    SELECT i.*, s.intime + i.bin * INTERVAL 1 DAY AS bin_start,
           least(date_diff('day', (SELECT min(ts) FROM v_readings)::DATE, i.ts::DATE) // 8
                 + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END, 3) AS part
    FROM inside i JOIN v_stays s USING (stay_id) WHERE bin IS NOT NULL"""
_SORTED = f"""
    SELECT *, coalesce(bin_start <= max(bin_start) OVER (ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                       - INTERVAL 2 DAY, false) AS late
    FROM ({_IN_PARTS})"""
add(
    "stream_late_readings",
    f"SELECT stay_id, event_id, ts, channel, {r('value')}, bin, bin_start FROM ({_SORTED}) WHERE late",
)
add(
    "stream_closed_bins",
    f"""SELECT s.subject_id, s.stay_id, s.bin, s.bin_start, s.bin_end, {_ROUNDED}
        FROM spine s LEFT JOIN ({CTE["agg"].replace("FROM inside WHERE bin IS NOT NULL", f"FROM ({_SORTED}) WHERE NOT late")}) a
             ON a.stay_id = s.stay_id AND a.bin = s.bin""",
)
