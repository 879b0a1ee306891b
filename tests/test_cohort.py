from conftest import at, rows

from icuflow.operators import cohort as D
from icuflow.params import Params


def tables(spark):
    patients = spark.createDataFrame(
        [(1, "F", 40), (2, "M", 17), (3, "M", 60), (4, None, 50)],
        "subject_id long, gender string, anchor_age int",
    )
    admissions = spark.createDataFrame(
        [(1, 10, None), (1, 11, at(2000)), (2, 20, None), (3, 30, at(30)), (4, 40, None)],
        "subject_id long, hadm_id long, deathtime timestamp",
    )
    stays = spark.createDataFrame(
        [
            (1, 10, 100, at(0), at(48)),
            (1, 11, 110, at(1000), at(1048)),
            (2, 20, 200, at(0), at(48)),
            (3, 30, 300, at(0), at(24)),
            (4, 40, 400, at(0), at(24)),
        ],
        "subject_id long, hadm_id long, stay_id long, intime timestamp, outtime timestamp",
    )
    return patients, admissions, stays


def test_later_event_is_inherited_in_column_mode_only(spark):
    # Subject 1 has no event in the first stay, but one in a later admission.
    # By column the later event is taken over, lies after the first stay's end
    # and removes the subject. Subject 3's event is after the end of the stay.
    by_column = D.select_cohort(*tables(spark))
    by_row = D.select_cohort(*tables(spark), mode="row")
    assert rows(by_column, "subject_id", "gender_F", "gender_M") == [(4, 0, 0)]
    assert rows(by_row, "subject_id", "stay_id", "icu_los_hours") == [(1, 100, 48.0), (4, 400, 24.0)]


def test_stay_length_bounds_are_inclusive(spark):
    patients, admissions, stays = tables(spark)
    p = Params(min_stay_hours=24, max_stay_hours=47)
    kept = D.select_cohort(patients, admissions, stays, p, mode="row")
    assert rows(kept, "subject_id") == [(4,)]


def test_attrition_counts_every_step(spark):
    steps = rows(D.cohort_attrition(*tables(spark), mode="row"))
    assert [(s[1], s[2]) for s in steps] == [
        ("adults", 3), ("merged", 4), ("first_stays", 3), ("stay_length", 3), ("event_end", 2)
    ]
    assert steps[-1][3] == 0.0


def test_min_by_ties_use_the_stay_id(spark):
    df = spark.createDataFrame(
        [(1, 5, at(0), "b"), (1, 4, at(0), "a")], "k long, stay_id long, intime timestamp, v string"
    )
    assert rows(D.first_per_group(df, ["k"], ["intime", "stay_id"]), "v") == [("a",)]
