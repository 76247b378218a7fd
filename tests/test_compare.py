from gridlake.operators import compare


def test_rows_not_converged_compare_their_outcome_only(spark):
    kind = "name string, converged boolean, status_code string, worst_bus long, final_tolerance double"
    a = spark.createDataFrame([("x", True, "OK", 1, 1.0), ("y", False, "DIVERGED", 2, 5.0), ("z", False, "DIVERGED", 3, 6.0), ("w", None, "OK", 4, 2.0)], kind)
    b = spark.createDataFrame([("x", True, "OK", 1, 1.5), ("y", False, "DIVERGED", 9, float("nan")), ("z", False, "ISLANDED", 3, 6.0), ("w", None, "OK", 4, 3.0)], kind)
    exact = ["name", "status_code", "worst_bus"]
    found = compare.assert_close(a, b, exact, ["final_tolerance"], converged="converged").first()
    assert (found.only_golden, found.only_candidate, found.final_tolerance_bad) == (1, 1, 2)
    found = compare.assert_close(a, b, exact, ["final_tolerance"]).first()
    assert (found.only_golden, found.only_candidate, found.final_tolerance_bad) == (2, 2, 2)


def test_metrics_of_scenarios_that_both_runs_solved(spark):
    kind = "name string, type string, converged boolean, status_code string, iterations int, final_tolerance double"
    a = spark.createDataFrame([("x", "Line", True, "OK", 4, 1.0), ("y", "Line", True, "OK", 5, 2.0), ("z", "Line", False, "OK", 9, 9.0)], kind)
    b = spark.createDataFrame([("x", "Line", True, "OK", 6, 1.0), ("y", "Line", True, "SLACK_OVERLOAD", 7, 2.0), ("z", "Line", True, "OK", 1, 1.0)], kind)
    found = {r["column"]: (r["n"], r["mean_diff"]) for r in compare.convergence_metrics(a, b).collect()}
    assert found == {"iterations": (1, -2.0), "final_tolerance": (1, 0.0)}


def test_keys_that_rows_are_dealt_by_are_kept(spark):
    """Rows dealt by their keys are grouped, numbered and joined where they are."""
    rows = spark.range(40).selectExpr("id % 7 AS k", "id * 1.0D AS p").repartition(9, "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = compare.assert_close(rows, rows.where("p > 3"), ["k"], ["p"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 2
