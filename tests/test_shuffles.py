"""Lines go through two shuffles at most, whatever a query does with an order's boxes and predictions."""

import pytest

from tarnwork.operators import evaluation
from tarnwork.plans import catalogue

LINES = 4000


def _orders(spark, folder, lines: int) -> str:
    n = "(id * 7919 % 1000003)"
    spark.range(lines).selectExpr(f"{n} % 900 AS l_orderkey", f"{n} AS l_partkey", f"{n} % 11 AS l_suppkey", f"CAST({n} % 7 + 1 AS INT) AS l_linenumber", f"CAST({n} % 50 + 1 AS DOUBLE) AS l_quantity", "id * 1.5D AS l_extendedprice", f"{n} % 11 / 100.0D AS l_discount", f"{n} % 9 / 100.0D AS l_tax", f"CASE WHEN {n} % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag", "TIMESTAMP '1995-01-01' AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    return _orders(spark, tmp_path_factory.mktemp("orders"), LINES)


@pytest.fixture(scope="module")
def more_orders(spark, tmp_path_factory):
    return _orders(spark, tmp_path_factory.mktemp("more_orders"), 3 * LINES)


@pytest.fixture
def shuffled(spark):
    """Runs a frame without broadcasts, as at size, and gives the rows that its shuffles wrote."""
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    def run(make) -> int:
        before = written()
        make().collect()
        return written() - before

    yield run
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["crowded_error_categories", "match_crowded", "prf1_by_class"])
def test_crowded_queries_shuffle_lines_twice_at_most(spark, orders, shuffled, name):
    assert LINES <= shuffled(lambda: catalogue.QUERIES[name](spark, orders)) <= 2 * LINES + 200


def test_a_crowd_of_predictions_keeps_no_more_than_boxes_can_use(spark):
    """Three boxes that all 5,000 predictions meet, in steps of overlap: the best three go to the boxes in order."""
    gt = spark.createDataFrame([(1, g, 0, 0.0, 0.0, 100.0, 100.0) for g in (1, 2, 3)], "image int, gt_idx int, cls int, g0 double, g1 double, g2 double, g3 double")
    pred = spark.range(5000).selectExpr("1 AS image", "CAST(id AS INT) AS pred_idx", "0 AS cls", "0.5D AS conf", "0D AS p0", "0D AS p1", "100D AS p2", "60 + id % 41D AS p3")
    found = evaluation.match_greedy(gt, pred)
    assert sorted((r["gt_idx"], r["pred_idx"], r["iou"]) for r in found.collect()) == [(1, 40, 1.0), (2, 81, 1.0), (3, 122, 1.0)]
    rows = evaluation.examples(gt, pred, found).groupBy("categoria").count().collect()
    assert {r["categoria"]: r["count"] for r in rows} == {evaluation.HIT: 3, evaluation.FALSE: 4997}


CURVES = ["ap_coco101", "ap_trapz101", "ap_at_iou", "map_50_95", "precision_recall_curve"]


@pytest.mark.parametrize("name", [*CURVES, "map_of_classes"])
def test_curves_shuffle_lines_twice_at_most(spark, orders, more_orders, shuffled, name):
    """Beside the lines only confidences times thresholds are shuffled, which don't grow."""
    few, many = [shuffled(lambda at=at: catalogue.QUERIES[name](spark, at)) for at in (orders, more_orders)]
    assert 2 * LINES <= many - few <= 2 * 2 * LINES + 500


def test_predictions_that_meet_no_box_all_count(spark):
    gt = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 0.0, 0.0, 10.0, 10.0)], "image int, gt_idx int, cls int, g0 double, g1 double, g2 double, g3 double")
    here = (0.0, 0.0, 10.0, 10.0)
    made = [(1, 0, 0, 0.9, *here), (1, 1, 1, 0.9, *here), (1, 2, 2, 0.9, *here), (1, 3, 0, 0.8, *here), (2, 0, 0, 0.9, *here), (None, 0, 0, 0.9, *here), (None, 0, 0, 0.9, *here)]
    pred = spark.createDataFrame(made, "image int, pred_idx int, cls int, conf double, p0 double, p1 double, p2 double, p3 double")
    got = {(r["cls"], r["conf"]): (r["n"], r["tp"]) for r in evaluation.true_positives(gt, pred, [0.5]).collect()}
    assert got == {(0, 0.9): (4, 1), (1, 0.9): (1, 1), (2, 0.9): (1, 0), (0, 0.8): (1, 0)}
