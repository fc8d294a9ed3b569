"""Detection evaluation: matching, precision, recall, F1, average precision, example selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.boxes import four, iou
from tarnwork.schemas import EXAMPLES
from tarnwork.scratch import staged

GT, PRED = [f"g{k}" for k in range(4)], [f"p{k}" for k in range(4)]
HIT, MISS, FALSE = "correcto", "omision", "falso_positivo"  # fixed values
CONFIDENCE_CELLS = 1000


def overlaps(gt: DataFrame, pred: DataFrame, image: str = "image", by_class: bool = False) -> DataFrame:
    """Every pair of a box and a prediction of one image with their overlap: gt_idx, pred_idx, conf, iou.

    ``gt``: image, gt_idx, cls, g0..g3; ``pred``: image, pred_idx, cls, conf, p0..p3. Rows are dealt by image alone, so
    that all steps of an image share one shuffle of each side.
    """
    pairs = gt.join(pred.withColumnRenamed("cls", "pred_cls"), image)
    if by_class:
        pairs = pairs.where(_same("cls", "pred_cls")).drop("pred_cls")
    return pairs.withColumn("iou", iou([F.col(c) for c in GT], [F.col(c) for c in PRED]))


def _same(a: str, b: str) -> Column:
    """a = b as two bounds: as an equality it would be a join key, and rows would be dealt anew by it and the image."""
    return (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))


def match_single(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, image: str = "image") -> DataFrame:
    """image, gt_idx, pred_idx, conf, iou of accepted matches where images hold one box at most."""
    best = Window.partitionBy(image, "gt_idx").orderBy(F.desc("iou"), "pred_idx")
    pairs = overlaps(gt, pred, image).where("iou > 0").withColumn("_nth", F.row_number().over(best))
    return pairs.where((F.col("_nth") == 1) & (F.col("iou") >= threshold)).select(image, "gt_idx", "pred_idx", "conf", "iou")


def match_greedy(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, image: str = "image", by_class: bool = False) -> DataFrame:
    """Like ``match_single`` for any number of boxes: in order of gt_idx each takes its best unused prediction.

    A box whose best unused prediction overlaps too little takes none; the first of equal overlaps wins.
    """
    return _greedy(gt, pred, threshold, image, by_class).drop("cls")


def _greedy(gt: DataFrame, pred: DataFrame, threshold: float, image: str, by_class: bool) -> DataFrame:
    """``match_greedy`` with the class of the box."""
    gt = gt.withColumn("_n", F.count("*").over(Window.partitionBy(image)))
    pairs = overlaps(gt, pred, image, by_class).where((F.col("iou") > 0) & (F.col("iou") >= threshold))
    # the other boxes of an image of n take n - 1 predictions at most, so a box's own is among its n best
    order = Window.partitionBy(image, "gt_idx").orderBy(F.desc("iou"), "pred_idx")
    pairs = pairs.withColumn("_nth", F.row_number().over(order)).where("_nth <= _n").select(image, "gt_idx", "_nth", "pred_idx", "conf", "iou", "cls")
    made = pairs.groupBy(image).agg(F.sort_array(F.collect_list(F.struct("gt_idx", "_nth", "pred_idx", "conf", "iou", "cls"))).alias("made"))
    kept = ("gt_idx", "pred_idx", "conf", "iou", "cls")
    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    none = F.array().cast(f"array<struct<{','.join(f'{c}:{kind[c]}' for c in kept)}>>")

    def take(found: Column, p: Column) -> Column:
        used = F.exists(found, lambda m: (m["gt_idx"] == p["gt_idx"]) | (m["pred_idx"] == p["pred_idx"]))
        return F.when(used, found).otherwise(F.concat(found, F.array(F.struct(*[p[c].alias(c) for c in kept]))))

    return made.select(image, F.explode(F.aggregate("made", none, take)).alias("m")).select(image, "m.*")


def _without(df: DataFrame, matches: DataFrame, image: str, key: str) -> DataFrame:
    """Rows of ``df`` that no match of their image holds."""
    taken = matches.select(F.col(image).alias("_image"), F.col(key).alias("_key"))
    return df.join(taken, (F.col(image) == F.col("_image")) & _same(key, "_key"), "left_anti")


def examples(gt: DataFrame, pred: DataFrame, matches: DataFrame, image: str = "image") -> DataFrame:
    """source_asset_id, categoria, confianza, iou, hipotesis of hits, misses and false positives."""
    name = F.col(image).cast("string").alias("source_asset_id")

    def rows(df: DataFrame, kind: str, conf: Column, overlap: Column, why: str) -> DataFrame:
        return df.select(name, F.lit(kind).alias("categoria"), conf.cast("double").alias("confianza"), overlap.alias("iou"), F.lit(why).alias("hipotesis"))

    hits = rows(matches, HIT, F.col("conf"), four(F.col("iou")), "")
    missed = rows(_without(gt, matches, image, "gt_idx"), MISS, F.lit(None), F.lit(0.0), "sin detección sobre el umbral")
    false = rows(_without(pred, matches, image, "pred_idx"), FALSE, F.col("conf"), F.lit(0.0), "detección sin objeto")
    return hits.unionByName(missed).unionByName(false)


def empty_examples(spark) -> DataFrame:
    return spark.createDataFrame([], EXAMPLES)


def with_ratios(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 (0 where undefined) beside tp, fp, fn."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def precision_recall(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of an example table (0 where undefined)."""
    counts = [F.count_if(F.col("categoria") == c).alias(n) for c, n in ((HIT, "tp"), (FALSE, "fp"), (MISS, "fn"))]
    return with_ratios(df.groupBy(*(by or [])).agg(*counts))


def require_ground_truth(gt: DataFrame) -> None:
    if gt.isEmpty():
        raise ValueError("n_ground_truths == 0: nothing to evaluate")


def require_unlocked(split: str, allow_test: bool) -> None:
    if split == "test" and not allow_test:
        raise PermissionError("the test split needs allow_test")


def true_positives(gt: DataFrame, pred: DataFrame, thresholds: list[float], image: str = "image") -> DataFrame:
    """cls, threshold, conf, n, tp: predictions and true positives of every class, threshold and distinct confidence.

    A prediction goes for the box of its class that it overlaps most (then the first); of those that go for one
    box and overlap it enough, the most confident (then the first) is the true positive. So a prediction is one at the
    thresholds above the best overlap of its more confident rivals and up to its own; thresholds need no row each
    until confidences are counted.
    """
    first = Window.partitionBy(image, "pred_idx").orderBy(F.desc("iou"), "gt_idx")
    rivals = Window.partitionBy(image, "gt_idx").orderBy(F.desc("conf"), "pred_idx").rowsBetween(Window.unboundedPreceding, -1)
    boxes = gt.select(F.col(image).alias("_image"), "gt_idx", F.col("cls").alias("_cls"), *GT)
    overlap = iou([F.col(c) for c in GT], [F.col(c) for c in PRED])
    met = (F.col(image) == F.col("_image")) & _same("cls", "_cls") & (overlap >= min(thresholds))
    own = pred.join(boxes, met, "left").select(image, "pred_idx", "cls", "conf", "gt_idx", F.when(F.col("_image").isNotNull(), overlap).alias("iou"))
    own = own.withColumn("_nth", F.row_number().over(first)).where("_nth = 1 OR iou IS NULL")  # null: meets no box, one row already
    own = own.withColumn("_rival", F.coalesce(F.max("iou").over(rivals), F.lit(0.0)))
    hit = [((F.col("iou") >= t) & (F.col("_rival") < t)).cast("int") for t in thresholds]
    counted = own.groupBy("cls", "conf").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(f"_{k}") for k, h in enumerate(hit)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_{k}").alias("tp")) for k, t in enumerate(thresholds)])).alias("e")
    return counted.select("cls", "conf", "n", each).select("cls", "e.threshold", "conf", "n", "e.tp")


def curve(scored: DataFrame, gt: DataFrame) -> DataFrame:
    """cls, threshold, conf, recall, precision, envelope at every distinct confidence; classes without a box have no curve.

    Confidences fall into cells; running totals are made within cells and carried over by cell totals, so no task
    holds a whole curve. The envelope is the best precision at this recall or more.
    """
    c, keys = F.col, ["cls", "threshold"]
    points = scored.withColumn("cell", F.floor(F.col("conf") * CONFIDENCE_CELLS).cast("int"))
    cells = points.groupBy(*keys, "cell").agg(F.sum("tp").alias("ctp"), F.sum("n").alias("cn"))
    over = Window.partitionBy(*keys).orderBy(F.desc("cell"))
    cells = cells.select(*keys, "cell", (F.sum("ctp").over(over) - c("ctp")).alias("tp0"), (F.sum("cn").over(over) - c("cn")).alias("n0"))
    inner = Window.partitionBy(*keys, "cell").orderBy(F.desc("conf"))
    points = points.join(cells, [*keys, "cell"]).join(gt.groupBy("cls").agg(F.count("*").alias("positives")), "cls")
    points = points.withColumn("run_tp", c("tp0") + F.sum("tp").over(inner)).withColumn("run_n", c("n0") + F.sum("n").over(inner))
    points = points.withColumn("recall", c("run_tp") / c("positives")).withColumn("precision", c("run_tp") / c("run_n"))
    tops = points.groupBy(*keys, "cell").agg(F.max("precision").alias("top"))
    later = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "cell", F.coalesce(F.max("top").over(later), F.lit(0.0)).alias("below"))
    tail = Window.partitionBy(*keys, "cell").orderBy("conf").rowsBetween(Window.unboundedPreceding, 0)
    return points.join(tops, [*keys, "cell"]).select(*keys, "conf", "cell", "recall", "precision", F.greatest("below", F.max("precision").over(tail)).alias("envelope"))


def average_precision(points: DataFrame, method: str = "trapz101") -> DataFrame:
    """cls, threshold, ap from a curve.

    exact: area under the envelope's steps. coco101: mean envelope at recalls 0, 0.01 ... 1. trapz101: trapezoid
    area under the line through the curve (starting at recall 0 with precision 1, ending at recall 1 with 0) at
    those recalls; it gives 0.995 for a perfect detector.
    """
    # one point for each recall: the envelope's greatest value there
    keys = ["cls", "threshold"]
    steps = points.groupBy(*keys, "recall").agg(F.max("envelope").alias("high"), F.min("envelope").alias("low"))
    if method == "exact":
        order = Window.partitionBy(*keys).orderBy("recall")
        area = (F.col("recall") - F.coalesce(F.lag("recall").over(order), F.lit(0.0))) * F.col("high")
        return steps.withColumn("a", area).groupBy(*keys).agg(F.sum("a").alias("ap"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(100))).alias("k")
    hundredth = F.floor(F.col("recall") * 100 + F.lit(1e-9)).cast("int").alias("k")
    # of each hundredth [k, k + 1) its first and last point, and its first beyond k itself
    exact = F.abs(F.col("recall") - F.col("k") / 100) < 1e-9
    held = steps.select("*", hundredth).groupBy(*keys, "k").agg(
        F.min_by(F.struct("recall", "high", "low"), "recall").alias("first"),
        F.max_by(F.struct("recall", "high", "low"), "recall").alias("last"),
        F.min_by(F.when(exact, F.struct("recall", "high", "low")), "recall").alias("here"),
    )
    out = steps.select(*keys).distinct().select(*keys, grid).join(held, [*keys, "k"], "left").withColumn("r", F.col("k") / F.lit(100.0))
    by = Window.partitionBy(*keys).orderBy("k")
    out = out.withColumn("next_any", F.first("first", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("prev_any", F.last("last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    if method == "coco101":
        value = F.coalesce(F.col("next_any.high"), F.lit(0.0))
        return out.withColumn("v", value).groupBy(*keys).agg((F.sum("v") / 101).alias("ap"))
    if method != "trapz101":
        raise ValueError(f"unknown method: {method}")
    r0, v0 = F.coalesce(F.col("prev_any.recall"), F.lit(0.0)), F.coalesce(F.col("prev_any.low"), F.lit(1.0))
    r1, v1 = F.coalesce(F.col("next_any.recall"), F.lit(1.0)), F.coalesce(F.col("next_any.high"), F.lit(0.0))
    line = F.when(r1 > r0, v0 + (v1 - v0) * (F.col("r") - r0) / (r1 - r0)).otherwise(v1)
    value = F.when(F.col("k") == 100, 0.0).when(F.col("here").isNotNull(), F.col("here.low")).otherwise(line)
    weight = F.when(F.col("k").isin(0, 100), 0.005).otherwise(0.01)
    return out.withColumn("v", value * weight).groupBy(*keys).agg(F.sum("v").alias("ap"))


def mean_average_precision(aps: DataFrame, gt: DataFrame) -> DataFrame:
    """map50, map75, map50_95: means over the classes that have boxes (0 for a class without a prediction) and thresholds."""
    each = F.struct(F.col("threshold"), F.col("ap"))
    by_class = aps.groupBy("cls").agg(F.collect_list(each).alias("aps"))  # as many as there are thresholds
    at = lambda t: F.avg(F.coalesce(F.filter("aps", lambda x: F.abs(x.threshold - t) < 1e-9)[0].ap, F.lit(0.0)))
    mean = F.aggregate("aps", F.lit(0.0), lambda a, x: a + x.ap) / F.size("aps")
    out = gt.select("cls").distinct().join(by_class, "cls", "left").agg(at(0.5).alias("map50"), at(0.75).alias("map75"), F.avg(F.coalesce(mean, F.lit(0.0))).alias("map50_95"))
    return out.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("map50", "map75", "map50_95")])


def class_metrics(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, image: str = "image") -> DataFrame:
    """cls, tp, fp, fn, precision, recall, f1 of every class that has boxes or predictions, matched within classes."""
    hits = _greedy(gt, pred, threshold, image, by_class=True)
    counts = [df.groupBy("cls").agg(F.count("*").alias(n)) for df, n in ((gt, "boxes"), (pred, "made"), (hits, "tp"))]
    out = counts[0].join(counts[1], "cls", "full").join(counts[2], "cls", "left").fillna(0, ["boxes", "made", "tp"])
    out = out.select("cls", "tp", (F.col("made") - F.col("tp")).alias("fp"), (F.col("boxes") - F.col("tp")).alias("fn"))
    return with_ratios(out)


def mean_metrics(per_class: DataFrame) -> DataFrame:
    """precision, recall, f1: means over the classes that have boxes."""
    return per_class.where("tp + fn > 0").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def select_examples(df: DataFrame, n: int = 15) -> tuple[DataFrame, DataFrame]:
    """(the n most confident hits, the n first errors by id and category)."""
    hits = df.where(F.col("categoria") == HIT).orderBy(F.desc("confianza"), "source_asset_id", "iou").limit(n)
    errors = df.where(F.col("categoria") != HIT).orderBy("source_asset_id", "categoria", "confianza").limit(n)
    return hits, errors


def hardest(df: DataFrame, n: int = 15) -> DataFrame:
    """The n hits that overlap least."""
    return df.where(F.col("categoria") == HIT).orderBy("iou", "source_asset_id", "confianza").limit(n)


def infer(images: DataFrame, predictor, schema: str, conf: float = 0.25, limit: int | None = None, order: str = "path") -> DataFrame:
    """Predictions of a user's model: ``predictor`` maps batches of rows (pandas) to rows of ``schema``, which has ``conf``."""
    if not 0 <= conf <= 1:
        raise ValueError("conf must be in [0, 1]")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    if limit is not None:
        images = images.orderBy(order).limit(limit)
    return images.mapInPandas(lambda batches: (predictor(b) for b in batches), schema).where(F.col("conf") >= conf)


THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(10)]


def evaluate(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, image: str = "image", method: str = "trapz101") -> tuple[DataFrame, DataFrame]:
    """(example rows, one row of tp, fp, fn over all, and means over classes: precision, recall, f1, map50, map75, map50_95).

    Examples are matched whatever their class, as the published analysis of errors is; means are of matches within classes.
    """
    require_ground_truth(gt)
    gt, pred = staged(gt, "boxes"), staged(pred, "predictions")
    found = examples(gt, pred, match_greedy(gt, pred, threshold, image), image)
    aps = average_precision(curve(true_positives(gt, pred, THRESHOLDS, image), gt), method)
    counts = precision_recall(found).select("tp", "fp", "fn")
    return found, counts.join(mean_metrics(class_metrics(gt, pred, threshold, image))).join(mean_average_precision(aps, gt))
