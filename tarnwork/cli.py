"""Command line: crawl, boxes, split, train, evaluate, predict, validate, samples. ``python -m tarnwork.cli <command> --help``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

import yaml
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import reproducibility
from tarnwork.functions.boxes import class_name, corners
from tarnwork.operators import evaluation, masks, quality, splits
from tarnwork.plans import crawl as crawls
from tarnwork.schemas import BOX_AUDIT
from tarnwork.scratch import staged
from tarnwork.sources import readers, sinks, web
from tarnwork.sources import samples as made


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def crawl(args: argparse.Namespace) -> int:
    """Discover products, fetch and check them, and bring manifest, rejections, images and summary up to date.

    Without a mode only the configuration is checked and nothing is fetched.
    """
    if args.full_crawl and args.limit is not None:
        raise ValueError("--limit needs --smoke-test")
    config = reproducibility.check_crawl_config(reproducibility.read_yaml(args.config), "full" if args.full_crawl else "smoke")
    if not (args.full_crawl or args.smoke_test):
        print("configuration is valid; no mode given, nothing fetched")
        return 0
    chosen = {"images_dir": args.output_dir, "manifest": args.manifest}
    config["outputs"] |= {k: v for k, v in chosen.items() if v}
    http, start = config["http"], config["source"]["collection_url"]
    client = web.PoliteClient(http["user_agent"], http["delay_seconds"], http["timeout_seconds"], http["max_retries"], http["backoff_seconds"])
    rules = web.robots(client.get, start, http["user_agent"])
    allowed = lambda u: rules.can_fetch(http["user_agent"], u)
    if args.full_crawl:
        found, pages = web.discover(client.get, start, allowed)
    else:
        limit = args.limit or int(config["limits"]["max_products"])
        if not 1 <= limit <= int(config["limits"]["max_products"]):
            raise ValueError("--limit must lie within limits.max_products")
        web.check_robots(rules, http["user_agent"], start)
        found, pages = web.product_links(client.get(start).body.decode("utf-8", "replace"), start)[:limit], None
    print(json.dumps(crawls.run(session(), found, client.get, allowed, config, args.full_crawl, pages)))
    return 0


def boxes(args: argparse.Namespace) -> int:
    spark = session()
    hashes = readers.file_hashes(spark, args.images).select("stem", "sha256")
    images = readers.images(spark, args.images).join(hashes, "stem").select("image", F.col("stem").alias("source_asset_id"), F.substring_index("stem", "_", 1).alias("sku_id"), F.col("path").alias("image_path"), F.col("sha256").alias("source_sha256"))
    rgb = {"tolerance": args.tolerance, "delta": args.delta, "min_pixels": args.min_pixels} if args.rgb else None
    audit = masks.audit_images(images, args.labels, args.alpha_threshold, rgb=rgb)
    sinks.labels(audit, args.labels)
    sinks.csv(audit, args.audit, list(BOX_AUDIT))
    return 0


def split(args: argparse.Namespace) -> int:
    spark = session()
    rows = spark.read.csv(args.manifest, header=True, multiLine=True, escape='"')
    if "row_idx" not in rows.columns:  # files keep their order within a partition, partitions theirs
        rows = rows.coalesce(1).withColumn("row_idx", F.monotonically_increasing_id())
    done = splits.make_splits(rows, seed=reproducibility.validate_seed(args.seed))
    sinks.csv(done.orderBy(F.col("row_idx").cast("bigint")), args.output, [c for c in done.columns if c != "row_idx"])
    sinks.json_document(splits.leakage_report(done).first().asDict(), f"{args.output}.evidence.json")
    return 0


#: Categories of the examples; an analyst may divide them further by hand.
CATEGORIES = {evaluation.HIT: "a box met by a prediction that overlaps it enough", evaluation.MISS: "a box that no prediction meets", evaluation.FALSE: "a prediction that meets no box"}


def train(args: argparse.Namespace) -> int:
    """Resolve and record what a training run needs; ``--trainer module:function`` is then called with it."""
    folders = reproducibility.dataset_folders(args.data)
    settings = reproducibility.resolve_hyperparameters(reproducibility.read_yaml(args.config), args.seed, args.smoke)
    settings |= {"data": args.data, "config_source": str(Path(args.config).absolute()), "folders": folders}
    reproducibility.set_seeds(settings["seed"])
    out = sinks.prepare_output(args.output_dir, args.overwrite)
    (out / "resolved_config.yaml").write_text(yaml.safe_dump(settings, sort_keys=False, allow_unicode=True))
    sinks.json_document(reproducibility.environment() | {"seed": settings["seed"]}, str(out / "environment.json"))
    if args.trainer:
        named(args.trainer)(settings, str(out))
    return 0


def named(path: str):
    """The function ``module:name``; its module travels to the tasks, which need not have it."""
    module, _, name = path.partition(":")
    found = getattr(importlib.import_module(module), name)
    cloudpickle.register_pickle_by_value(sys.modules[found.__module__])
    return found


PREDICTED = "path string, class_id int, confidence double, x0 double, y0 double, x1 double, y1 double, inference_ms double"


def predict(args: argparse.Namespace) -> int:
    """Detections of a user's predictor ``module:function`` (batches of path, content -> ``PREDICTED``; an image without one: null class)."""
    if args.limit is not None and args.limit <= 0:
        raise ValueError("--limit must be above 0")
    if not 0 <= args.conf <= 1:
        raise ValueError("--conf must lie in [0, 1]")
    out = sinks.prepare_output(args.output_dir, args.overwrite)
    spark = session()
    images = readers.files(spark, args.input).orderBy("path")
    images = images.limit(args.limit) if args.limit else images
    predictor = named(args.predictor)
    made = staged(images.select("path", "content").mapInPandas(lambda batches: (predictor(b) for b in batches), PREDICTED), "predicted")
    kept = made.where(F.col("class_id").isNotNull() & (F.col("confidence") >= args.conf))
    found = F.struct("class_id", class_name(args.names.split(",") if args.names else {}, F.col("class_id")).alias("class_name"), "confidence", F.array("x0", "y0", "x1", "y1").alias("xyxy"))
    detections = kept.groupBy("path").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("_less"), found.alias("d")))).alias("ds"))
    speed = made.groupBy("path").agg(F.coalesce(F.max("inference_ms"), F.lit(0.0)).alias("inference_ms"))
    records = images.select("path").join(speed, "path", "left").join(detections, "path", "left").orderBy("path")
    records = records.select(F.element_at(F.split("path", "/"), -1).alias("image"), F.col("path").alias("source"), F.coalesce(F.transform("ds", lambda x: x["d"]), F.array()).alias("detections"), F.coalesce("inference_ms", F.lit(0.0)).alias("inference_ms"))
    rows = [json.loads(r["line"]) for r in records.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator()]
    times = [r["inference_ms"] for r in rows]
    head = {"device": args.device, "n_images": len(rows), "mean_inference_ms": sum(times) / len(times) if times else 0.0}
    model = {"model": args.model, "model_sha256": reproducibility.file_sha256(args.model)} if args.model else {"model": args.predictor}
    sinks.json_document(model | head | {"conf_threshold": args.conf, "predictions": rows}, str(out / "predictions.json"))
    sinks.json_document(head | {"inference_ms": times}, str(out / "timing_summary.json"))
    return 0


def evaluate(args: argparse.Namespace) -> int:
    """Labels of a folder against a predictions table (stem, pred_idx, conf, x0, y0, x1, y1, width, height, maybe cls)."""
    evaluation.require_unlocked(args.split, args.allow_test)
    if not (args.labels or args.data):
        raise ValueError("--labels or --data is needed")
    folder = args.labels or labels_of(reproducibility.dataset_folders(args.data)[args.split])
    out = sinks.prepare_output(args.output_dir, args.overwrite)
    spark = session()
    raw = spark.read.parquet(args.predictions).where(F.col("conf") >= args.conf)
    kind = F.col("cls") if "cls" in raw.columns else F.lit(0)
    pred = raw.select(F.col("stem").alias("image"), "pred_idx", kind.cast("int").alias("cls"), "conf", *[F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), evaluation.PRED)])
    sizes = raw.groupBy("stem").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    gt = readers.labels(spark, folder).join(sizes, "stem", "left").fillna(1, ["width", "height"])
    gt = gt.select(F.col("stem").alias("image"), "gt_idx", F.col("class").cast("int").alias("cls"), *[c.alias(n) for c, n in zip(corners(*[F.col(c) for c in ("cx", "cy", "w", "h", "width", "height")]), evaluation.GT)])
    found, metrics = evaluation.evaluate(gt, pred, args.iou)
    found = staged(found, "examples")
    asked = {"split": args.split, "conf_threshold": args.conf, "iou_threshold": args.iou, "n_ground_truths": gt.count()}
    sinks.json_document(asked | metrics.first().asDict() | {"environment": reproducibility.environment(spark)}, str(out / "metrics.json"))
    if args.model:
        sinks.json_document(reproducibility.weight_manifest(args.model), str(out / "weight_manifest.json"))
    boxes_ = F.sort_array(F.collect_list(F.struct("pred_idx", F.array(*evaluation.PRED).alias("xyxy"), F.col("conf").alias("confianza"), F.col("cls").alias("clase"))))
    by_image = pred.groupBy(F.col("image").alias("source_asset_id")).agg(boxes_.alias("predicciones")).orderBy("source_asset_id")
    lines = by_image.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator()
    sinks.json_document([json.loads(r["line"]) for r in lines], str(out / "predictions" / "predictions.json"))
    hits, errors = evaluation.select_examples(found)
    sinks.csv(hits.unionByName(errors), str(out / "error_examples.csv"), ["source_asset_id", "categoria", "confianza", "iou", "hipotesis"])
    (out / "error_categories_README.txt").write_text("".join(f"{name}: {what}\n" for name, what in CATEGORIES.items()))
    return 0


def labels_of(images: str) -> str:
    """The labels folder of an images folder: its last part ``images`` turned into ``labels``."""
    parts = list(Path(images).parts)
    if "images" not in parts:
        raise ValueError(f"no part named images: {images}")
    parts[len(parts) - 1 - parts[::-1].index("images")] = "labels"
    return str(Path(*parts))


def samples(args: argparse.Namespace) -> int:
    """Synthetic data: ``splits`` (manifest with its split), ``boxes`` (images with their audit), ``detection`` (images, labels, dataset YAML)."""
    spark = session()
    if args.kind == "splits":
        done = splits.make_splits(readers.synthetic_manifest(spark), seed=reproducibility.validate_seed(args.seed))
        sinks.csv(done.orderBy("row_idx"), f"{args.output_dir}/splits_synthetic.csv", [c for c in done.columns if c != "row_idx"])
        sinks.json_document(splits.leakage_report(done).first().asDict(), f"{args.output_dir}/splits_synthetic.evidence.json")
    elif args.kind == "boxes":
        made.audit_sample(f"{args.output_dir}/images")
        return boxes(argparse.Namespace(images=f"{args.output_dir}/images", labels=f"{args.output_dir}/labels", audit=f"{args.output_dir}/box_audit.csv", alpha_threshold=127, rgb=False))
    else:
        made.detection_set(spark, args.output_dir, {"train": args.n_train, "val": args.n_val, "test": args.n_test}, args.seed)
    return 0


def validate(args: argparse.Namespace) -> int:
    spark = session()
    quality.check_no_orphans(readers.files(spark, args.images).select("stem"), readers.labels(spark, args.labels).select("stem").distinct())
    row = quality.label_invariants(readers.labels(spark, args.labels).withColumnRenamed("stem", "source_asset_id")).first().asDict()
    print(json.dumps(row))
    return int(row["invalid_boxes"] > 0 or row["not_exactly_one"] > 0)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnwork")
    sub = top.add_subparsers(required=True)

    def command(f, *options):
        p = sub.add_parser(f.__name__)
        for name, extra in options:
            p.add_argument(name, **extra)
        p.set_defaults(run=f)
        return p

    flag, need = {"action": "store_true"}, {"required": True}
    p = command(crawl, ("--config", need), ("--limit", {"type": int}), ("--output-dir", {}), ("--manifest", {}))
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--smoke-test", **flag)
    mode.add_argument("--full-crawl", **flag)
    command(boxes, ("--images", need), ("--labels", need), ("--audit", need), ("--alpha-threshold", {"type": int, "default": 127}), ("--rgb", flag), ("--tolerance", {"type": float, "default": 5.0}), ("--delta", {"type": float, "default": 30.0}), ("--min-pixels", {"type": int, "default": 10}))
    command(split, ("--manifest", need), ("--output", need), ("--seed", {"type": int, "default": 42}))
    command(train, ("--config", need), ("--data", need), ("--output-dir", need), ("--seed", {"type": int}), ("--smoke", flag), ("--trainer", {}), ("--overwrite", flag))
    command(predict, ("--predictor", need), ("--model", {}), ("--input", need), ("--output-dir", need), ("--device", {"default": "cpu"}), ("--conf", {"type": float, "default": 0.25}), ("--limit", {"type": int}), ("--names", {}), ("--overwrite", flag))
    command(samples, ("kind", {"choices": ["splits", "boxes", "detection"]}), ("--output-dir", need), ("--seed", {"type": int, "default": 42}), ("--n-train", {"type": int, "default": 8}), ("--n-val", {"type": int, "default": 4}), ("--n-test", {"type": int, "default": 4}))
    command(evaluate, ("--predictions", need), ("--labels", {}), ("--data", {}), ("--model", {}), ("--output-dir", need), ("--split", {"default": "val"}), ("--conf", {"type": float, "default": 0.25}), ("--iou", {"type": float, "default": 0.5}), ("--allow-test", flag), ("--overwrite", flag))
    command(validate, ("--images", need), ("--labels", need))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (ValueError, OSError, RuntimeError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
