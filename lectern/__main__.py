"""Command line: ``python -m lectern <command> ...``."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from lectern.plans import reviews as R
from lectern.plans import workflows as W
from lectern.session import get_spark


def _choice(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--limit-pages", type=int)
    parser.add_argument("--sample-pages", type=int)
    parser.add_argument("--sample-seed", type=int, default=42)
    parser.add_argument("--page-keys")


def _chosen(args: argparse.Namespace) -> dict:
    from lectern.sources.files import read_page_keys

    chosen = {"limit": args.limit_pages, "sample": args.sample_pages, "keys": read_page_keys(args.page_keys) if args.page_keys else None}
    return chosen | ({"seed": args.sample_seed} if args.sample_pages else {})


def _factory(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="lectern")
    commands = main.add_subparsers(dest="command", required=True)
    p = commands.add_parser("evaluate", help="rates against ground truth for every results.jsonl below a folder")
    p.add_argument("results")
    p.add_argument("--manifest", required=True)
    p.add_argument("--output-dir", required=True)
    p = commands.add_parser("compare", help="two recognition logs against each other")
    p.add_argument("results_a")
    p.add_argument("results_b")
    p.add_argument("--model-a", required=True)
    p.add_argument("--model-b", required=True)
    p.add_argument("--inventory")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--review-threshold", type=float, default=0.70)
    p.add_argument("--complete-pages-only", action="store_true")
    p.add_argument("--allow-mismatched-input-kinds", action="store_true")
    for side in ("fluency-a", "fluency-b", "errors-a", "errors-b"):
        p.add_argument(f"--{side}")
    _choice(p)
    p = commands.add_parser("pages", help="pages of a log for review")
    p.add_argument("results")
    p.add_argument("--inventory")
    p.add_argument("--output-dir", required=True)
    _choice(p)
    p = commands.add_parser("ground-truth", help="manifest and labels from a mapping")
    p.add_argument("mapping")
    p.add_argument("--image-root", required=True)
    p.add_argument("--output-dir", required=True)
    p = commands.add_parser("profile", help="counts and statistics of a folder of images")
    p.add_argument("root")
    p.add_argument("--top-resolutions", type=int, default=10)
    p.add_argument("--max-images", type=int)
    p = commands.add_parser("prepare", help="image stages for a folder of images")
    p.add_argument("input")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--stage", choices=sorted(W.STAGES), default="all")
    p.add_argument("--kind", choices=sorted(W.SUFFIXES), default="image")
    for name, kind in (("fluency", "scores"), ("errors", "suspected errors")):
        p = commands.add_parser(name, help=f"a model's {kind} for the pages of a log; resumes what {name} run was interrupted")
        p.add_argument("results")
        p.add_argument("--recogniser", required=True, help="module:factory")
        p.add_argument("--inventory")
        p.add_argument("--output-dir", required=True)
        p.add_argument("--model", default="model")
        p.add_argument("--prompt-version", default="1")
        p.add_argument("--input-kind", choices=("auto", "raw", "processed", "mixed"), default="auto")
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--dry-run", action="store_true")
        _choice(p)
    p = commands.add_parser("recognise", help="texts of the images below a folder; resumes")
    p.add_argument("root")
    p.add_argument("--recogniser", required=True, help="module:factory")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--first-page", type=int)
    p.add_argument("--last-page", type=int)
    p.add_argument("--overwrite", action="store_true")
    return main


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_spark()
    if args.command == "evaluate":
        W.evaluate(spark, args.results, args.manifest, args.output_dir)["summary"].show(truncate=False)
    elif args.command == "compare":
        W.compare(spark, args.results_a, args.results_b, args.model_a, args.model_b, args.inventory, args.output_dir, args.review_threshold, args.complete_pages_only, args.allow_mismatched_input_kinds, (args.fluency_a, args.fluency_b), (args.errors_a, args.errors_b), **_chosen(args))["summary"].show(vertical=True)
    elif args.command == "pages":
        W.review_pages(spark, args.results, args.inventory, args.output_dir, **_chosen(args)).show()
    elif args.command == "ground-truth":
        W.ground_truth(spark, args.mapping, args.image_root, args.output_dir)["issues"].groupBy("issue").count().show()
    elif args.command == "profile":
        for table in W.corpus_profile(spark, args.root, args.top_resolutions, args.max_images).values():
            table.show(truncate=False)
    elif args.command == "prepare":
        W.prepare_folder(spark, args.input, args.output_dir, stage=args.stage, kind=args.kind).groupBy("status").count().show()
    elif args.command == "recognise":
        R.recognition_run(spark, args.root, _factory(args.recogniser), args.output_dir, first_page=args.first_page, last_page=args.last_page, overwrite=args.overwrite).groupBy("status").count().show()
    else:
        kind = R.FLUENCY if args.command == "fluency" else R.ERRORS
        made = R.review_run(spark, kind, args.results, _factory(args.recogniser), args.output_dir, args.inventory, model=args.model, prompt_version=args.prompt_version, input_kind=args.input_kind, overwrite=args.overwrite, dry_run=args.dry_run, **_chosen(args))
        made["pages" if args.dry_run else "summary"].show(vertical=True, truncate=False)


if __name__ == "__main__":
    main()
