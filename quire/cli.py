"""Command line: ``python -m quire classify FILE`` and ``python -m quire review MANIFEST [DECISIONS]``; JSON goes to stdout.

Only problems of arguments and inputs are named. Any other failure is reported by one fixed sentence, as an error can echo a
document or a path. PDF and OCR engines are named as ``module:function``; nothing is sent anywhere unless ``--model`` is given,
and then to a server on this machine only.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fallback, model, review, rules, validate
from .operators.validate import InvalidInput
from .sources import readers, writers

FAILED = "The run failed. Check the input's format and the engines that were named. No document was sent elsewhere or changed."


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise InvalidInput(f"{message}. Use --help for usage.")


def _parser() -> argparse.ArgumentParser:
    parser = _Parser(prog="quire")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("classify", help="print a review manifest of one file's pages")
    one.add_argument("file")
    one.add_argument("--extractor", help="module:function from a PDF file's bytes to page records")
    one.add_argument("--second-reader", help="module:function from (file, page numbers) to page records, for pages that were not readable")
    one.add_argument("--model", action="store_true", help="ask a server on this machine about pages that the rules leave open")
    one.add_argument("--model-url")
    one.add_argument("--model-name", choices=sorted(model.LOCAL_CONTEXT))
    two = commands.add_parser("review", help="print a decisions template, or measure decisions")
    two.add_argument("manifest")
    two.add_argument("decisions", nargs="?")
    return parser


def _plugin(name: str) -> Callable:
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError):
        raise InvalidInput("An engine is named module:function, and must be importable.") from None


def _local_model(url: str | None, name: str | None) -> model.HttpBackend:
    backend = model.local_backend(**{k: v for k, v in (("url", url), ("model", name)) if v is not None})
    try:
        with urllib.request.urlopen(f"{backend.url}/health", timeout=5) as answer:
            healthy = 200 <= answer.status < 300
    except OSError:
        healthy = False
    if not healthy:
        raise InvalidInput(f"No model server answered at {backend.url}/health.")
    return backend


def classify(spark: SparkSession, args: argparse.Namespace) -> str:
    if not args.model and (args.model_url is not None or args.model_name is not None):
        raise InvalidInput("--model-url and --model-name need --model.")
    backend = _local_model(args.model_url, args.model_name) if args.model else None
    pages = readers.read_pages(spark, args.file, _plugin(args.extractor) if args.extractor else None)
    if args.second_reader:
        pages = fallback.retry(pages, _plugin(args.second_reader), check_batch=True)
    results = model.classify_with_model(rules.classify(pages), backend, allow=backend is not None, policy="uncertain")
    return writers.manifest_json(results, with_model=backend is not None).first().json


def _single(found: DataFrame):
    rows = found.limit(2).collect()
    if len(rows) != 1:
        raise InvalidInput("Supply exactly one file.")
    return rows[0]


def _plain(part: object) -> object:
    """A part of a summary: a table of at most a pack's rows, or a fixed field."""
    if not isinstance(part, DataFrame):
        return part
    return [json.loads(r.j) for r in part.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def measure(spark: SparkSession, args: argparse.Namespace) -> str:
    manifest = readers.read_manifest(spark, args.manifest)
    found = _single(manifest.select("sha256", "schemaVersion"))
    results = validate.require_manifest(manifest.select(F.explode("results").alias("r")).select("r.*"), found.schemaVersion)
    if args.decisions is None:
        return writers.template_json(review.decision_template(results, found.sha256), found.sha256).first().json
    read = readers.read_decisions(spark, args.decisions)
    header = read.select("schemaVersion", "manifestSha256", "reviewer", "reviewedAt")
    said = _single(header)
    decisions = validate.require_decisions(header, read.select(F.explode("decisions").alias("d")).select("d.*"))
    summary = review.summarise(results, decisions, found.sha256, said.manifestSha256, said.reviewer, said.reviewedAt)
    parts = {name: _plain(part) for name, part in summary.items()}
    return json.dumps(parts | {"counts": parts["counts"][0]}, ensure_ascii=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
        session = spark or SparkSession.builder.appName("quire").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        text = (classify if args.command == "classify" else measure)(session, args)
        print(json.dumps(json.loads(text), indent=2, ensure_ascii=False))
        return 0
    except InvalidInput as problem:
        print(problem, file=sys.stderr)
    except Exception:  # noqa: BLE001 - an error can echo the document or its path
        print(FAILED, file=sys.stderr)
    return 1
