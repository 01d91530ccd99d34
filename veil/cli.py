"""Command line: detect, preview, config, anonymize, wizard; ``veil FILE`` is short for ``veil anonymize FILE``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from veil import api
from veil.errors import VeilError, format_error
from veil.plans.policy import STRATEGIES, Policy, validate
from veil.sources.files import anonymize_file, file_type, split_extension

COMMANDS = ("detect", "preview", "config", "anonymize", "wizard")


def session() -> SparkSession:
    return SparkSession.builder.appName("veil").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veil", description="Finds and rewrites personal data.")
    sub = top.add_subparsers(dest="command")
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("file", nargs="?" if name in ("config", "wizard") else None)
        if name == "preview":
            p.add_argument("-n", "--rows", type=int, default=5)
        if name == "config":
            p.add_argument("--generate", action="store_true")
            p.add_argument("-o", "--output")
        if name in ("anonymize", "preview"):
            p.add_argument("-s", "--strategy", choices=STRATEGIES, default="replace")
            p.add_argument("-c", "--columns", type=lambda s: s.split(","))
        if name == "anonymize":
            p.add_argument("-o", "--output")
            p.add_argument("--config", help="JSON file with a policy")
            p.add_argument("--seed", default=0)
            p.add_argument("--locale", default="en_US")
            p.add_argument("--dry-run", action="store_true")
    return top


def _config(path: str) -> Policy:
    with open(path) as f:
        config = json.load(f)
    if faults := validate(config):
        raise VeilError("; ".join(faults))
    return Policy.of(config)


def wizard(spark: SparkSession, path: str | None, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> int:
    """Source, fields, strategy, preview, run; each step asks and takes the default on an empty answer."""
    path = path or ask("File: ")
    found = api.detect_pii(path, spark)
    say("Fields: " + (", ".join(f"{f} ({k})" for f, k in found.items()) or "none"))
    if not found:
        return 1
    columns = [c.strip() for c in ask("Columns (all): ").split(",") if c.strip()]
    strategy = ask("Strategy (replace): ").strip() or "replace"
    if strategy not in STRATEGIES:
        say(f"No such strategy: {strategy}")
        return 1
    for row in api.preview(path, 3, strategy, spark=spark, columns=columns or None):
        say(json.dumps(row, default=str))
    target = ask("Output: ").strip() or split_extension(path, "anonymized")
    if ask("Run? (y/n) ").strip().lower() not in ("y", "yes"):
        return 1
    say(json.dumps(api.anonymize(path, target, strategy, spark=spark, columns=columns or None)))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if args and args[0] not in COMMANDS and not args[0].startswith("-"):
        args = ["anonymize", *args]
    o = parser().parse_args(args)
    if not o.command:
        parser().print_help()
        return 1
    try:
        if o.command == "config":
            config = {f: {"strategy": "replace", "type": k} for f, k in api.detect_pii(o.file, spark or session()).items()} if o.file else {"email": {"strategy": "replace", "type": "email"}, "ssn": {"strategy": "mask", "preserve_last": 4}}
            text = json.dumps(config, indent=2)
            if o.output:
                with open(o.output, "w") as f:
                    f.write(text)
            else:
                print(text)
            return 0
        spark = spark or session()
        if o.command == "wizard":
            return wizard(spark, o.file)
        if o.command == "detect":
            print(json.dumps(api.detect_pii(o.file, spark), indent=2))
        elif o.command == "preview":
            print(json.dumps(api.preview(o.file, o.rows, o.strategy, spark=spark, columns=o.columns), indent=2, default=str))
        elif o.config and not o.dry_run:
            print(json.dumps(anonymize_file(spark, o.file, o.output or split_extension(o.file, "anonymized"), _config(o.config), format=file_type(o.file))))
        else:
            print(json.dumps(api.anonymize(o.file, o.output, o.strategy, dry_run=o.dry_run, spark=spark, columns=o.columns, seed=o.seed, locale=o.locale), default=str))
        return 0
    except Exception as e:
        print(format_error(e), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
