"""Command line: ``version``, ``list`` and ``process``."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

VERSION = "0.1.0"
log = logging.getLogger("lumenmill")


def load_configs(paths: list[str]) -> dict:
    """YAML or JSON files; of equal top-level keys the last holds."""
    merged: dict = {}
    for p in paths:
        text = Path(p).read_text()
        if p.endswith(".json"):
            part = json.loads(text)
        else:
            import yaml

            part = yaml.safe_load(text)
        if not isinstance(part, dict):
            raise ValueError(f"{p}: a mapping is needed")
        merged |= part
    return merged


def dump(config: dict, path: str) -> None:
    if path.endswith(".json"):
        Path(path).write_text(json.dumps(config, indent=2))
    else:
        import yaml

        Path(path).write_text(yaml.safe_dump(config, sort_keys=False))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenmill", description="Reproducible sample generation on Spark")
    level = top.add_mutually_exclusive_group()
    level.add_argument("-v", "--verbose", action="count", default=0)
    level.add_argument("-q", "--quiet", action="store_true")
    commands = top.add_subparsers(dest="command")
    commands.add_parser("version", help="print the version")
    commands.add_parser("list", help="list transformations, sources and models")
    run = commands.add_parser("process", help="run a job")
    run.add_argument("-p", "--process-config", nargs="+", required=True, help="configuration files, merged in order")
    run.add_argument("--save-config", help="write the merged configuration here")
    run.add_argument("--master", help="Spark master; the environment's by default")
    run.add_argument("--unordered", action="store_true", help="write the ledger in parallel, without an order")
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    logging.basicConfig(level=logging.ERROR if args.quiet else logging.DEBUG if args.verbose else logging.INFO)
    if args.command == "version":
        print(f"lumenmill {VERSION}")
        return 0
    if args.command == "list":
        from .operators.models import known_types
        from .operators.transformations import known
        from .plans.writers import known_writers
        from .sources.loaders import known_loaders

        for title, names in (("transformations", known()), ("dataloaders", known_loaders()), ("output writers", known_writers()), ("models", known_types())):
            print(f"{title}: {', '.join(sorted(names))}")
        return 0
    if args.command != "process":
        top.print_help()
        return 2
    try:
        config = load_configs(args.process_config)
    except (OSError, ValueError) as e:
        log.error("cannot read the configuration: %s", e)
        return 1
    except Exception as e:  # a YAML fault has its own type
        log.error("cannot parse the configuration: %s", e)
        return 1
    if args.save_config:
        dump(config, args.save_config)
    from .plans.config import parse
    from .plans.job import run_job
    from .session import session, ship

    try:
        parse(config)
        spark = session(**({"spark.master": args.master} if args.master else {}))
        ship(spark)
        for name, n in run_job(spark, config, ordered=not args.unordered).items():
            print(f"{name}: {n}")
    except (ValueError, RuntimeError) as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
