"""Command line: ``python -m sieveline.cli config.toml`` audits, ``... check --files a.csv`` checks one dataset.

Exit status: 0 passed, 2 a finding blocks (or, with --strict, any finding), 1 an error.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .plans import audit, report
from .plans.config import RULES, Config, ConfigError, load, settings_of

SOURCES = {"files": {"nargs": "+"}, "smiles_column": {}, "identifier_columns": {"nargs": "+"}, "report_output": {}}


def flag_of(name: str) -> dict:
    """How a setting is given on the command line: switches that are off by default have no opposite."""
    default = RULES[name].default
    if isinstance(default, bool):
        return {"action": argparse.BooleanOptionalAction if default else "store_const", **({} if default else {"const": True})}
    return {"type": type(default)}


def parser_of(check: bool) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sieveline check" if check else "sieveline", exit_on_error=False)
    parser.add_argument("--config" if check else "config", help="a TOML file")
    if check:
        for name, how in [*SOURCES.items(), *((n, flag_of(n)) for n, rule in RULES.items() if rule.check)]:
            parser.add_argument("--" + name.replace("_", "-"), **how)
    parser.add_argument("--strict", action="store_true", help="findings to review fail, too")
    parser.add_argument("-v", "--verbose", action="store_true", help="say more")
    return parser


def config_of(argv: list[str]) -> tuple[Config, argparse.Namespace]:
    check = argv[:1] == ["check"]
    args, strange = parser_of(check).parse_known_args(argv[1:] if check else argv)
    if strange:
        raise ConfigError(f"unknown arguments: {' '.join(strange)}")
    given = {k: v for k, v in vars(args).items() if v is not None and k not in ("config", "strict", "verbose")}
    if args.config and given:
        raise ConfigError(f"--config goes without {', '.join(sorted(given))}")
    if args.config:
        return load(args.config, check), args
    if "files" not in given:
        raise ConfigError("either --config or --files is needed")
    settings = settings_of({k: v for k, v in given.items() if k in RULES}, given.get("report_output"), check)
    return Config(**{k: v for k, v in given.items() if k in SOURCES}, settings=settings), args


def exit_code(summary: dict, strict: bool) -> int:
    return 2 if summary["status"] == "FAIL" or (strict and summary["status"] == "WARN") else 0


def main(argv: list[str] | None = None) -> int:
    try:
        config, args = config_of(sys.argv[1:] if argv is None else argv)
        logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
        made = audit.run(SparkSession.builder.appName("sieveline").getOrCreate(), config)
    except SystemExit as e:  # argparse's own ends: help, or arguments that lack
        return 0 if not e.code else 1
    except (ValueError, FileNotFoundError, argparse.ArgumentError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    print(report.dashboard(made))
    if config.report_output:
        print(f"report: {config.report_output}")
    return exit_code(made["summary"], args.strict)


if __name__ == "__main__":
    sys.exit(main())
