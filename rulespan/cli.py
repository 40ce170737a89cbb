"""Command line: ``python -m rulespan.cli analyse [PATH ...]``.

The configuration is a Python file of the user's own, ``architecture.py`` or else
``architecture.dist.py`` in the project's folder, that defines ``architecture``.
"""

from __future__ import annotations

import argparse
import runpy
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rulespan.functions.names import resolve
from rulespan.operators import baseline
from rulespan.operators.psr4 import mapped_paths
from rulespan.plans import analysis, report
from rulespan.plans.architecture import Architecture
from rulespan.rules.base import Facts
from rulespan.sources import composer
from rulespan.sources.facts import FactStore
from rulespan.sources.php_facts import extract
from rulespan.sources.scan import scan

CONFIGS = ("architecture.py", "architecture.dist.py")


TEMPLATE = """\
from rulespan.plans import presets
from rulespan.plans.architecture import Architecture

architecture = Architecture().with_preset(presets.Psr12())
"""


class ConfigError(RuntimeError):
    """There is no configuration, or it defines no architecture."""


def discover(base_path: str) -> str:
    for name in CONFIGS:
        if (path := Path(base_path) / name).is_file():
            return str(path)
    raise ConfigError(f"none of {', '.join(CONFIGS)} is in {base_path}")


def load(path: str) -> Architecture:
    found = runpy.run_path(path).get("architecture")
    if not isinstance(found, Architecture):
        raise ConfigError(f"{path} defines no architecture")
    return found


def project_facts(spark: SparkSession, architecture: Architecture, base_path: str, paths: list[str] | None = None) -> Facts:
    """Facts of the files below ``paths``, or of all layers' paths. With a cache, only changed files are parsed."""
    mapping, state = composer.read(spark, base_path)
    mapped = [r.path for r in mapped_paths(mapping).orderBy("ordinal").collect()]
    files = scan(spark, paths or architecture.scan_paths(mapped), base_path=base_path, skip=architecture.skip_paths)
    tables = FactStore(spark, resolve(architecture.cache_path, base_path)).refresh(files, extract) if architecture.cache_path else extract(files)
    there = [(p,) for p in mapped if _is_folder(spark, f"{base_path.rstrip('/')}/{p}")]
    return Facts(base_path=base_path, psr4=mapping, composer_state=state, directories=spark.createDataFrame(there, "path string"), **tables)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def accepted(spark: SparkSession, architecture: Architecture, base_path: str) -> DataFrame | None:
    return baseline.read(spark, resolve(architecture.baseline_path, base_path)) if architecture.baseline_path else None


def analyse(spark: SparkSession, base_path: str, *, config: str | None = None, paths: list[str] | None = None, use_baseline: bool = True) -> analysis.Result:
    architecture = load(config or discover(base_path))
    known = accepted(spark, architecture, base_path) if use_baseline else None
    return analysis.run(architecture, project_facts(spark, architecture, base_path, paths), accepted=known)


def write(spark: SparkSession, base_path: str, path: str, *, config: str | None = None, paths: list[str] | None = None) -> int:
    """Violations as JSON lines in a new folder, from the executors; returns the exit code."""
    architecture = load(config or discover(base_path))
    found = analysis.violations(architecture, project_facts(spark, architecture, base_path, paths), accepted=accepted(spark, architecture, base_path))
    report.json_lines(found).write.text(path)
    return 0 if spark.read.text(path).isEmpty() else 1


def scaffold(base_path: str) -> str:
    """A configuration to start from, in the project's folder; an existing one is an error."""
    path = Path(base_path) / CONFIGS[0]
    if path.exists():
        raise ConfigError(f"{path} exists already")
    path.write_text(TEMPLATE)
    return str(path)


def assert_no_violations(spark: SparkSession, base_path: str, config: str | None = None) -> None:
    """For a project's own tests: raises AssertionError with the report if there is a violation."""
    result = analyse(spark, base_path, config=config)
    if not result.passed:
        raise AssertionError(report.console_report(result))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rulespan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("analyse", help="report violations")
    clear = commands.add_parser("clear-cache", help="forget extracted facts")
    start = commands.add_parser("init", help="write a configuration to start from")
    start.add_argument("--base-path", default=".")
    for p in (run, clear):
        p.add_argument("--base-path", default=".")
        p.add_argument("--config")
    run.add_argument("paths", nargs="*", help="where to look instead of the layers' paths")
    run.add_argument("--report", choices=("console", "json"), default="console")
    run.add_argument("--output", metavar="PATH", help="write violations there as JSON lines, however many, instead of a report")
    run.add_argument("--generate-baseline", metavar="PATH", help="accept all violations of now")
    args = parser.parse_args(argv)
    base = str(Path(args.base_path).resolve())
    if args.command == "init":
        try:
            print(scaffold(base))
        except ConfigError as problem:
            print(problem, file=sys.stderr)
            return 1
        return 0
    spark = SparkSession.builder.appName("rulespan").getOrCreate()
    try:
        if args.command == "clear-cache":
            architecture = load(args.config or discover(base))
            if architecture.cache_path:
                FactStore(spark, resolve(architecture.cache_path, base)).clear()
            return 0
        if args.generate_baseline:
            architecture = load(args.config or discover(base))
            found = analysis.violations(architecture, project_facts(spark, architecture, base, args.paths))
            baseline.write(found, resolve(args.generate_baseline, base), base)
            return 0
        if args.output:
            return write(spark, base, resolve(args.output, str(Path.cwd())), config=args.config, paths=args.paths)
        result = analyse(spark, base, config=args.config, paths=args.paths)
    except ConfigError as problem:
        print(problem, file=sys.stderr)
        return 1
    print(report.json_report(result) if args.report == "json" else report.console_report(result))
    return result.exit_code


if __name__ == "__main__":
    sys.exit(main())
