"""The command line: python -m lodestone COMMAND."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from lodestone.plans import pipeline
from lodestone.plans.report import bar

logger = logging.getLogger("lodestone")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description="Static analysis of application packages.")
    loud = top.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_true", help="say more")
    loud.add_argument("-q", "--quiet", action="store_true", help="say errors only")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, said: str, *places: str, formats: bool = False) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=said)
        for place in places:
            made.add_argument(place)
        if formats:
            made.add_argument("-f", "--format", default="markdown,json", help="markdown, json or both")
        return made

    analyze = command("analyze", "ingest, decompile, scan and report", "package", formats=True)
    analyze.add_argument("--skip-decompile", action="store_true")
    ingest = command("ingest", "unpack a package and keep its facts", "package")
    decompile = command("decompile", "run the tools that the engine asks for", "package", "workdir")
    for made in (analyze, ingest):
        made.add_argument("-o", "--output", default="./analysis-output")
    for made in (analyze, decompile):
        made.add_argument("--jadx-path", default="jadx")
    command("scan", "scan the sources of a working directory", "workdir")
    command("report", "report what ingest and scan kept", "workdir", formats=True)
    command("reconstruct", "write a project of the classes found", "workdir").add_argument("-o", "--output")
    command("compare", "compare two source trees", "original", "reconstructed").add_argument("-o", "--output", default="./comparison-report.md")
    return top


def run(spark: SparkSession, options: argparse.Namespace) -> str:
    """Runs one command and says in a line or two what came out."""
    formats = [f.strip().lower() for f in getattr(options, "format", "").split(",")]
    paths = {"jadx": getattr(options, "jadx_path", "jadx")}
    match options.command:
        case "analyze":
            made = pipeline.analyze(spark, options.package, options.output, () if options.skip_decompile else None, formats, paths)
            return "\n".join(made.values())
        case "ingest":
            found = pipeline.ingest(spark, options.package, options.output)
            return f"{found['manifest']['packageName']}: {found['meta']['engine']}"
        case "decompile":
            return "\n".join(f"{t}: {x['error'] or x['output_dir']}" for t, x in pipeline.decompile(spark, options.package, options.workdir, paths=paths).items())
        case "scan":
            return "\n".join(f"{k}: {v}" for k, v in pipeline.scan_workdir(spark, options.workdir).summary().items())
        case "report":
            return "\n".join(pipeline.report(spark, options.workdir, formats).values())
        case "reconstruct":
            meta = pipeline.reconstruct(spark, options.workdir, options.output)
            return f"{meta['classesReconstructed']} of {meta['classesFound']} classes, fidelity {meta['fidelityScore']}%"
        case _:
            overall = pipeline.compare(spark, options.original, options.reconstructed, options.output).overall().first()[0]
            return bar(overall, 20)


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    level = logging.DEBUG if options.verbose else logging.ERROR if options.quiet else logging.INFO
    logging.basicConfig(level=logging.WARNING, format="%(message)s")
    logger.setLevel(level)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    try:
        said = run(spark, options)
    except (ValueError, OSError) as failure:
        logger.error("%s", failure)
        return 1
    if not options.quiet:
        print(said)
    return 0


if __name__ == "__main__":
    sys.exit(main())
