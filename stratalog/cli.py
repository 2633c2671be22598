"""python -m stratalog run program.dl -F facts -D out [-I dir] [-p log] [-o out.sqlite] [-j n] [--explain]
python -m stratalog profile log [top | rel [name] | graph name]"""

from __future__ import annotations

import argparse
import sys

from . import profiling
from .language.diagnostics import ProgramError


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratalog", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("program")
    run.add_argument("-F", "--facts", default=".", help="folder of the fact files")
    run.add_argument("-D", "--output", default=".", help="folder of the results, - for the console, '' for none")
    run.add_argument("-I", "--include", action="append", default=[])
    run.add_argument("-M", "--macro", action="append", default=[], help="NAME=VALUE")
    run.add_argument("-o", "--sqlite")
    run.add_argument("-p", "--profile")
    run.add_argument("-j", "--jobs", default="*")
    run.add_argument("-v", "--verbose", action="store_true")
    run.add_argument("--number-bits", type=int, default=32, choices=(32, 64))
    run.add_argument("--missing-facts-are-empty", action="store_true")
    run.add_argument("--parts", action="store_true", help="results as folders, written by the executors")
    run.add_argument("--explain", action="store_true")
    show = sub.add_parser("profile")
    show.add_argument("log")
    show.add_argument("what", nargs="*", default=["rel"])
    a = parser.parse_args(argv)
    if a.command == "profile":
        print(profiling.report(profiling.load(a.log), a.what[0], a.what[1] if len(a.what) > 1 else None))
        return 0
    from pyspark.sql import SparkSession

    from .engine import Engine

    spark = SparkSession.builder.appName("stratalog").master(f"local[{a.jobs}]").getOrCreate() if SparkSession.getActiveSession() is None else SparkSession.getActiveSession()
    try:
        engine = Engine.from_file(a.program, spark, include_dirs=a.include, macros=dict(m.partition("=")[::2] for m in a.macro), number_bits=a.number_bits, strict_inputs=not a.missing_facts_are_empty)
    except ProgramError as e:
        print(e, file=sys.stderr)
        return 1
    for d in engine.diagnostics:
        print(d.show(engine.sources), file=sys.stderr)
    if a.explain:
        print(engine.explain())
        return 0
    engine.load_all(a.facts)
    engine.run()
    for m in engine.messages:
        print(m, file=sys.stderr)
    engine.write_all(a.output, single_file=not a.parts)
    if a.sqlite:
        engine.dump_sqlite(a.sqlite)
    if a.profile:
        profiling.save(engine.log, a.profile)
    if a.verbose:
        print(engine.profile(), file=sys.stderr)
    return 0
