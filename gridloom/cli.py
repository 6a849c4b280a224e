"""Command line: check or time a MatrixMarket file, or report on a folder of logs.

python -m gridloom.cli matrix FILE --mode reconstruct,vector,perf|correctness|all
python -m gridloom.cli laplacian OUT --shape 100 100 [--periodic] [--shift S] [--order 1 0] [--anisotropy 1 2]
python -m gridloom.cli banded OUT --n N --m M [--near 1 2] [--margin 0.1]
python -m gridloom.cli random OUT --n N --density D [--seed S]
python -m gridloom.cli logs FOLDER [--csv OUT] [--md] [--by-matrix] [--baseline N] [--phase P ...]
python -m gridloom.cli strict FOLDER [--csv OUT]        samples by the ranks that lines state
python -m gridloom.cli runtimes FOLDER [--csv OUT]      mean runtimes of reconstruction and vector tests
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import logs, runs
from .sources import generators
from .sources.mtx import read_mtx, write_mtx

MODES = {"correctness": ("reconstruct", "vector"), "all": ("reconstruct", "vector", "perf")}


def _modes(text: str) -> list[str]:
    return list(dict.fromkeys(x for m in text.split(",") for x in MODES.get(m, (m,))))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = parser.add_subparsers(dest="kind", required=True)
    one = kinds.add_parser("matrix")
    one.add_argument("file")
    one.add_argument("--mode", default="correctness")
    one.add_argument("--blocks", type=int, nargs="+", default=[1])
    one.add_argument("--trials", type=int, default=3)
    one.add_argument("--perf-reps", type=int, default=20)
    one.add_argument("--seed", type=int, default=42)
    two = kinds.add_parser("logs")
    two.add_argument("folder")
    two.add_argument("--csv")
    two.add_argument("--md", action="store_true")
    two.add_argument("--by-matrix", action="store_true")
    two.add_argument("--baseline", type=int, default=1)
    two.add_argument("--phase", action="append")
    for kind in ("strict", "runtimes"):
        more = kinds.add_parser(kind)
        more.add_argument("folder")
        more.add_argument("--csv")
    grid = kinds.add_parser("laplacian")
    grid.add_argument("--shape", type=int, nargs="+", required=True)
    grid.add_argument("--periodic", action="store_true")
    grid.add_argument("--shift", type=float, default=0.0)
    grid.add_argument("--order", type=int, nargs="+")
    grid.add_argument("--anisotropy", type=float, nargs="+")
    band = kinds.add_parser("banded")
    band.add_argument("--n", type=int, required=True)
    band.add_argument("--m", type=int, required=True)
    band.add_argument("--near", type=int, nargs="+", default=[1, 2])
    band.add_argument("--margin", type=float, default=0.1)
    drawn = kinds.add_parser("random")
    drawn.add_argument("--n", type=int, required=True)
    drawn.add_argument("--density", type=float, required=True)
    drawn.add_argument("--seed", type=int, default=0)
    for made in (grid, band, drawn):
        made.add_argument("out")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.kind == "banded":
        generators.write_banded(spark, given.out, given.n, given.m, given.near, margin=given.margin)
        return 0
    if given.kind in ("laplacian", "random"):
        found = generators.laplacian(spark, given.shape, given.periodic, given.shift, given.order, given.anisotropy) if given.kind == "laplacian" else generators.random_dominant(spark, given.n, given.density, given.seed)
        write_mtx(found, given.out)
        return 0
    if given.kind in ("strict", "runtimes"):
        found = logs.lines(spark, given.folder)
        found = logs.strict_summary(found).orderBy("matrix", "phase", "ranks") if given.kind == "strict" else logs.runtime_summary(logs.runtimes(found)).orderBy("size", "density", "workers")
        print(logs.text_table(found))
        if given.csv:
            logs.write_csv(found, given.csv)
        return 0
    if given.kind == "matrix":
        modes, ok = _modes(given.mode), True
        if unknown := set(modes) - {"reconstruct", "vector", "sanity", "perf"}:
            parser.error(f"no such mode: {', '.join(sorted(unknown))}")
        matrix, name = read_mtx(spark, given.file), given.file.rpartition("/")[2]
        if checks := [m for m in modes if m != "perf"]:
            found = runs.correctness(spark, name, matrix, given.blocks, checks, given.trials, given.seed)
            ok = all(r["passed"] for r in found.collect())
            print(logs.text_table(found))
        if "perf" in modes:
            print(logs.text_table(runs.perf(spark, name, matrix, given.blocks, given.perf_reps)))
        print("OVERALL: " + ("PASSED" if ok else "FAILED"))
        return 0 if ok else 1
    lines = logs.lines(spark, given.folder)
    summary = logs.summary(logs.samples(lines))
    phases = given.phase or logs.PHASES
    report = logs.by_matrix(summary, phases, given.md) if given.by_matrix else logs.by_workers(summary, given.baseline, phases, given.md)
    print(logs.text_table(report, given.md))
    for r in logs.issues(lines).orderBy("file", "message").collect():
        print(f"- {r['file']}: {r['message']}")
    if given.csv:
        logs.write_csv(summary.orderBy("matrix", "phase", "workers"), given.csv)
    return 0


if __name__ == "__main__":
    sys.exit(main())
