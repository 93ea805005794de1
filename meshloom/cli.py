"""python -m meshloom.cli generate|extrude|partition|check ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from meshloom.plans import pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meshloom", description="Meshes as relations on Spark.")
    p.add_argument("-v", action="count", default=0, help="more log output")
    sub = p.add_subparsers(dest="program", required=True)
    g = sub.add_parser("generate", help="configuration file to a mesh")
    g.add_argument("config")
    g.add_argument("out")
    e = sub.add_parser("extrude", help="planar mesh to one layer of cells")
    e.add_argument("mesh")
    e.add_argument("out")
    e.add_argument("--dz", type=float)
    t = sub.add_parser("partition", help="mesh to local meshes")
    t.add_argument("mesh")
    t.add_argument("out")
    t.add_argument("-k", type=int, default=8)
    t.add_argument("--method", choices=sorted(pipeline.METHODS), default="hilbert")
    t.add_argument("--reorder", choices=["NONE", "RCM", "SFC", "HILBERT_SFC"], default="NONE")
    t.add_argument("--ghosts", choices=["face", "vertex"], default="face")
    t.add_argument("--refine", type=int, default=0)
    t.add_argument("--bc")
    t.add_argument("--vtu")
    c = sub.add_parser("check", help="validate local meshes")
    c.add_argument("mesh")
    c.add_argument("--dump-vtu")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.v, 2)])
    spark = SparkSession.builder.appName("meshloom").getOrCreate()
    if a.program == "generate":
        text = "\n".join(r[0] for r in spark.read.text(a.config).collect())
        pipeline.generate(spark, text, a.out)
    elif a.program == "extrude":
        pipeline.extrude(spark, a.mesh, a.out, a.dz)
    elif a.program == "partition":
        pipeline.run_partition(spark, a.mesh, a.out, a.k, a.bc, a.vtu, method=a.method, order=a.reorder, ghosts=a.ghosts, refine_rounds=a.refine)
    else:
        pipeline.check(spark, a.mesh, a.dump_vtu).orderBy("part").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
