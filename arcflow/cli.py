"""Command line: ranks of a binary edge file.

python -m arcflow.cli -f FILE -n NODES -e EDGES [--mode sync|async|mc|linf] [--target ID] [--output FOLDER]
python -m arcflow.cli --preset NAME --folder FOLDER
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from arcflow.graph import Graph
from arcflow.operators import active, fixed, layout, walk
from arcflow.sources import coo

# Nodes and edges of public web and social graphs by name.
PRESETS = {"stanford": (281_903, 2_312_497), "google": (875_713, 5_105_039), "livejournal": (4_847_571, 68_993_773)}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise ValueError(f"{self.format_usage()}{message}")


def parse(arguments: list[str]) -> argparse.Namespace:
    parser = _Parser(prog="arcflow", description="Ranks of the nodes of a binary edge file.")
    parser.add_argument("-f", "-F", dest="file")
    parser.add_argument("-n", "-N", dest="nodes", type=int)
    parser.add_argument("-e", "-E", dest="edges", type=int)
    parser.add_argument("--preset", choices=PRESETS)
    parser.add_argument("--folder", default="datasets")
    parser.add_argument("--mode", choices=("sync", "async", "mc", "linf"), default="sync")
    parser.add_argument("--iterations", type=int, default=fixed.ROUNDS, help="rounds of sync")
    parser.add_argument("--tolerance", type=float, default=fixed.TOLERANCE, help="change that async and linf allow")
    parser.add_argument("--damping", type=float, default=fixed.DAMPING)
    parser.add_argument("--length", type=int, default=walk.LENGTH, help="steps of a walk of mc")
    parser.add_argument("--seed", type=int, default=walk.SEED, help="of mc")
    parser.add_argument("--replicas", type=int, default=1, help="walks of mc from each node")
    parser.add_argument("--repeats", type=int, default=1, help="calls that each go on from the last one's values; not for mc, whose calls start anew")
    parser.add_argument("--strategy", default="auto", help="auto, blocks, broadcast or shuffle; walks go over blocks")
    parser.add_argument("--target", type=int, default=1)
    parser.add_argument("--output", help="folder for all ranks as Parquet")
    options = parser.parse_args(arguments)
    if options.preset:
        options.nodes, options.edges = PRESETS[options.preset]
        options.file = options.file or f"{options.folder}/{options.preset}.bin"
    if options.file is None or options.nodes is None or options.edges is None:
        parser.error("-f, -n and -e, or --preset, are needed")
    if options.mode == "mc" and options.repeats != 1:
        parser.error("--repeats has no meaning for mc; --replicas averages several walks")
    return options


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        options = parse(sys.argv[1:] if arguments is None else arguments)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("arcflow").getOrCreate()
    began = time.perf_counter()
    graph = Graph(coo.read_coo(spark, options.file, options.edges, options.nodes), spark.range(options.nodes))
    graph.blocks  # noqa: B018
    print(f"loading {(time.perf_counter() - began) * 1e6:.0f} us")
    began = time.perf_counter()
    compute = {
        "sync": lambda: fixed.rank_sync(graph, options.iterations, options.damping, options.repeats, options.strategy),
        "linf": lambda: fixed.rank_linf(graph, options.tolerance, options.damping, strategy=options.strategy, repeats=options.repeats),
        "async": lambda: active.rank_async(graph, options.tolerance, options.damping, options.repeats, strategy=options.strategy),
        "mc": lambda: walk.rank_monte_carlo(graph, options.length, options.replicas, options.seed, options.damping),
    }
    ranks = compute[options.mode]()
    print(f"computing {(time.perf_counter() - began) * 1e6:.0f} us")
    if options.output:
        ranks.write.parquet(options.output)
    value = layout.rank_of(ranks, options.target).collect()
    print(f"rank of {options.target}: {value[0]['value']:.6f}" if value else f"no node {options.target}")
    graph.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
