"""Command line: cluster the sequences of a FASTA file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from strandlink.config import ClusterConfig
from strandlink.operators.cluster import Counters, clusters, totals
from strandlink.plans.shipping import ship
from strandlink.plans.stages import materialize
from strandlink.sources.fasta import InvalidInput, db_info, read_fasta, validate
from strandlink.sources.report import write_report, write_statistics


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{message}\n")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="strandlink", description=__doc__, add_help=False)
    p.add_argument("path")
    p.add_argument("-h", "--help", action="store_true")
    p.add_argument("-d", "--differences", type=int, default=1, help="resolution: largest number of differences of linked sequences")
    p.add_argument("-o", "--output-file", default="result.log", help="folder of the report")
    p.add_argument("-t", "--threads", type=int, default=2, help="accepted; Spark decides")
    p.add_argument("-m", "--match-reward", type=int, default=5)
    p.add_argument("-p", "--mismatch-penalty", type=int, default=4)
    p.add_argument("-g", "--gap-opening-penalty", type=int, default=12)
    p.add_argument("-e", "--gap-extension-penalty", type=int, default=4)
    p.add_argument("--statistics", default=None, help="folder for the run's work counters")
    p.add_argument("--unordered", action="store_true", help="clusters in any order, without a sort of all rows")
    p.add_argument("-y", "--depth", type=int, default=None, help="accepted; has no effect on the answer")
    return p


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    p = parser()
    if "-h" in args or "--help" in args:
        p.print_help()
        return 1
    a = p.parse_args(args)
    try:
        config = ClusterConfig(
            resolution=a.differences, match=a.match_reward, mismatch=-a.mismatch_penalty, gap_open=a.gap_opening_penalty, gap_extend=a.gap_extension_penalty, depth=a.depth, threads=a.threads, output=a.output_file
        )
        spark = SparkSession.builder.appName("strandlink").getOrCreate()
        ship(spark)
        print("\n".join(config.describe()))
        sequences = validate(materialize(read_fasta(spark, a.path), "sequences"), config)
        info = db_info(sequences).first()
        print(f"{info['nucleotides']} nt in {info['sequences']} sequences, longest {info['longest']} nt")
        counters = Counters()
        clustered = materialize(clusters(sequences, config, counters), "clusters")
        write_report(clustered, sequences, config.output, ordered=not a.unordered)
        if a.statistics:
            done = counters.totals()
            write_statistics(spark.createDataFrame([done], ", ".join(f"{x} long" for x in done)), a.statistics)
        t = totals(clustered).first()
        print(f"{t['clusters']} clusters of {t['sequences']} sequences")
    except (ValueError, InvalidInput) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
