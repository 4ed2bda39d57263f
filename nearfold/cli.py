"""python -m nearfold.cli [options] paths..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from .config import EngineConfig
from .plans.engine import Engine
from .sources import sinks

VERSION = "0.1.0"


def parse(argv: list[str]) -> tuple[EngineConfig, list[str]]:
    p = argparse.ArgumentParser(prog="nearfold")
    p.add_argument("paths", nargs="*")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("-q", dest="query", default="")
    for f in fields(EngineConfig):
        if f.name in ("query", "ignore_files"):
            continue
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(flag, dest=f.name, action="store_true")
        else:
            p.add_argument(flag, dest=f.name, type=type(f.default), default=f.default)
    x = vars(p.parse_args(argv))
    return EngineConfig(**{k: v for k, v in x.items() if k != "paths"}), x["paths"]


def main(argv: list[str] | None = None) -> int:
    config, paths = parse(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("nearfold").getOrCreate()
    engine = Engine(spark, config, say=lambda line: print(line, file=sys.stderr))
    try:
        if config.print_ignore:
            print("\n".join(engine.print_ignore(paths[0] if paths else ".")))
        elif config.print_files:
            for r in engine.print_files(paths or ["."]).toLocalIterator():
                print(r["path"])
        elif config.print_chunks:
            for r in engine.print_chunks(paths or ["."]).orderBy("id").select("shown").toLocalIterator():
                print(r["shown"], end="")
        elif config.skip:
            print(engine.skip(config.skip))
        elif config.print_chunk:
            for r in engine.chunk(config.print_chunk).toLocalIterator():
                print(f"{r['path']}:{r['start_line']}-{r['end_line']}\n{r['code']}")
        elif config.print_cluster:
            print(sinks.render(engine.find_cluster(config.print_cluster), config.format), end="")
        elif config.query:
            print(engine.run_search(config.query), end="")
        elif paths:
            print(engine.run(paths), end="")
        else:
            print("paths or -q needed", file=sys.stderr)
            return 2
    except (LookupError, OSError) as e:
        print(f"Error: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
