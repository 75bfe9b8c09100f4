"""What the jobs' command lines share: config files, logging, a session."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from lanternmill.session import session


def config(name: str, path: str | None = None, **given) -> dict:
    """The settings of a job's own config file, those of another file over them, and those given over both. A name that
    the job's own file does not have is an error."""
    own = json.loads((Path(__file__).parent / f"{name}.json").read_text(encoding="utf-8"))
    more = (json.loads(Path(path).read_text(encoding="utf-8")) if path else {}) | given
    if unknown := set(more) - set(own):
        raise ValueError(f"no settings of {name}: {', '.join(sorted(unknown))}")
    return own | more


def main(name: str, run, *places: str) -> None:
    """Runs a job from its command line: its places, in order, and perhaps a config file and a master."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for place in places:
        parser.add_argument(place)
    parser.add_argument("--config", help=f"a JSON file with settings other than those of jobs/{name}.json")
    parser.add_argument("--master", help="Spark's master, where spark-submit names none")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = session(args.master)
    try:
        run(spark, *[getattr(args, p) for p in places], config(name, args.config))
    finally:
        spark.stop()
