"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

CONFIGS = Path(__file__).parent


def options(name: str, about: str, paths: dict[str, str]) -> argparse.Namespace:
    """Arguments: one for each of paths, and a config file, whose values come as the dict config."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for path, meaning in paths.items():
        parser.add_argument(f"--{path}", required=True, help=meaning)
    parser.add_argument("--config", default=str(CONFIGS / f"{name}.json"), help="a JSON file (default: %(default)s)")
    parser.add_argument("--master", default=None, help="a Spark master; by default the one Spark is submitted to, or local[*]")
    args = parser.parse_args()
    args.config = json.loads(Path(args.config).read_text())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return args


def defaults(name: str) -> dict:
    """The values of the config file that comes with a job."""
    return json.loads((CONFIGS / f"{name}.json").read_text())
