"""python -m spoor.plans.cli CONFIG STEP... with steps extract, solve, evaluate and best."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.results import best, sorted_results
from ..sources.store import GraphStore
from ..sources.tracks_file import read_tracks, to_graph
from .config import Config
from .tracking import evaluate_store, extract_edges, solve_store


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config")
    parser.add_argument("steps", nargs="+", choices=["extract", "solve", "evaluate", "best"])
    parser.add_argument("--annotation", help="track file for evaluate")
    given = parser.parse_args(args)
    config = Config.from_file(given.config)
    spark = SparkSession.builder.appName("spoor").getOrCreate()
    store = GraphStore(spark, config.store, "a")
    roi = config.roi.roi if config.roi else None
    sets = config.solve.sets()
    for step in given.steps:
        if step == "extract":
            extract_edges(store, config.extract.edge_move_threshold, config.extract.use_motion, roi)
        elif step == "solve":
            solve_store(store, sets, config.solve.from_scratch, config.solve.clip_low_score, roi, **config.solve.blocks())
        elif step == "evaluate":
            gt = to_graph(read_tracks(spark, given.annotation, roi=roi))
            e = config.evaluate
            settings = dict(threshold=e.matching_threshold, window=e.window_size, sparse=e.sparse, count_unconnected_parent=e.fn_div_count_unconnected_parent, validation=e.validation_score, ignore_one_off=e.ignore_one_off_div_errors, exempt_after_end=e.exempt_divisions_after_end)
            for param_id in sets:
                evaluate_store(store, gt, param_id, settings, config.evaluation_roi, e.from_scratch)
        else:
            ranked = sorted_results(store.scores(), {"fp_edges": 1, "fn_edges": 1, "identity_switches": 1, "fp_divisions": 1, "fn_divisions": 1}, ("fp_divisions", "fn_divisions"))
            best(ranked).show(truncate=False)


if __name__ == "__main__":
    main()
