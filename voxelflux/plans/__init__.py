"""Query registration by section; importing a module registers its queries."""
import importlib

MODULES = ("q_ingest", "q_match", "q_trains", "q_boxes", "q_codec", "q_stats", "q_codelen", "q_shift", "q_motion", "q_tasks",
           "q_instants", "q_stream")


def load():
    from .registry import ORACLES, QUERIES
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
