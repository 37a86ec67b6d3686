"""All registered queries and their oracles."""

from importlib import import_module

from cytoquill.queries.registry import ORACLES, QUERIES

FAMILIES = ["columns", "ranges", "comparison", "perread", "quality", "learning", "haplotypes", "export", "files"]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"cytoquill.queries.{family}")


__all__ = ["FAMILIES", "ORACLES", "QUERIES", "load_all"]
