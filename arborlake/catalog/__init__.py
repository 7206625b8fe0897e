"""Registered queries and their SQL counterparts."""

from importlib import import_module

MODULES = ("q_trees", "q_exprs", "q_stats", "q_spatial", "q_series", "q_voxels", "q_growth", "q_surfaces", "q_files")


def _merged(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"arborlake.catalog.{name}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
