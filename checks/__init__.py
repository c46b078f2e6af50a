"""Checked queries over the given tables, each with its SQL twin where SQL can say it."""


def all_checks():
    import importlib

    for part in PARTS:
        importlib.import_module(f"checks.{part}")
    from checks.registry import CHECKS

    return CHECKS


PARTS = ["loading", "features", "trading", "evaluation", "reporting", "models"]
