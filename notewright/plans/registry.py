"""Every registered query and its check, gathered from the plan modules."""

from __future__ import annotations

from notewright.plans import annotation, evaluation, gold, inference, preparation, retrying, storage, structured, training

MODULES = (evaluation, preparation, structured, inference, retrying, gold, training, annotation, storage)


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
