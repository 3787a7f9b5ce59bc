"""All plans of the reference's operators, each a query over the driver's tables."""
from __future__ import annotations

from functools import partial

from sightline.operators import exposure, finding, gating, geometry, guards, keeping, linking, measuring, metrics, ordering, programs, relations, rules, scalars, series, sessions, shaping, text, timers, views

from .dialect import oracle, run

PLANS = sessions.PLANS | guards.PLANS | metrics.PLANS | text.PLANS | geometry.PLANS | series.PLANS | scalars.PLANS | relations.PLANS
#: Functions over their own columns, with oracles written apart.
OPS = gating.OPS | finding.OPS | measuring.OPS | ordering.OPS | linking.OPS | shaping.OPS | keeping.OPS | rules.OPS | timers.OPS | views.OPS | exposure.OPS


def queries() -> dict:
    return {name: partial(run, sql) for name, sql in PLANS.items()} | programs.QUERIES | {name: query for name, (query, _) in OPS.items()}


def oracle_sql() -> dict:
    return {name: oracle(sql) for name, sql in PLANS.items()} | programs.ORACLES | {name: sql for name, (_, sql) in OPS.items() if sql}
