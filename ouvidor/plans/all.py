"""Imports every module that registers queries."""

from ouvidor.operators import batching, clustering, complaints, dashboard, joins, logs, retrieval, rules_spec  # noqa: F401
from ouvidor.plans.registry import ORACLES, QUERIES  # noqa: F401
from ouvidor.streaming import logs as _streaming  # noqa: F401
