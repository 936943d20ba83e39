"""Registered queries: every module adds its own to ``registry.QUERIES`` and ``registry.ORACLES``."""

from siltstone.plans import registry  # noqa: F401, I001
from siltstone.plans import evaluate, extract, packs, slices  # noqa: F401
