"""All registered queries. Importing this module fills the registry."""

from __future__ import annotations

from . import (  # noqa: F401
    catalog_college,
    catalog_form,
    catalog_market,
    catalog_models,
    catalog_ops,
    catalog_players,
)
from .registry import REGISTRY

__all__ = ["REGISTRY"]
