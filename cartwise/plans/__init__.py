"""Importing this package registers every query."""

from cartwise.plans import catalogue, cleaning, dashboard, more, pricing, streams, substitutes, upkeep  # noqa: F401
