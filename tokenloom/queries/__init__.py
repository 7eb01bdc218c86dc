"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from tokenloom.queries import evaluation, noising, packing, prepare, runs, selection, streams

REGISTRY = {
    **prepare.QUERIES,
    **packing.QUERIES,
    **noising.QUERIES,
    **evaluation.QUERIES,
    **selection.QUERIES,
    **streams.QUERIES,
    **runs.QUERIES,
}
