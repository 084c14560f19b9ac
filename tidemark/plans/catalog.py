"""Imports every plan module."""

from tidemark.plans import audits, coverage_plan, earnings_plan, evaluation, evidence_plan, modelling, observations, prices, ranking, routines, scoring, statements, streams, texts  # noqa: F401
