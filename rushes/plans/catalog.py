"""Imports every module that registers queries."""

from rushes.plans import detect, files, motion, runs, streams, text  # noqa: F401
from rushes.plans.registry import QUERIES, SQL  # noqa: F401
