"""Imports every module that registers queries."""

from patchloom.plans import q_catalog, q_chat, q_files, q_pairs, q_runs, q_text  # noqa: F401
