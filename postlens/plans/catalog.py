"""Imports the query modules, which register themselves."""

from postlens.plans import q_imports, q_ingest, q_pages, q_people, q_postings, q_text  # noqa: F401
from postlens.plans.registry import QUERIES, SQL  # noqa: F401
