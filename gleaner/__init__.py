"""Gleaner: Spark jobs for cleaning, filtering, deduplicating and preparing text corpora.

Everything takes a DataFrame and gives a DataFrame.  ``functions`` holds column expressions and the few
Arrow UDFs, ``operators`` the joins, groupings and windows built on them, ``sources`` readers and writers,
``plans`` whole curation plans and the registered queries.
"""

from gleaner.session import get_session, materialize, scratch_root, ship_package

__all__ = ["get_session", "materialize", "scratch_root", "ship_package"]
