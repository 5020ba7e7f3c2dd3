"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from . import analysis, files, network, skeletons, volumes  # noqa: F401
from .common import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "t07_descriptors"
