"""All registered queries and their SQL."""

from tomeflow.plans import functions, io, merging, scopes, texts, types  # noqa: F401  (they register)
from tomeflow.plans.registry import ORACLE, QUERIES  # noqa: F401
