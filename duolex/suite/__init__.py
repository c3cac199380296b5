"""Registered queries side by side with the SQL they must agree with."""

from duolex.suite import scores, spelling, streams, tables, texts  # noqa: F401
from duolex.suite.base import QUERIES, SQL  # noqa: F401
