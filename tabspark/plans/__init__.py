"""The SQL subset: text to DataFrame plans."""

from tabspark.plans.sql import parse, run  # noqa: F401
