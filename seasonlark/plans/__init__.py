"""Registered queries over the given tables, with the SQL they are held against."""

from seasonlark.plans import records as records
from seasonlark.plans import regressions as regressions
from seasonlark.plans import regions as regions
from seasonlark.plans import scans as scans
