"""Housing-deficit report over a household registry, on Spark."""

from lares.operators.summary import Totals
from lares.plans.housing import FAMILY, PERSON, Layout, components, report, summary, write_results
from lares.sources.exports import write_components, write_csv2, write_report
from lares.sources.registry import normalise_registry, read_registry, unreadable_numbers
from lares.sources.staging import Staging

__all__ = [
    "FAMILY",
    "PERSON",
    "Layout",
    "Staging",
    "Totals",
    "components",
    "normalise_registry",
    "read_registry",
    "report",
    "summary",
    "unreadable_numbers",
    "write_components",
    "write_csv2",
    "write_report",
    "write_results",
]
