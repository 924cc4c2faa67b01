"""Messy delimited text and workbooks to typed tables and back, as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel by value, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from rowloom.functions.split import split_fields  # noqa: E402
from rowloom.operators.cells import column_plan, column_types, to_cells, to_typed, with_profile  # noqa: E402
from rowloom.operators.densify import densify, render_lines  # noqa: E402
from rowloom.operators.profile import profile_files  # noqa: E402
from rowloom.operators.variants import typed_rows, typed_sources  # noqa: E402
from rowloom.plans.convert import (  # noqa: E402
    Options,
    batch_report,
    convert_batch,
    read_text,
    save_workbooks,
    text_to_cells,
    text_to_workbooks,
    workbooks_to_lines,
)
from rowloom.rules import DEFAULT_RULES, Rules, is_header_name, load_rules, resolve_overrides  # noqa: E402
from rowloom.sinks.text import write_lines  # noqa: E402
from rowloom.sinks.workbooks import export_workbooks  # noqa: E402
from rowloom.sources.stores import every_file  # noqa: E402
from rowloom.sources.tables import table_lines, text_lines  # noqa: E402
from rowloom.sources.text_files import list_files, read_lines  # noqa: E402
from rowloom.sources.workbooks import read_workbook_cells  # noqa: E402
from rowloom.streaming.watch import watch_folder  # noqa: E402

__all__ = [
    "DEFAULT_RULES",
    "Options",
    "Rules",
    "batch_report",
    "column_plan",
    "column_types",
    "convert_batch",
    "densify",
    "every_file",
    "export_workbooks",
    "is_header_name",
    "list_files",
    "load_rules",
    "profile_files",
    "read_lines",
    "read_text",
    "read_workbook_cells",
    "render_lines",
    "resolve_overrides",
    "save_workbooks",
    "split_fields",
    "table_lines",
    "text_lines",
    "text_to_cells",
    "text_to_workbooks",
    "to_cells",
    "to_typed",
    "typed_rows",
    "typed_sources",
    "watch_folder",
    "with_profile",
    "workbooks_to_lines",
    "write_lines",
]
