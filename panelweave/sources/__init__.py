"""Reading period-stamped files, saving and loading panels."""

from panelweave.sources.period_files import infer_schema, list_files, read_period_files
from panelweave.sources.tables import load_panel, remove_folder, reused, save_panel, save_report, stage_folder, staged
from panelweave.sources.workbooks import read_workbooks, workbook, workbook_rows

__all__ = [
    "infer_schema",
    "list_files",
    "load_panel",
    "read_period_files",
    "read_workbooks",
    "remove_folder",
    "reused",
    "save_panel",
    "save_report",
    "stage_folder",
    "staged",
    "workbook",
    "workbook_rows",
]
