"""Readers and writers."""

from siftline.sources.code_files import read_code_csv, read_source_files, write_code_csv, write_once, write_source_files
from siftline.sources.labelled import read_labelled_functions
from siftline.sources.lint import read_lint_reports
from siftline.sources.records import parse_records, read_commit_records

__all__ = [
    "parse_records",
    "read_code_csv",
    "read_commit_records",
    "read_labelled_functions",
    "read_lint_reports",
    "read_source_files",
    "write_code_csv",
    "write_once",
    "write_source_files",
]
