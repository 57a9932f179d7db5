"""Runs: what a pipeline declares, how its sources are bound, and how outputs are published."""

from ledgerflow.plans.jdbc import JdbcPublisher
from ledgerflow.plans.publish import Busy, PublishError, Publisher, Staged
from ledgerflow.plans.runner import Context, Output, Pipeline, RunResult, Source, csv_file, csv_file_set, custom, latest_csv, latest_xlsx, run_pipelines, xlsx_file, xlsx_file_set

__all__ = [
    "Busy", "Context", "JdbcPublisher", "Output", "Pipeline", "PublishError", "Publisher", "RunResult", "Source", "Staged", "csv_file", "csv_file_set", "custom", "latest_csv", "latest_xlsx", "run_pipelines", "xlsx_file", "xlsx_file_set",
]
