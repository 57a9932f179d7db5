"""Sinks for people and for other systems; tables are published by ledgerflow.plans."""

from ledgerflow.sinks.copytext import copy_text, write_copy_text
from ledgerflow.sinks.xlsx import write_xlsx

__all__ = ["copy_text", "write_copy_text", "write_xlsx"]
