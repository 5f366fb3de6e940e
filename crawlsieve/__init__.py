"""Audits of crawled web pages as Spark jobs: facts, page checks, cross-page checks, reports."""

from .operators.pages import page_audit, page_columns, page_issues
from .plans.audit import Audit, audit
from .plans.run import Run, resolve_inputs, run_audit, write_run

__all__ = ["Audit", "Run", "audit", "page_audit", "page_columns", "page_issues", "resolve_inputs", "run_audit", "write_run"]
