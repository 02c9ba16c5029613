"""Spark jobs for running a public findings index: intake, scan, history, disclosure, publication, evaluation."""
