"""Tracewell: incident analytics and code-graph search as DataFrame programs."""
