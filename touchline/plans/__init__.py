"""End-to-end jobs: landed files to stage tables to views of a match.

Each job reads stored tables and writes stored tables, so a lost executor
repeats tasks of one step only and no step plans the steps before it again.
"""
