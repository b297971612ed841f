"""PySpark engine for tracked objects: votes, hierarchies, histories and catalogue queries over snapshots."""
