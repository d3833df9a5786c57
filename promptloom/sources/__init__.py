from promptloom.sources.scratch import materialise
from promptloom.sources.tables import once, read_table

__all__ = ["materialise", "once", "read_table"]
