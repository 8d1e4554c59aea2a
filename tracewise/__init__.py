"""tracewise: lifecycle and material-traceability analytics as Spark operators.

    from tracewise.sources.tables import load_all
    from tracewise.operators import bom, dashboard, events, gates

Every operator takes and returns DataFrames; see README.md for the inventory.
"""

__version__ = "0.1.0"
