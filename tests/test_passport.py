"""Places in the passport: added up from edges and materials, the passport's rows are never stored."""

import pytest
from pyspark.sql import functions as F

from tracewise.operators import bom, ranking


@pytest.fixture
def tables(spark):
    """Product P1 has edge X1 twice; components, materials and compositions come twice; null names and keys."""
    return {
        "root": spark.createDataFrame([("P1", "R1"), ("P2", "R2"), ("P3", "R9"), (None, "R1"), ("P4", None)], "ProductID string, ComponentID string"),
        "bom": spark.createDataFrame([("R1", "X1", 1), ("R1", "X1", 2), ("R1", "X2", 1), ("R1", "X4", 1), ("R2", "X2", 1), ("R2", "X3", 1), (None, "X1", 1)],
                                     "ParentComponentID string, ChildComponentID string, Quantity int"),
        "components": spark.createDataFrame([("X1", "b"), ("X2", "a"), ("X2", "c"), ("X3", None), ("X4", "a"), (None, "n")],
                                            "ComponentID string, ComponentName string"),
        "cc": spark.createDataFrame([("X1", "M2"), ("X1", "M1"), ("X1", "M2"), ("X2", "M1"), ("X2", "M3"), ("X3", "M2"), ("X4", "M9"), ("X4", None)],
                                    "ComponentID string, MaterialID string").withColumn("WeightInGrams", F.lit(1).cast("decimal(10,2)")),
        "rm": spark.createDataFrame([("M1", "m", "A", True), ("M2", "m", "B", False), ("M3", "x", "C", None), ("M3", "y", "C", True)],
                                    "MaterialID string, MaterialName string, RecyclableGrade string, IsHazardous boolean"),
    }


def key(r):
    return tuple((r[c] is not None, r[c] or "") for c in ("ComponentName", "ComponentID", "MaterialID"))


def test_positions_equal_the_sorted_rows(spark, tables, monkeypatch):
    stored = []

    def count_rows(df, name, scratch=None):
        stored.append(df.count())
        return df

    t = tables.values()
    plain = bom.material_passport(*t).collect()
    monkeypatch.setattr(ranking, "stored", count_rows)
    got = bom.material_passport(*t, position="position").collect()
    rest = [c for c in got[0].asDict() if c != "position"]
    assert sorted(repr([r[c] for c in rest]) for r in got) == sorted(repr([r[c] for c in rest]) for r in plain)
    products = {r["ProductID"] for r in got}
    assert None in products and len(got) > 20
    for p in products:
        mine = sorted((r for r in got if r["ProductID"] == p), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(1, len(mine) + 1))
        assert [key(r) for r in mine] == sorted(map(key, mine))
    assert len(stored) == 2 and max(stored) < len(plain)
