"""Key lookups on stored tables, two-level concatenation, and the classifier's evidence."""

import math

import pytest
from pyspark.sql import functions as F

from tracewise.functions.scalar import key_in, key_prefix
from tracewise.operators import bom, features, model, sinks, sourcing
from tracewise.operators.ranking import concat_within
from tracewise.plans import reports
from tracewise.sources.keyed import save_keyed
from tracewise.sources.tables import load_all


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from tracewise.sources.testdata import driver_tables

    t = driver_tables(spark, "/root/testdata/sf0.001")
    folder = str(tmp_path_factory.mktemp("keyed"))
    save_keyed(t, folder, files=6)
    own = load_all(spark, folder)
    return t, t.replace(**{n: getattr(own, n) for n in ("products", "product_root", "components", "bill_of_material",
                                                        "component_composition", "raw_materials", "suppliers", "sourcing")})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_lookups_equal_and_are_pushed(stored):
    t, keyed = stored
    ids = ["C1", "c2", "K3", "nothing"]
    got = bom.component_summary(keyed.components, keyed.bill_of_material, ids)
    assert same(got, bom.component_summary(t.components, t.bill_of_material, ids)) and got.count() > 0
    assert "PushedFilters: [In(ComponentID_key, [c1,c2,k3,nothing])" in plan_of(got)
    assert "PushedFilters: [In(ParentComponentID_key, [c1,c2,k3,nothing])" in plan_of(got)
    got = sourcing.supplier_summary(keyed.sourcing, keyed.suppliers, "S1")
    assert same(got, sourcing.supplier_summary(t.sourcing, t.suppliers, "S1")) and got.count() > 0
    assert "EqualTo(SupplierID_key,s1)" in plan_of(got)
    got = reports.trace_report(keyed, "P1")["trace"]
    assert same(got, reports.trace_report(t, "P1")["trace"]) and got.count() > 0
    assert "EqualTo(ProductID_key,p1)" in plan_of(got)
    prefix = key_prefix(keyed.bill_of_material, "ParentComponentID", "c")
    assert same(prefix, key_prefix(t.bill_of_material, "ParentComponentID", "c"))
    assert "StringStartsWith(ParentComponentID_key,c)" in plan_of(prefix)
    assert not any(c.endswith("_key") for c in key_in(keyed.components, "ComponentID", ids).columns)


def test_lookup_reads_few_files(stored):
    """The rows lie in ranges of the key: an id's files are those whose statistics hold it."""
    keyed = stored[1].component_composition
    files = keyed.select(F.input_file_name().alias("f"), "ComponentID_key").groupBy("f").agg(
        F.min("ComponentID_key").alias("lo"), F.max("ComponentID_key").alias("hi")).collect()
    one = keyed.agg(F.min("ComponentID_key")).first()[0]
    assert len(files) == 6 and sum(r.lo <= one <= r.hi for r in files) <= 2


def test_concatenation_of_a_hot_key_is_split(spark):
    """A third of all rows on one key: the text is whole and in order, its pieces come from several tasks."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                  F.pmod(F.xxhash64("id"), F.lit(1000)).alias("o"), "id",
                                  F.when(F.col("id") % 5 != 0, F.concat(F.lit("t"), "id")).alias("x"))
    got = concat_within(df, "k", ["o", "id"], "x", "text", count="n", partitions=12)
    want = df.groupBy("k").agg(F.expr("listagg(x, ', ') within group (order by o, id)").alias("text"), F.count("*").alias("n"))
    assert same(got.select("k", "text", "n"), want)
    parts = df.repartitionByRange(12, "k", "o", "id").where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert parts >= 4
    chart = sinks.chart_series(df.where("x is not null"), "k", "x", "id", order="o").where("k = 'hot'").first()["chart"]
    labels = [r["x"] for r in df.where("k = 'hot' and x is not null").orderBy("o", "x").collect()]
    assert chart.startswith('{"labels":["' + '","'.join(labels[:50]))


def test_gradient_and_given_weights(spark):
    rows = [(i, float((i * 7) % 11) - 5, float((i * 3) % 5) - 2, int((i * 7) % 11 + i % 4 > 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "InstanceID long, a double, b double, target int")
    weights, intercept = model.coefficients(model.fit_logistic(df, ["a", "b"]))
    found = {r.term: r.gradient for r in model.gradient(df, ["a", "b"], weights, intercept).collect()}
    assert set(found) == {"intercept", "a", "b"} and max(map(abs, found.values())) < 1e-5
    off = {r.term: r.gradient for r in model.gradient(df, ["a", "b"], [weights[0] + 0.5, weights[1]], intercept).collect()}
    n, p = len(rows), lambda r: 1 / (1 + math.exp(-(intercept + (weights[0] + 0.5) * r[1] + weights[1] * r[2])))
    by_hand = sum((p(r) - r[3]) * r[1] for r in rows) / n + (weights[0] + 0.5) / n
    assert off["a"] == pytest.approx(by_hand, abs=1e-12) and abs(off["a"]) > 1e-3
    fitted = {r.InstanceID: (r.p_recycle, r.prediction) for r in model.predict(model.fit_logistic(df, ["a", "b"]), df).collect()}
    given = {r.InstanceID: (r.p_recycle, r.prediction) for r in model.predict_given(df, ["a", "b"], weights, intercept).collect()}
    assert all(given[i][1] == fitted[i][1] and given[i][0] == pytest.approx(fitted[i][0], abs=1e-9) for i in given)


def test_score_by_product_on_the_seed(spark, seed):
    from tracewise.operators import dashboard

    got = {r.ProductID: (r.total_weight, r.score) for r in dashboard.score_by_product(
        seed.product_root, seed.bill_of_material, seed.component_composition, seed.raw_materials).collect()}
    rows = bom.material_passport(seed.product_root, seed.bill_of_material, seed.components, seed.component_composition, seed.raw_materials).collect()
    grade = {"A": 4, "B": 3, "C": 2, "D": 1}
    for product in {r.ProductID for r in rows}:
        mine = [(float(r.WeightInGrams), grade.get((r.RecyclableGrade or "").upper(), 0)) for r in rows if r.ProductID == product]
        w = sum(a for a, _ in mine)
        assert got[product][0] == pytest.approx(w) and got[product][1] == pytest.approx(round(sum(a * b for a, b in mine) / w, 2), abs=0.011)
    assert features.FEATURES
