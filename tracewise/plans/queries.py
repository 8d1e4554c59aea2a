"""Registered queries: each runs one operator of the library over the whole
adapter views of a driver scale-factor folder (``sf_dir``), with its DuckDB
oracle SQL over the same parquet tables (``tracewise.plans.oracle``).

Names follow SURVEY §7; the IDs each covers are in the docstrings.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import hazard_label
from ..operators import audits, bom, dashboard, events, features, gates, model, sourcing
from . import reports
from ..session import checkpointed
from ..sources.testdata import DriverTables

AS_OF = "2025-12-01"              # report date for ages and stamped events

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _t(spark: SparkSession, sf_dir: str):
    d = DriverTables(spark, sf_dir)
    return d, d.tables()


# -- dashboard ---------------------------------------------------------------
@query
def table_counts(spark, sf_dir):
    """A1."""
    return dashboard.table_counts(_t(spark, sf_dir)[1])


@query
def event_distribution(spark, sf_dir):
    """A2."""
    return dashboard.event_distribution(_t(spark, sf_dir)[1].lifecycle_events)


@query
def outcome_share(spark, sf_dir):
    """A3, A4."""
    return dashboard.outcome_share(_t(spark, sf_dir)[1].lifecycle_events)


@query
def recyclability_score(spark, sf_dir):
    """A5, J1, F1 (flagship)."""
    t = _t(spark, sf_dir)[1]
    return dashboard.recyclability_score(t.component_composition, t.raw_materials)


@query
def score_by_component(spark, sf_dir):
    """A5 per component, F1 case-insensitive."""
    t = _t(spark, sf_dir)[1]
    return dashboard.recyclability_score(t.component_composition, t.raw_materials,
                                         by="ComponentID", case_sensitive=False)


@query
def score_by_product(spark, sf_dir):
    """A5 per product, F1 case-insensitive."""
    t = _t(spark, sf_dir)[1]
    return dashboard.score_by_product(t.product_root, t.bill_of_material, t.component_composition, t.raw_materials)


# -- lifecycle ---------------------------------------------------------------
@query
def latest_state(spark, sf_dir):
    """W1, F2."""
    t = _t(spark, sf_dir)[1]
    return events.latest_state(t.product_instances, t.lifecycle_events)


@query
def lifecycle_age(spark, sf_dir):
    """W2, F5, F6."""
    t = _t(spark, sf_dir)[1]
    return events.lifecycle_age(t.product_instances, t.lifecycle_events, AS_OF)


@query
def timeline(spark, sf_dir):
    """W4, F4."""
    return events.timeline(_t(spark, sf_dir)[1].lifecycle_events)


@query
def recent_instances(spark, sf_dir):
    """T-1, T-2 (the top-10 is the feature)."""
    t = _t(spark, sf_dir)[1]
    return events.recent_instances(t.product_instances, t.lifecycle_events, 10)


@query
def recycle_target(spark, sf_dir):
    """A14, J9, P6."""
    t = _t(spark, sf_dir)[1]
    return events.recycle_target(t.product_instances, t.lifecycle_events)


# -- composition, BOM, trace ---------------------------------------------------
@query
def composition_detail(spark, sf_dir):
    """J1, F7."""
    t = _t(spark, sf_dir)[1]
    return bom.composition_detail(t.component_composition, t.raw_materials).select(
        "ComponentID", "MaterialID", "MaterialName",
        F.col("WeightInGrams").cast("double").alias("WeightInGrams"),
        "IsHazardous", "HazardLabel")


@query
def composition_share(spark, sf_dir):
    """W3."""
    t = _t(spark, sf_dir)[1]
    return bom.composition_share(t.component_composition, t.raw_materials)


@query
def component_weight(spark, sf_dir):
    """A7."""
    t = _t(spark, sf_dir)[1]
    return bom.component_weight(t.components, t.component_composition).select(
        "ComponentID", F.col("weight").cast("double").alias("weight"))


@query
def subcomponent_count(spark, sf_dir):
    """A8."""
    d, t = _t(spark, sf_dir)
    return bom.subcomponent_count(t.components, t.bill_of_material, d.slices())


@query
def component_details(spark, sf_dir):
    """A9, J6."""
    t = _t(spark, sf_dir)[1]
    return bom.component_details(t.components, t.bill_of_material)


@query
def component_summary(spark, sf_dir):
    """A10, J6, J12, F3."""
    d, t = _t(spark, sf_dir)
    return bom.component_summary(t.components, t.bill_of_material, slices=d.slices())


#: The ids by which the page reports below look up (any case, as the pages accept them).
LISTED, PRODUCT, SUPPLIER, INSTANCE = ("c1", "C2", "k3", "c32", "K99", "none"), "p1", "s1", 7


@query
def hierarchy_report(spark, sf_dir, ids=LISTED):
    """Summaries of a list of assemblies."""
    return reports.hierarchy_report(_t(spark, sf_dir)[1], ids)


@query
def trace_report(spark, sf_dir, product=PRODUCT):
    """P1, J5, T-2: the passport of one product."""
    found = reports.trace_report(_t(spark, sf_dir)[1], product)["trace"]
    return found.withColumn("WeightInGrams", F.col("WeightInGrams").cast("double"))


@query
def supplier_report(spark, sf_dir, supplier=SUPPLIER):
    """What one supplier sources."""
    t = _t(spark, sf_dir)[1]
    return sourcing.supplier_summary(t.sourcing, t.suppliers, supplier)


@query
def lifecycle_report(spark, sf_dir, instance=INSTANCE):
    """The events of one instance in order."""
    return reports.lifecycle_report(_t(spark, sf_dir)[1], instance, AS_OF)["timeline"]


@query
def trace_all(spark, sf_dir):
    """One row per (BOM edge, material of the child)."""
    t = _t(spark, sf_dir)[1]
    return bom.trace_all(t.components, t.bill_of_material, t.component_composition,
                         t.raw_materials).withColumn("WeightInGrams",
                                                     F.col("WeightInGrams").cast("double"))


@query
def trace_rollup(spark, sf_dir):
    """J4 rolled up per (component, material)."""
    d, t = _t(spark, sf_dir)
    return bom.trace_rollup(t.components, t.bill_of_material, t.component_composition,
                            t.raw_materials, d.slices())


@query
def material_passport(spark, sf_dir):
    """J5, F7, T-2: one row per (edge, material), with its place in the product's report."""
    t = _t(spark, sf_dir)[1]
    rows = bom.material_passport(t.product_root, t.bill_of_material, t.components,
                                 t.component_composition, t.raw_materials, position="position")
    return rows.select(
        "ProductID", "ComponentID", "ComponentName", "MaterialID", "MaterialName",
        F.col("WeightInGrams").cast("double").alias("WeightInGrams"), "RecyclableGrade",
        hazard_label("IsHazardous").alias("IsHazardous"),
        F.col("position").cast("int").alias("position"))


@query
def passport_rollup(spark, sf_dir):
    """J5 rolled up per product."""
    t = _t(spark, sf_dir)[1]
    return bom.passport_rollup(t.product_root, t.bill_of_material, t.components,
                               t.component_composition, t.raw_materials)


@query
def hazard_usage(spark, sf_dir):
    """A11 scope 'global', J11."""
    t = _t(spark, sf_dir)[1]
    return bom.hazard_usage(t.component_composition, t.bill_of_material, t.raw_materials)


@query
def hazard_usage_by_product(spark, sf_dir):
    """A11 scope 'product'."""
    t = _t(spark, sf_dir)[1]
    return bom.hazard_usage_by_product(t.products, t.product_root, t.bill_of_material,
                                       t.component_composition, t.raw_materials)


# -- sourcing ------------------------------------------------------------------
@query
def sourcing_detail(spark, sf_dir):
    """J2, J13, F2."""
    t = _t(spark, sf_dir)[1]
    return sourcing.sourcing_detail(t.suppliers, t.sourcing, t.components, t.raw_materials)


@query
def supplier_summary(spark, sf_dir):
    """J3."""
    t = _t(spark, sf_dir)[1]
    return sourcing.supplier_summary(t.sourcing, t.suppliers)


@query
def supplier_type(spark, sf_dir):
    """A6, J13, P7."""
    t = _t(spark, sf_dir)[1]
    return sourcing.supplier_type(t.suppliers, t.sourcing)


# -- validated ingest ----------------------------------------------------------
def _split_events(d, t, cutoff=None):
    """Events before the cut-off (default: the middle day of their period) are stored, the others come in."""
    le = t.lifecycle_events
    cut = F.lit(cutoff or d.event_days().first().middle).cast("timestamp_ntz")
    return le.filter(F.col("EventDate") < cut), le.filter(F.col("EventDate") >= cut)


@query
def disposal_gate(spark, sf_dir):
    """Events from the cutoff on are the batch, earlier ones stored."""
    stored, batch = _split_events(*_t(spark, sf_dir))
    d = gates.disposal_gate(stored, batch.select("EventID", "InstanceID", "EventType"))
    return gates.with_status(d)


@query
def hazard_weight_gate(spark, sf_dir):
    """G2, G3, P5, F10."""
    d, t = _t(spark, sf_dir)
    out = gates.hazard_weight_gate(d.composition_candidates(), t.raw_materials)
    return gates.with_status(out.withColumn("WeightInGrams",
                                            F.col("WeightInGrams").cast("double")))


@query
def sourcing_gate(spark, sf_dir):
    """G4."""
    d, _ = _t(spark, sf_dir)
    return gates.with_status(gates.sourcing_gate(d.sourcing_requests()))


@query
def register_instances(spark, sf_dir):
    """G5, R2, F9."""
    d, t = _t(spark, sf_dir)
    decided, _ = gates.register_instances(t.product_instances, t.products,
                                          d.registration_requests(), t.lifecycle_events,
                                          AS_OF)
    return gates.with_status(decided).select(
        "RequestID", "SerialNumber", "ProductID", "InstanceID", "EventID", "status", "reason")


@query
def append_events(spark, sf_dir):
    """G6, G1, P10."""
    d, t = _t(spark, sf_dir)
    stored, _ = _split_events(d, t)
    out = gates.append_events(t.product_instances, stored, d.event_requests(), AS_OF)
    return gates.with_status(out).select(
        "RequestID", "InstanceID", "EventType", "EventID", "status", "reason")


@query
def recycle_events(spark, sf_dir):
    """G7, J11, scope 'product'."""
    t = _t(spark, sf_dir)[1]
    return gates.recycle_events(t.product_instances, t.product_root, t.bill_of_material,
                                t.component_composition, t.raw_materials, AS_OF,
                                scope="product").select("InstanceID", "EventType")


@query
def recycle_events_global(spark, sf_dir):
    """G7, J11, scope 'global': one type for all, as the procedure decides it."""
    t = _t(spark, sf_dir)[1]
    return gates.recycle_events(t.product_instances, t.product_root, t.bill_of_material,
                                t.component_composition, t.raw_materials, AS_OF,
                                scope="global").select("InstanceID", "EventType")


@query
def add_suppliers(spark, sf_dir):
    """G8."""
    d, t = _t(spark, sf_dir)
    return gates.with_status(gates.add_suppliers(t.suppliers, d.supplier_requests()))


@query
def archive_delete(spark, sf_dir, before=None):
    """Events before a date (default: those of the first day) archived, the rest kept."""
    d, t = _t(spark, sf_dir)
    first = d.event_days().first().first
    before = before or (first and first + timedelta(days=1))
    le = t.lifecycle_events.select("EventID", "InstanceID", "EventType",
                                                       "EventDate")
    kept, backup = gates.archive_delete(
        le, F.col("EventDate") < F.lit(before).cast("timestamp_ntz"))
    return (kept.withColumn("archived", F.lit(False))
            .unionByName(backup.withColumn("archived", F.lit(True))).drop("EventDate"))


# -- audits ------------------------------------------------------------------
@query
def audit_report(spark, sf_dir):
    """Q1-Q6: one row per declared key, NOT NULL, CHECK and length rule."""
    d, t = _t(spark, sf_dir)
    return audits.audit_report(t, slices=d.slices())


# -- features and model --------------------------------------------------------
def _by_product(spark, sf_dir):
    t = _t(spark, sf_dir)[1]
    return features.features_by_product(t.product_instances, t.products, t.product_root,
                                        t.bill_of_material, t.component_composition,
                                        t.raw_materials, t.lifecycle_events)


@query
def features_global(spark, sf_dir):
    """A12, A15, J7, J8, P3 (as written: the same features for every instance)."""
    t = _t(spark, sf_dir)[1]
    return features.features_global(t.product_instances, t.products, t.bill_of_material,
                                     t.component_composition, t.raw_materials,
                                     t.lifecycle_events)


@query
def features_by_product(spark, sf_dir):
    """A13 (scoped to the product's root assembly)."""
    return _by_product(spark, sf_dir)


@query
def scaled_features(spark, sf_dir):
    """M1, M2, P9 over the product-scoped features."""
    ts = features.training_set(_by_product(spark, sf_dir))
    z = features.standard_scale(ts)
    return z.select("InstanceID", "target",
                    *[F.round(F.col(c + "_z"), 6).alias(c + "_z") for c in features.FEATURES])


def _rule_prediction():
    """Baseline rule: predict recycling when the mean grade score is >= 2.5."""
    return F.when(F.col("avg_recyclability") >= 2.5, 1).otherwise(0)


@query
def classification_report(spark, sf_dir):
    """M6, M7 over a rule-based prediction (mean grade score >= 2.5 -> recycle)."""
    ts = features.training_set(_by_product(spark, sf_dir))
    return model.classification_report(ts.withColumn("prediction", _rule_prediction()))


def _split_set(spark, sf_dir):
    """(train, test, feature names) of the scaled training set, materialised once: fitting reads it many times."""
    ts = checkpointed(features.training_set(_by_product(spark, sf_dir)))
    train, test = model.split(checkpointed(features.standard_scale(ts)))
    return train, test, [c + "_z" for c in features.FEATURES]


@query
def train_test_split(spark, sf_dir):
    """M3: every labelled instance with the part it falls into."""
    ts = features.training_set(_by_product(spark, sf_dir)).select("InstanceID", "target")
    train, test = model.split(ts)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def fit_gradient(spark, sf_dir):
    """M4: the objective's slope at the fitted weights on the training part, to three decimals: the optimum's is 0."""
    train, _, cols = _split_set(spark, sf_dir)
    weights, intercept = model.coefficients(model.fit_logistic(train, cols))
    found = model.gradient(train, cols, weights, intercept)
    return found.select("term", (F.round("gradient", 3) + 0.0).alias("gradient"), "n_rows")


#: Weights by which predict_given_weights and its SQL score (in the order of FEATURES), and the intercept.
GIVEN_WEIGHTS, GIVEN_INTERCEPT = [0.8, 1.1, -0.6, 0.3], 0.2


@query
def predict_given_weights(spark, sf_dir):
    """M5: probability and class of every labelled instance from given weights."""
    ts = checkpointed(features.training_set(_by_product(spark, sf_dir)))
    scored = model.predict_given(features.standard_scale(ts), [c + "_z" for c in features.FEATURES], GIVEN_WEIGHTS, GIVEN_INTERCEPT)
    return scored.select("InstanceID", "target", F.round("p_recycle", 6).alias("p_recycle"), "prediction")


@query
def train_predict(spark, sf_dir):
    """M3-M5: hash split, L2 logistic fit on the train part, test predictions."""
    train, test, cols = _split_set(spark, sf_dir)
    fitted = model.fit_logistic(train, cols)
    return model.predict(fitted, test).select("InstanceID", "target", "prediction",
                                              F.round("p_recycle", 6).alias("p_recycle"))


# -- streaming -----------------------------------------------------------------
@query
def stream_disposal_gate(spark, sf_dir):
    """The disposal gate as keyed streaming state over the events files
    (nothing stored before the stream starts)."""
    from ..streaming.runner import run_disposal_gate

    return spark.read.parquet(run_disposal_gate(spark, sf_dir))


@query
def stream_outcomes(spark, sf_dir):
    """Running event distribution from the events stream."""
    from ..streaming.runner import run_outcomes

    return spark.read.parquet(run_outcomes(spark, sf_dir))


# -- outputs -------------------------------------------------------------------
@query
def chart_series(spark, sf_dir):
    """Per component, its material chart payload as JSON."""
    from ..operators.sinks import chart_series as series

    t = _t(spark, sf_dir)[1]
    rows = bom.composition_detail(t.component_composition, t.raw_materials)
    return series(rows, "ComponentID", "MaterialName", "WeightInGrams", order="MaterialID")


@query
def stream_disposal_gate_batched(spark, sf_dir):
    """X1, set-based form: per micro-batch the batch gate against the touched buckets
    of first sales and held rows (JVM only, idempotent per epoch)."""
    from ..streaming.batched import gate_output, run_disposal_gate_batched

    return gate_output(spark, run_disposal_gate_batched(spark, sf_dir)).drop("epoch")


@query
def sourcing_ids(spark, sf_dir):
    """J2 in its older id-only form: suppliers left-joined to sourcing ids."""
    t = _t(spark, sf_dir)[1]
    return sourcing.sourcing_ids(t.suppliers, t.sourcing)


@query
def composition_gate(spark, sf_dir):
    """G2, G3 with the insert's foreign and primary keys: candidates against
    the stored composition table, in line-item order."""
    d, t = _t(spark, sf_dir)
    batch = d.composition_candidates().withColumn(
        "RequestID", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    out = gates.composition_gate(batch, t.raw_materials, t.components, t.component_composition)
    return gates.with_status(out).select(
        "l_orderkey", "l_linenumber", "ComponentID", "MaterialID",
        F.col("WeightInGrams").cast("double").alias("WeightInGrams"), "status", "reason")


@query
def sourcing_insert_gate(spark, sf_dir):
    """G4 with the insert's foreign keys."""
    d, t = _t(spark, sf_dir)
    out = gates.sourcing_insert_gate(d.sourcing_requests(), t.suppliers, t.components,
                                     t.raw_materials)
    return gates.with_status(out)
