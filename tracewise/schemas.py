"""Table schemas of the lifecycle data model and its fixed vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()

PRODUCTS = T.StructType([
    T.StructField("ProductID", S, False),
    T.StructField("ModelName", S, True),
])
COMPONENTS = T.StructType([
    T.StructField("ComponentID", S, False),
    T.StructField("ComponentName", S, True),
])
RAW_MATERIALS = T.StructType([
    T.StructField("MaterialID", S, False),
    T.StructField("MaterialName", S, True),
    T.StructField("IsHazardous", T.BooleanType(), True),
    T.StructField("RecyclableGrade", S, True),
])
SUPPLIERS = T.StructType([
    T.StructField("SupplierID", S, False),
    T.StructField("SupplierName", S, True),
])
PRODUCT_INSTANCES = T.StructType([
    T.StructField("InstanceID", L, False),
    T.StructField("SerialNumber", S, True),
    T.StructField("ProductID", S, True),
])
LIFECYCLE_EVENTS = T.StructType([
    T.StructField("EventID", L, False),
    T.StructField("EventType", S, True),
    T.StructField("EventDate", T.TimestampNTZType(), True),
    T.StructField("InstanceID", L, True),
])
BILL_OF_MATERIAL = T.StructType([
    T.StructField("ParentComponentID", S, True),
    T.StructField("ChildComponentID", S, True),
    T.StructField("Quantity", T.IntegerType(), True),
])
WEIGHT = T.DecimalType(10, 2)
COMPONENT_COMPOSITION = T.StructType([
    T.StructField("ComponentID", S, True),
    T.StructField("MaterialID", S, True),
    T.StructField("WeightInGrams", WEIGHT, True),
])
SOURCING = T.StructType([
    T.StructField("SourcingID", L, True),
    T.StructField("SupplierID", S, True),
    T.StructField("ComponentID", S, True),
    T.StructField("MaterialID", S, True),
])
PRODUCT_ROOT = T.StructType([
    T.StructField("ProductID", S, False),
    T.StructField("ComponentID", S, False),
])

SCHEMAS = {
    "products": PRODUCTS,
    "components": COMPONENTS,
    "raw_materials": RAW_MATERIALS,
    "suppliers": SUPPLIERS,
    "product_instances": PRODUCT_INSTANCES,
    "lifecycle_events": LIFECYCLE_EVENTS,
    "bill_of_material": BILL_OF_MATERIAL,
    "component_composition": COMPONENT_COMPOSITION,
    "sourcing": SOURCING,
    "product_root": PRODUCT_ROOT,
}

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for right results.
# Event vocabulary, default state, grade scores, hazard labels, gate messages,
# hazardous weight limit and column length limits, in the reference's order.
# ---------------------------------------------------------------------------
MANUFACTURED = "Manufactured"
SOLD = "Sold"
REPAIR = "Repair"
RECYCLED = "Recycled"
RECYCLED_HAZARDOUS = "Recycled_Hazardous"
DISPOSED = "Disposed"
NO_EVENTS = "NoEvents"

GRADE_SCORES = {"A": 4, "B": 3, "C": 2, "D": 1}  # any other grade scores 0

HAZARD_YES = "Yes"
HAZARD_NO = "No"

SUPPLIER_BOTH = "Both"
SUPPLIER_COMPONENT = "Component Supplier"
SUPPLIER_MATERIAL = "Material Supplier"
SUPPLIER_UNKNOWN = "Unknown"

NO_SUBCOMPONENTS = "No subcomponents"
SUBCOMPONENTS_INFIX = " subcomponents: "

MSG_UNSOLD_DISPOSAL = "Cannot dispose unsold product"
MSG_HAZARD_LIMIT = "Excessive hazardous material use detected!"
MSG_INVALID_WEIGHT = "Invalid weight value"
MSG_INVALID_SUPPLY_TYPE = "Invalid supply type"
HAZARD_WEIGHT_LIMIT = 500

SUPPLY_COMPONENT = "component"
SUPPLY_MATERIAL = "material"

EVENT_TIME_FORMAT = "yyyy-MM-dd HH:mm"

VARCHAR_LIMITS = {
    ("products", "ProductID"): 50,
    ("products", "ModelName"): 100,
    ("components", "ComponentID"): 50,
    ("components", "ComponentName"): 100,
    ("raw_materials", "MaterialID"): 50,
    ("raw_materials", "MaterialName"): 100,
    ("raw_materials", "RecyclableGrade"): 20,
    ("suppliers", "SupplierID"): 50,
    ("suppliers", "SupplierName"): 100,
    ("product_instances", "SerialNumber"): 100,
    ("product_instances", "ProductID"): 50,
    ("lifecycle_events", "EventType"): 50,
    ("bill_of_material", "ParentComponentID"): 50,
    ("bill_of_material", "ChildComponentID"): 50,
    ("component_composition", "ComponentID"): 50,
    ("component_composition", "MaterialID"): 50,
    ("sourcing", "SupplierID"): 50,
    ("sourcing", "ComponentID"): 50,
    ("sourcing", "MaterialID"): 50,
}
# ---------------------------------------------------------------------------

# Messages of our own for failures the reference leaves to the database.
MSG_NULL_WEIGHT = "WeightInGrams cannot be null"
MSG_SOURCING_CHECK = "Exactly one of ComponentID and MaterialID is required"
MSG_DUPLICATE_SERIAL = "Duplicate serial number"
MSG_MISSING_SERIAL = "Serial number is required"
MSG_UNKNOWN_PRODUCT = "Unknown product"
MSG_UNKNOWN_INSTANCE = "Unknown instance"
MSG_DUPLICATE_SUPPLIER = "Duplicate supplier"
MSG_MISSING_SUPPLIER_ID = "Supplier ID is required"
MSG_MISSING_SUPPLIER_NAME = "Supplier name is required"
MSG_MISSING_EVENT_TYPE = "Event type is required"
MSG_UNKNOWN_COMPONENT = "Unknown component"
MSG_UNKNOWN_MATERIAL = "Unknown material"
MSG_UNKNOWN_SUPPLIER = "Unknown supplier"
MSG_DUPLICATE_COMPOSITION = "Duplicate composition row"
