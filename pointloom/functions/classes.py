"""The class dimension: identifiers, names and display colours, and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: class names in the order of their identifiers, with their colours
CLASSES = [
    ("ceiling", 233, 229, 107),
    ("floor", 95, 156, 196),
    ("wall", 179, 116, 81),
    ("beam", 241, 149, 131),
    ("column", 81, 163, 163),
    ("window", 223, 160, 168),
    ("door", 142, 86, 114),
    ("table", 153, 223, 138),
    ("chair", 149, 149, 241),
    ("sofa", 107, 229, 233),
    ("bookcase", 233, 107, 229),
    ("board", 107, 233, 107),
    ("clutter", 160, 160, 160),
]
IGNORE = -1
FEATURES = ["nx", "ny", "nz", "verticality", "planarity", "curvature", "red", "green", "blue"]

CLASS_SCHEMA = "class_id int not null, class_name string not null, cr int not null, cg int not null, cb int not null, hex string not null"
POINT_SCHEMA = "area string, room string, point_idx long, x double, y double, z double, r double, g double, b double, label int"
RUNLOG_SCHEMA = "epoch int, train_loss double, train_acc double, val_loss double, val_acc double, loss_diff double, acc_diff double, learning_rate double"


def classes(spark: SparkSession) -> DataFrame:
    """The 13-row class dimension ``(class_id, class_name, cr, cg, cb, hex)``."""
    return spark.createDataFrame([(i, n, r, g, b, f"#{r:02x}{g:02x}{b:02x}") for i, (n, r, g, b) in enumerate(CLASSES)], CLASS_SCHEMA)
