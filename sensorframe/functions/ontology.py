"""Label vocabularies of the shared evaluation classes and native annotations."""

from __future__ import annotations

from pyspark.sql import Column

from .text import lookup

ONTOLOGY_VERSION = "shared-detection-classes-v1"

# Shared classes and the provider labels mapped to them.
SHARED_CLASSES = ("person", "bicycle", "motor", "car", "truck", "bus")
PREDICTION_TO_SHARED = {
    "person": "person",
    "bicycle": "bicycle",
    "motorcycle": "motor",
    "car": "car",
    "truck": "truck",
    "bus": "bus",
}
GROUND_TRUTH_TO_SHARED = {
    "pedestrian": "person",
    "people": "person",
    "bicycle": "bicycle",
    "motor": "motor",
    "car": "car",
    "truck": "truck",
    "bus": "bus",
}

# Native annotation categories of the VisDrone data set.
NATIVE_CATEGORIES = {
    0: "ignored_region",
    1: "pedestrian",
    2: "people",
    3: "bicycle",
    4: "car",
    5: "van",
    6: "truck",
    7: "tricycle",
    8: "awning_tricycle",
    9: "bus",
    10: "motor",
    11: "others",
}


def shared_class_of_prediction(label: Column) -> Column:
    return lookup(PREDICTION_TO_SHARED, label)


def shared_class_of_ground_truth(label: Column) -> Column:
    return lookup(GROUND_TRUTH_TO_SHARED, label)
