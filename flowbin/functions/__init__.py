"""Column expressions: built-in Spark functions only (whole-stage codegen)."""

from flowbin.functions.classes import ip_class, port_class  # noqa: F401
from flowbin.functions.labels import binary_label, hash_unit  # noqa: F401
