"""Output schemas: inferred from values or declared and enforced."""

from ledgerflow.schema.declared import Column, SchemaError, declared_type, enforce, struct_of
from ledgerflow.schema.infer import InferenceError, apply_inferred, infer_schema

__all__ = ["Column", "InferenceError", "SchemaError", "apply_inferred", "declared_type", "enforce", "infer_schema", "struct_of"]
