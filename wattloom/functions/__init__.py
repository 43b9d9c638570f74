from wattloom.functions.columns import (
    as_number, clip, code_map, default_number, finite, first_number, hash_bucket,
    hash_uniform, is_finite, null_nan, safe_ratio,
    unpivot,
)

__all__ = ["as_number", "clip", "code_map", "default_number", "finite", "first_number",
           "hash_bucket", "hash_uniform", "is_finite", "null_nan", "safe_ratio", "unpivot"]
