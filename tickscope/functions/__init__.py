from .exprs import avg_path_length, finite, log_of, ratio, row_key, unit_hash

__all__ = ["avg_path_length", "finite", "log_of", "ratio", "row_key", "unit_hash"]
