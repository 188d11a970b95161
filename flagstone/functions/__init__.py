from flagstone.functions.keys import blank_trim, case_key, is_blank_key, key_part

__all__ = ["blank_trim", "case_key", "is_blank_key", "key_part"]
