from tessera.functions.aggregators import AggFunction
from tessera.functions.exprs import is_blank, java_words, named_reducer, shift_char
from tessera.functions.types import ENCODERS, infer_type, to_type

__all__ = ["ENCODERS", "AggFunction", "infer_type", "is_blank", "java_words", "named_reducer", "shift_char", "to_type"]
