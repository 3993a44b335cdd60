from tessera.streaming.keyed_state import KeyState, fold_by_key

__all__ = ["KeyState", "fold_by_key"]
