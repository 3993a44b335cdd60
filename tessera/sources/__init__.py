from tessera.sources.custom import Split, SplitSource

__all__ = ["Split", "SplitSource"]
