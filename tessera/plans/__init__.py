from tessera.plans.pagerank import pagerank

__all__ = ["pagerank"]
