"""ledgernet: transaction-network analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers for edge/node/feature/label tables, fixture views, sinks
functions  column expressions (six statistics, entropy, deterministic draws, ...)
operators  graph construction, per-node features, egonets, k-hop balls,
           random walks, sampling, scaling, metrics, classification, embeddings
plans      end-to-end pipelines composing the operators
"""

__all__ = ["session"]
