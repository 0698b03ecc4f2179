"""tidemark: governed change-sets, record linkage and data reconciliation on Spark."""
