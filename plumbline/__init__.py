"""Plumbline: ranked retrieval and counterfactual rank analysis as Spark DataFrame operators."""
