"""Lineage-tracing analytics on Spark: molecules, alleles, characters, trees and their statistics as DataFrame jobs."""
