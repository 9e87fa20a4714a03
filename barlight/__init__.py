"""Analytics on minute bars, research ledgers and text corpora, as Spark jobs."""
