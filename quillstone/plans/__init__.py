"""Dataset catalog and pipeline runner."""
