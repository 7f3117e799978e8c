"""The sample files, under the names that the tests use."""

from filegrain.plans.samples import FILES, box, heic

__all__ = ["FILES", "box", "heic"]
