"""Relational operators over :class:`retort.frame.EntityFrame`."""

from .aggregate import collapse, feature_fold, fold_objects, unroll, update_from_children
from .columns import add_descriptors, item_key, numerized, reactions_valid
from .merge import merge_metadata
from .setops import append, concat, sample, unique

__all__ = ["add_descriptors", "append", "collapse", "concat", "feature_fold", "fold_objects", "item_key", "merge_metadata", "numerized", "reactions_valid", "sample", "unique", "unroll", "update_from_children"]
