"""Declarative blocks and the pipelines that run them."""

from .blocks import (
    BatchFunction, Block, CatalogFilter, ConformerGenerator, Desalter, DescriptorFeaturizer, ElementFilter, FileSource, Filter, FunctionFeaturizer, FunctionFilter, FunctionPreparation, GobbiFeaturizer, HydrogenModifier, Kekulizer,
    MACCSFeaturizer, MemorySource, MorganFeaturizer, MWFilter, PropertyFilter, RuleOfFiveFilter, Sampler, Sanitizer, SMARTSFilter, TautomerCanonicalizer, UniqueFilter, ValidityFilter,
)
from .pipeline import Pipeline

__all__ = [
    "BatchFunction", "Block", "CatalogFilter", "ConformerGenerator", "Desalter", "DescriptorFeaturizer", "ElementFilter", "FileSource", "Filter", "FunctionFeaturizer", "FunctionFilter", "FunctionPreparation", "GobbiFeaturizer", "HydrogenModifier", "Kekulizer",
    "MACCSFeaturizer", "MemorySource", "MorganFeaturizer", "MWFilter", "Pipeline", "PropertyFilter", "RuleOfFiveFilter", "Sampler", "Sanitizer", "SMARTSFilter", "TautomerCanonicalizer", "UniqueFilter", "ValidityFilter",
]
