"""quillmesh: DataFrame-native analytics over document corpora and the link graphs inside them."""

__version__ = "0.1.0"
