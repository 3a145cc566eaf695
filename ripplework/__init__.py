"""ripplework: DataFrame operators for studying how training examples move a language model."""

__version__ = "0.1.0"
