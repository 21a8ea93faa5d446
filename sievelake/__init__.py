"""sievelake: policy audit of data-pipeline source code, as Spark queries."""

__version__ = "0.1.0"
