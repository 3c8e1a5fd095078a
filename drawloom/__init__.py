"""drawloom: a PySpark-native engine for ordered sets of number draws.

Everything is declared as DataFrame / SQL expressions; Catalyst and AQE choose
the physical plan.  ``drawloom.llm`` (optional, nothing else imports it) holds
operators for large training-data corpora.
"""

__version__ = "0.1.0"
