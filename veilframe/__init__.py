"""Privacy transformations over tables and streams of text, as Spark jobs."""

from veilframe.functions.keyed import Keys
from veilframe.plans.obfuscate import Config, Result, obfuscate, process_batch

__all__ = ["Config", "Keys", "Result", "obfuscate", "process_batch"]
