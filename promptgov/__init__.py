"""promptgov: governance of chat-model traffic held in Spark tables and streams."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from promptgov.operators.gate import Gate
from promptgov.sources.policy import Policy, load_policy

# The few Python functions travel to the executors with the job, so the package needs
# to be installed on the driver only.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["Gate", "Policy", "load_policy"]
