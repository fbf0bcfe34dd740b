"""agentlake: DataFrame operators for large collections of agent runs."""

import sys

from pyspark import cloudpickle

from agentlake.session import build_session, shared_dir

# Python functions of this package travel with the job that uses them, so executors
# need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "shared_dir"]
