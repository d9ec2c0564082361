"""modspark: content-moderation analytics as Spark DataFrame jobs.

Every public operator is a ``DataFrame -> DataFrame`` function (chain them
with ``DataFrame.transform``); nothing collects data-sized results to the
driver.  Sub-packages:

* ``functions``  - Column expressions (rounding, tokens, JSON clean-up, vectors)
* ``sources``    - readers, sinks and the bindings of the driver tables
* ``operators``  - scoring, features, triage, review, audit analytics, models
* ``plans``      - end-to-end jobs (moderate, drift check, training) and the
                   query catalogue used by ``__spark_entry__``
* ``streaming``  - the same column functions on ``readStream``
"""

from modspark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
