"""stratum: imbalanced multi-class analysis and resampling as Spark DataFrame plans.

Every public function takes and returns DataFrames. Nothing pulls data rows to the
driver; the only driver round trips are small, parameter-bounded summaries (per-feature
min/max, per-class counts for model fitting, k-means centres).
"""

from stratum.session import get_session, checkpoint_dir, reliable_checkpoint  # noqa: F401
