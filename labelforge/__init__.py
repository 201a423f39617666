"""labelforge: Spark-native report labelling and model-output evaluation.

Every operator takes and returns DataFrames (or Columns) and is built from
Spark SQL built-ins, so Catalyst plans, prunes and pushes down as usual.

Main entry points::

    from labelforge import (macro_metrics, one_vs_rest_auroc, macro_auroc,
                            stratified_split, stratified_kfold, expand_prompts,
                            batch_inference, with_multi_stage_label, with_confidences)
"""

from labelforge.functions.confidence import with_compliance, with_confidences  # noqa: F401
from labelforge.functions.labels import first_label, normalise_label, with_multi_stage_label  # noqa: F401
from labelforge.operators.auroc import macro_auroc, one_vs_rest_auroc, unranked, wide_export  # noqa: F401
from labelforge.operators.errors import align_by_occurrence, technique_effects  # noqa: F401
from labelforge.operators.inference import batch_inference, replay, resume_inference  # noqa: F401
from labelforge.operators.metrics import confusion_counts, confusion_matrix, label_encode, macro_metrics  # noqa: F401
from labelforge.operators.prompts import expand as expand_prompts  # noqa: F401
from labelforge.operators.reports import keyword_label, keyword_lift  # noqa: F401
from labelforge.operators.split import fold_table, stratified_kfold, stratified_split  # noqa: F401
from labelforge.schema import LABELS  # noqa: F401
from labelforge.session import get_spark  # noqa: F401

__version__ = "0.1.0"
