"""The ten operators' queries and the pipeline by name, and their SQL where SQL can say it."""

import corpus_pipeline

from . import linededup, nearjoin, vectors
from .langid import op9_language_id
from .linededup import op5_line_dedup
from .mixing import op7_mixing
from .nearjoin import op3_ngram_jaccard
from .packing import op1_packing
from .quality import op2_quality_rules
from .resampling import op10_quality_classifier
from .sstable import op4_sstable
from .suffixes import op8_suffix_dedup
from .vectors import op6_embedding_dedup

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sstable": op4_sstable,
    "op5_line_dedup": op5_line_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_mixing": op7_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op3_ngram_jaccard": nearjoin.ORACLE, "op5_line_dedup": linededup.ORACLE, "op6_embedding_dedup": vectors.ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
